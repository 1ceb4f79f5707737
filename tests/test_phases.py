"""The phases between column analysis and export, against plain versions."""

import random
import statistics

from pyspark.sql import functions as F

from cellsense.operators import concepts, disambiguation, relations
from cellsense.plans import phases

LABEL, TYPE, REDIRECT, ONTO = "label", "type", "redirect", "http://dbpedia.org/ontology/"
DBR = "http://dbpedia.org/resource/"


def graph(spark, rows):
    return spark.createDataFrame([(s, p, o, "uri" if o.startswith("http") else "literal", None, lang) for s, p, o, lang in rows], "s string, p string, o string, o_kind string, o_datatype string, o_lang string")


def test_a_deep_chain_is_closed_in_a_few_rounds(spark):
    edges = [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [("c40", "c00"), ("c00", "c20"), ("x", "c39"), (None, "y"), ("z", "z")]
    got = {(r.above, r["class"]): list(r.path) for r in concepts.ontology_closure(spark.createDataFrame(edges, "parent string, child string")).collect()}
    assert got["c01", "c19"] == [f"c{i:02}" for i in range(1, 20)]
    assert got["c00", "c22"] == ["c00", "c20", "c21", "c22"] and got["x", "c00"] == ["x", "c39", "c40", "c00"]
    assert len(got) == 41 * 41 + 42 and all(p[0] == a and p[-1] == b for (a, b), p in got.items())


def test_of_equal_ways_the_first_by_code_point_stays(spark):
    edges = spark.createDataFrame([("r", "b"), ("r", "a"), ("a", "z"), ("b", "y"), ("y", "t"), ("z", "t"), ("b", "t")], "parent string, child string")
    got = {(r.root, r["class"]): list(r.path) for r in concepts.ontology_paths(edges, spark.createDataFrame([("r",), ("alone",)], "root string")).collect()}
    assert got["r", "t"] == ["r", "b", "t"] and got["alone", "alone"] == ["alone"] and len(got) == 7


def numeric(a, b):
    return 1 - abs(a - b) / max(abs(a), abs(b), 1)


def test_running_sums_are_means_over_all_pairs(spark):
    rng = random.Random(4)
    number = lambda: rng.choice([0, 1, -1, rng.uniform(-3, 3), rng.uniform(-1, 1), rng.randint(-500, 500), 10 ** rng.randint(0, 12)])
    cells = [("t", c, number()) for c in range(3) for _ in range(200)] + [("t", 1, 7.5)] * 40
    values = [("t", c, f"p{i % 4}", number(), 5) for c in range(3) for i in range(24)]
    text = lambda x: format(x, "f") if isinstance(x, float) else str(x)
    got = relations.typed_similarity(
        spark.createDataFrame([(t, c, text(v)) for t, c, v in cells], "table_id string, col_idx int, value string"),
        spark.createDataFrame([(t, c, p, text(v), f) for t, c, p, v, f in values], "table_id string, col_idx int, p string, value string, freq long"),
        least=-9,
    )
    want = {}
    for _, c, p, v, f in values:
        mean = statistics.mean(numeric(float(text(x)), float(text(v))) for _, k, x in cells if k == c)
        want[c, p] = max(want.get((c, p), -99), mean * f)
    have = {(r.col_idx, r.p): r.score for r in got.collect()}
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)


def test_kinds_meet_their_own_kind_only(spark):
    cells = spark.createDataFrame([("t", 0, "12"), ("t", 0, "2001-01-01"), ("t", 0, "word"), ("t", 0, "")], "table_id string, col_idx int, value string")
    values = spark.createDataFrame([("t", 0, "n", "12", 1), ("t", 0, "d", "2001-01-01", 2), ("t", 0, "w", "Word", 3), ("t", 0, "e", "", 3), ("t", 1, "n", "12", 1)], "table_id string, col_idx int, p string, value string, freq long")
    assert {r.p: r.score for r in relations.typed_similarity(cells, values).collect()} == {"n": 1.0, "d": 2.0, "w": 3.0}


def test_persons_aliases_and_loose_words_are_found(spark):
    g = graph(spark, [
        (DBR + "Grace_Hopper", LABEL, "Grace Hopper", "en"), (DBR + "Grace_Hopper", TYPE, ONTO + "Person", None), (DBR + "Hopper", LABEL, "Grasshopper machine", "en"),
        (DBR + "NYC", LABEL, "new york city", "en"), (DBR + "NYC", REDIRECT, DBR + "New_York", None), (DBR + "Berlin", LABEL, "Berlin", "de"),
    ])
    values = spark.createDataFrame([("g hopper", "G. Hopper"), ("new york city", "New York City"), ("berlin wall", "Berlin Wall"), ("nothing", "Nothing"), ("x y", None)], "value string, value_original string")
    got = {(r.value, r.entity, r.alias) for r in disambiguation.found_by_text(values.fillna("X y"), g, LABEL, REDIRECT, TYPE, ONTO + "Person").collect()}
    assert got == {("g hopper", DBR + "Grace_Hopper", None), ("new york city", DBR + "NYC", None), ("new york city", DBR + "New_York", DBR + "NYC"), ("berlin wall", DBR + "Berlin", None)}


def test_words_around_a_cell_decide(spark):
    g = graph(spark, [
        (DBR + "Paris", LABEL, "Paris", "en"), (DBR + "Paris", "about", "capital city of France with museums", "en"), (DBR + "Paris", "about", "ville musées", "fr"),
        (DBR + "paris", LABEL, "Paris", "en"), (DBR + "paris", "about", "a town of Texas", "en"), (DBR + "River", "flows", DBR + "Paris", None),
    ])
    rows = [("a", 0, 0, "city", "paris"), ("a", 0, 1, "land", "France"), ("a", 0, 2, "sight", "museum"), ("b", 0, 0, "town", "paris"), ("b", 0, 1, "state", "texas")]
    cells = spark.createDataFrame([(*r, r[-1]) for r in rows], "table_id string, row_idx long, col_idx int, header string, value string, value_original string")
    columns = spark.createDataFrame([("a", 0), ("b", 0)], "table_id string, col_idx int")
    got = phases.disambiguation_phase(cells, columns, g, LABEL, REDIRECT, TYPE, ONTO + "Person")
    best = {r.table_id: r for r in got.where("winning").collect()}
    assert best["a"].entity == DBR + "Paris" and best["b"].entity == DBR + "paris"
    # header: city; row: France, museum (the graph has museums); both share the cell's word with the name and the label
    assert (best["a"].row_score, best["a"].cell_score) == (3, 2) and got.count() == 4


def test_predicates_of_entity_and_literal_columns(spark):
    rows, triples = [], []
    for i in range(20):
        e, c = f"{DBR}E{i}", f"{DBR}C{i % 4}"
        rows += [("t", i, 0, f"thing {i}"), ("t", i, 1, f"place {i % 4}"), ("t", i, 2, str(100 + i)), ("t", i, 3, f"2001-01-{i + 1:02}")]
        triples += [(e, LABEL, f"thing {i}", "en"), (c, LABEL, f"place {i % 4}", "en"), (e, ONTO + "home", c, None), (e, ONTO + "size", str(100 + i), None), (e, ONTO + "born", f"2001-01-{i + 1:02}", None), (e, "http://other/size", str(100 + i), None), (e, ONTO + "note", f"unlike {i} all others", "en")]
    cells = spark.createDataFrame(rows, "table_id string, row_idx long, col_idx int, value string")
    g = graph(spark, triples).distinct()
    kinds = spark.createDataFrame([("t", 0, "NE"), ("t", 1, "NE"), ("t", 2, "LIT"), ("t", 3, "LIT")], "table_id string, col_idx int, col_class string")
    subjects = spark.createDataFrame([("t", 0)], "table_id string, subject_col int")
    winners = cells.where("col_idx < 2").select("table_id", "row_idx", "col_idx", F.concat(F.lit(DBR), F.when(F.col("col_idx") == 0, F.replace("value", F.lit("thing "), F.lit("E"))).otherwise(F.replace("value", F.lit("place "), F.lit("C")))).alias("entity"))
    got = {r.col_idx: r.p for r in phases.predicate_phase(cells, kinds, subjects, winners, g, LABEL, ONTO).collect()}
    assert got == {1: ONTO + "home", 2: ONTO + "size", 3: ONTO + "born"}


def test_closure_meets_each_way_at_one_place(spark, monkeypatch):
    """A chain of 40 classes with cycles and equally short ways: six rounds reach every way, and none is joined to find that nothing is left."""
    tables, stage = [], concepts.staged
    monkeypatch.setattr(concepts, "staged", lambda df: tables.append(1) or stage(df))
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)]
    edges = spark.createDataFrame([*chain, ("c40", "c00"), ("c00", "b"), ("b", "c02"), (None, "x"), ("y", "y")], "parent string, child string")
    got = {(r.above, r["class"]): r.path for r in concepts.ontology_closure(edges).collect()}
    assert len(got) == 42 * 42 and got["c00", "c02"] == ["c00", "b", "c02"] and got["c00", "c40"] == ["c00", "b", *[f"c{i:02}" for i in range(2, 41)]]
    assert got["c03", "c01"][-2:] == ["c00", "c01"] and got["c05", "c05"] == ["c05"]
    assert len(tables) == 7


def test_texts_meet_only_values_that_can_be_the_best(spark, monkeypatch):
    """As all pairs, over persons, descriptions and other texts; of a thousand texts beside a date that is more like the column than they can be, none meets its cells."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdeé😀 -") for _ in range(n)).strip() or "a"
    cells = [("t", c, x) for c, x in [(0, word(rng.randint(1, 14))) for _ in range(60)] + [(0, f"J. Maker{i}") for i in range(9)] + [(1, f"+{i}-01-{i % 28 + 1:02}") for i in range(10000, 10400)] + [(2, "goods of every house " * 5 + word(3)) for _ in range(9)]]
    values = [("t", c, f"p{i % 3}", v, 2) for c, vs in enumerate(([word(rng.randint(1, 14)) for _ in range(60)] + ["Jane Maker3", "J"], [f"+{i}-01-{i % 28 + 1:02}" for i in range(10000, 11000)], ["EVERY HOUSE", "house of", "goods of every house " * 5])) for i, v in enumerate(vs)]
    cells += [("t", 1, f"2001-01-{i:02}") for i in range(1, 29)]
    values += [("t", 1, f"p{i}", "2001-01-14", 2) for i in range(3)] + [("t", 0, None, "ab", 2)] + [("t", 0, None, word(5), 2) for _ in range(40)]
    cell_rows = spark.createDataFrame(cells, "table_id string, col_idx int, value string")
    value_rows = spark.createDataFrame(values, "table_id string, col_idx int, p string, value string, freq long").distinct()
    compared, means = [], relations._text_means
    monkeypatch.setattr(relations, "_text_means", lambda texts, asked: compared.append(asked.where("col_idx = 1").count()) or means(texts, asked))
    got = {(r.col_idx, r.p): r.score for r in relations.typed_similarity(cell_rows, value_rows, least=0.05).collect()}
    pairs = cell_rows.withColumnRenamed("value", "cell").join(value_rows, ["table_id", "col_idx"]).withColumn("sim", relations.text_similarity(F.col("cell"), F.col("value")))
    mean = pairs.groupBy("col_idx", "p", "value").agg(F.avg("sim").alias("mean"))
    want = {(r.col_idx, r.p): 2 * r.best for r in mean.groupBy("col_idx", "p").agg(F.max("mean").alias("best")).where("best > 0.05").collect()}
    assert {k for k in got if k[0] != 1} == {k for k in want if k[0] != 1} and len(got) > 6 and all(abs(got[k] - want[k]) < 1e-9 for k in want if k[0] != 1)
    assert sum(compared) == 0 and all(got[1, f"p{i}"] > 1.9999 for i in range(3))


def test_labels_are_dealt_only_for_texts_that_ask_for_them(spark, monkeypatch):
    """Where all words of every text are found and no text is a person's, labels are looked through once; the others are looked for as before."""
    asked, match = [], disambiguation.Q.text_match
    monkeypatch.setattr(disambiguation.Q, "text_match", lambda queries, labels, any_word=False: asked.append(any_word) or match(queries, labels, any_word))
    g = graph(spark, [(DBR + "Berlin", LABEL, "Berlin", "de"), (DBR + "Ada", LABEL, "Ada Lovelace", "en"), (DBR + "Ada", TYPE, ONTO + "Person", None)])
    find = lambda *rows: {(r.value, r.entity) for r in disambiguation.found_by_text(spark.createDataFrame(rows, "value string, value_original string"), g, LABEL, REDIRECT, TYPE, ONTO + "Person").collect()}
    assert find(("berlin", "Berlin")) == {("berlin", DBR + "Berlin")} and asked == [False]
    assert find(("berlin wall", "Berlin Wall"), ("a lovelace", "A. Lovelace")) == {("berlin wall", DBR + "Berlin"), ("a lovelace", DBR + "Ada")} and asked == [False] * 2 + [True, False]
