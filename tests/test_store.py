"""What is kept on disk: versions, memo of linking, triples, label index, catalogue pages."""

import random

import pytest
from pyspark.sql import functions as F

from cellsense.operators import candidates, catalog
from cellsense.plans import phases
from cellsense.sources.store import LabelIndex, TripleStore
from cellsense.sources.versions import Versions, merged

TRIPLES = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"


def test_a_reader_sees_old_or_new_never_half(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    assert v.latest() is None and v.history() is None
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, x string")
    assert v.publish(first) == 1
    old = v.latest()
    assert v.update(spark.createDataFrame([(2, "B"), (4, "d")], "k int, x string"), ["k"], removed=spark.createDataFrame([(3,)], "k int")) == 2
    assert sorted(map(tuple, old.collect())) == [(1, "a"), (2, "b"), (3, "c")] and sorted(map(tuple, v.latest().collect())) == [(1, "a"), (2, "B"), (4, "d")]
    # a writer that stopped half-way
    first.write.parquet(v.folder(v._claim()))
    v.fs.delete(v._path(v.folder(3) + "/_SUCCESS"), False)
    assert v.complete() == [1, 2] and v.latest().count() == 3 and v.publish(first) == 4
    assert {(r.k, r.x) for r in merged(v.history(2), ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "c"), (4, "d")}


def graph(spark, rows):
    return spark.createDataFrame([(s, p, o, "uri" if o.startswith("http") else "literal", None, None) for s, p, o in rows], TRIPLES)


def test_a_second_run_looks_up_new_values_only(spark, tmp_path):
    R, O = "http://dbpedia.org/resource/", "http://dbpedia.org/ontology/"
    g = graph(spark, [t for n in ("Paris", "Berlin", "Texas", "Rome") for t in ((R + n, "label", n), (R + n, "type", O + ("State" if n == "Texas" else "City")))] + [(R + "Paris_(band)", "label", "Paris"), (R + "Paris_(band)", "type", O + "Band")])
    cells = lambda *values: spark.createDataFrame([("t", i, 0, "city", v, v) for i, v in enumerate(values)], "table_id string, row_idx long, col_idx int, header string, value string, value_original string")
    columns = spark.createDataFrame([("t", 0, O + "City")], "table_id string, col_idx int, type string")
    memo = Versions(spark, str(tmp_path / "memo"))
    run = lambda c, **k: (lambda out: ({(r.row_idx, r.entity) for r in out[0].collect()}, out[1]))(phases.linking_phase(c, columns, g, "label", "redirect", "type", O + "Person", **k))
    first = run(cells("paris", "berlin", "paris", "texas", "nowhere", ""), memo=memo)
    assert first == ({(0, R + "Paris"), (1, R + "Berlin"), (2, R + "Paris")}, 4)  # Texas is no city
    assert run(cells("paris", "rome", "texas", "nowhere"), memo=memo) == ({(0, R + "Paris"), (1, R + "Rome")}, 1)
    assert run(cells("paris", "rome", "texas", "nowhere"), memo=memo)[1] == 0 and memo.complete() == [1, 2]
    assert run(cells("paris", "rome")) == ({(0, R + "Paris"), (1, R + "Rome")}, 2)
    assert {(r.value, r.version) for r in memo.history().collect()} == {("paris", 1), ("berlin", 1), ("texas", 1), ("nowhere", 1), ("rome", 2)}


def shuffles(df) -> tuple[int, bool]:
    """The shuffles of a plan, and whether its kept table is read by buckets."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    return plan.count("Exchange hashpartitioning"), "Bucketed: true" in plan


def test_joins_with_kept_triples_shuffle_only_the_other_side(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"http://s{rng.randint(0, 50)}", f"p{rng.randint(0, 3)}", rng.choice([f"http://s{rng.randint(0, 50)}", "text"])) for _ in range(600)]
    g = graph(spark, rows + rows[:50])
    TripleStore.write(g, str(tmp_path / "kg"), 8)
    store = TripleStore(spark, str(tmp_path / "kg"))
    asked = spark.createDataFrame([(f"http://s{i}",) for i in range(0, 50, 7)], "s string")
    out, back = store.outgoing(asked), store.incoming(asked.withColumnRenamed("s", "o"))
    want = {r for r in rows if int(r[0][8:]) % 7 == 0 and int(r[0][8:]) < 50}
    assert sorted((r.s, r.p, r.o) for r in out.collect()) == sorted(want)
    assert {(r.s, r.p, r.o) for r in back.collect()} == {r for r in rows if r[2] != "text" and int(r[2][8:]) % 7 == 0 and int(r[2][8:]) < 50}
    assert shuffles(store.outgoing(asked)) == (1, True) and shuffles(store.incoming(asked.withColumnRenamed("s", "o"))) == (1, True)  # that of the asked side
    # the operators run on it as on any frame of triples
    cands = asked.withColumn("q", F.lit("q")).withColumn("alias", F.lit("None"))
    for op in (candidates.outgoing, candidates.incoming):
        assert sorted(map(tuple, op(cands, store.by_subject).collect())) == sorted(map(tuple, op(cands, g).collect()))


def test_label_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(2)
    words = ["hot", "hot", "hot", "red", "blue", "city", "of", "river", "north"]
    labels = [(f"http://x/{'a' * rng.randint(0, 5)}{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for i in range(900)]
    labels += [(labels[0][0], "hot hot spot"), (labels[0][0], "hot day")]
    frame = spark.createDataFrame(labels, "s string, label string")
    index = LabelIndex.write(frame, str(tmp_path / "ix"), 8, block=64)
    index = LabelIndex(spark, str(tmp_path / "ix"))
    queries = spark.createDataFrame([("hot",), ("red city",), ("River of north",), ("unknown",), ("hot unknown",), ("",), ("spot",)], "q string")
    want = candidates.text_match(queries, frame)
    rows = lambda df: sorted(map(tuple, df.select("q", "s", "label").collect()))
    assert rows(index.match(queries)) == rows(want)
    top = candidates.top_by_length(want.select("q", "s").distinct(), 50)
    assert sorted({(r.q, r.s) for r in index.match(queries, k=50, block=64).collect()}) == sorted(map(tuple, top.select("q", "s").collect()))
    blocks = spark.read.parquet(str(tmp_path / "ix/postings"))
    assert blocks.where("word = 'hot'").count() > 8 and blocks.where("block < 1 and word = 'hot'").count() == 1


@pytest.mark.parametrize("q", ["abc", "AB", "c", "xyz", "a b", "nothing here"])
def test_names_by_any_part(spark, q):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcxyz ") for _ in range(rng.randint(0, 12))).title() for _ in range(300)]
    tables = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate(names)], "table_id string, name string")
    got = catalog.search_names(tables, catalog.name_index(tables), spark.createDataFrame([(q,)], "q string"))
    assert sorted(r.table_id for r in got.collect()) == sorted(f"t{i}" for i, n in enumerate(names) if q.lower() in n.lower())


def test_pages_by_the_last_row(spark, tmp_path):
    rows = [(f"t{i:05}", f"2024-01-{i % 28 + 1:02}") for i in range(2000)]
    catalog.in_page_order(spark.createDataFrame(rows, "table_id string, pub_date string"), 8).write.parquet(str(tmp_path / "c"))
    tables, after, seen = spark.read.parquet(str(tmp_path / "c")), None, []
    for _ in range(3):
        page = catalog.page_after(tables, after, 300).collect()
        seen += [(r.pub_date, r.table_id) for r in page]
        after = seen[-1]
    assert seen == sorted((d, t) for t, d in rows)[:900]
    late = catalog.page_after(tables, ("2024-01-28", "t01900"), 50)
    assert "GreaterThanOrEqual(pub_date,2024-01-28)" in late._jdf.queryExecution().executedPlan().toString() and late.count() == 4


def test_table_of_one_row_group_is_dealt(spark, tmp_path):
    """A file of one row group is one task's; its rows are dealt to as many tasks as they fill, whatever the session's settings."""
    from cellsense.sources.stage import ROWS, dealt

    spark.range(3 * ROWS + 1).coalesce(1).write.parquet(f"{tmp_path}/t")
    got = dealt(spark.read.parquet(f"{tmp_path}/t"), "id")
    assert got.rdd.getNumPartitions() == 4 and got.distinct().count() == 3 * ROWS + 1
    assert dealt(spark.range(5), "id").rdd.getNumPartitions() == spark.range(5).rdd.getNumPartitions()


def test_triples_are_never_broadcast(spark, tmp_path):
    """Small files of triples can stand for large tables: what is sent to all tasks is what was counted."""
    rows = [(f"s{i}", p, o, k, None, None) for i in range(50) for p, o, k in (("label", f"Jane Doe{i}", "literal"), ("knows", f"s{i + 1}", "uri"))]
    spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string, o_lang string").write.parquet(f"{tmp_path}/kg")
    people = spark.createDataFrame([("j. doe7", "j", "doe7")], "q string, prefix string, surname string")
    got = candidates.person_subgraph(people, spark.read.parquet(f"{tmp_path}/kg"), "label", "redirect")
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    sent = [next(x for x in lines[i:] if "Scan" in x) for i, line in enumerate(lines) if "BroadcastExchange" in line]
    assert sent and not any("p#" in x for x in sent)
    assert {(r.s, r.p, r.o) for r in got.collect()} == {("s7", "label", "Jane Doe7"), ("s7", "knows", "s8"), ("s6", "knows", "s7")}


def test_any_word_gives_each_label_once(spark):
    labels = spark.createDataFrame([("a", "red blue"), ("a", "red blue"), ("b", "blue"), ("c", "green")], "s string, label string")
    queries = spark.createDataFrame([("Blue red",), ("Blue red",), ("red red",)], "q string")
    got = sorted(tuple(r) for r in candidates.text_match(queries, labels, any_word=True).collect())
    assert got == [("Blue red", "a", "red blue"), ("Blue red", "b", "blue"), ("red red", "a", "red blue")]


def test_pairs_are_dealt_by_their_number_and_scored_once_for_alike_rows(spark, tmp_path):
    """A block's pairs grow with its square, so do the tasks; rows of one text are one row of the scored table."""
    import pandas as pd

    from cellsense.plans import queries

    rows = [(i, ("red ring", "hot bolt")[i % 2], "B", "T", 1, 900.0) for i in range(1_000)]
    pd.DataFrame(rows, columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]).to_parquet(f"{tmp_path}/part.parquet")
    scored = queries.alike_pairs(spark, str(tmp_path), "p_name", lambda x, y: (x == y).cast("int"), "s").collect()
    assert len(scored) == 4 and sum(len(r["as"]) * len(r["bs"]) for r in scored) == 1_000_000
    got = queries.jaccard_pairs(spark, str(tmp_path))
    assert got.count() == 1_000 * 999 // 2 and got.where("j = 1").count() == 2 * 500 * 499 // 2
    top = {(r.a, r.b, r.edit) for r in queries.edit_distance_topk(spark, str(tmp_path)).where("a in (0, 995, 998, 999)").collect()}
    assert {(a, b) for a, b, _ in top} == {(0, 2), (0, 4), (0, 6), (995, 997), (995, 999), (995, 996), (998, 999)}
    plan = queries.winning_entity(spark, str(tmp_path)).where("row_idx in (700, 701)").collect()
    assert {(r.row_idx, r.entity) for r in plan} == {(700, 0), (701, 1)}


def test_parts_without_a_name_leave_no_near_part_out(spark, tmp_path):
    """A part without a name has no distance, so it comes after all parts that have one, as in the SQL."""
    import duckdb
    import pandas as pd

    from cellsense.plans import queries

    names = ["red ring", None, None, None, "red ring", "red bolt"]
    pd.DataFrame([(i, n, "B", "T", 1, 900.0) for i, n in enumerate(names)], columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]).to_parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet')")
    got = {(r.a, r.b, r.edit) for r in queries.edit_distance_topk(spark, str(tmp_path)).collect()}
    assert {x for x in got if x[0] == 0} == {(0, 4, 0.0), (0, 5, 0.5), (0, 1, None)}
    assert got == set(con.execute(queries.ORACLES["edit_distance_topk"]).fetchall())


def test_rows_of_one_csv_table_are_many_tasks_work(spark, tmp_path):
    """One table's rows are numbered, and made into cells, by as many tasks as they fill; none gets all of a table."""
    import pandas as pd

    from cellsense.plans import queries
    from cellsense.sources import tables
    from cellsense.sources.stage import ROWS

    n = 3 * (ROWS // 10) + 1
    pd.DataFrame({"conv_id": range(n), "turn": 0, "role": "user", "text": [f"w{i} x y" for i in range(n)]}).to_parquet(f"{tmp_path}/conversations.parquet")
    got = tables.mend_csv(queries.ragged_rows(spark, str(tmp_path))).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.min("row_idx"), F.max("row_idx")).collect()
    assert len(got) > 1 and sum(r.n for r in got) == 3 * (n - 1)
    assert queries.csv_mending(spark, str(tmp_path)).first()[1:] == (3, n - 1)
