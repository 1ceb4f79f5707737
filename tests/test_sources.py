import json
import pathlib
import xml.etree.ElementTree

import pytest
from pyspark.sql import functions as F

from cellsense.operators import export
from cellsense.sources import lexicons, tables, triples
from cellsense.streaming.ingest import stream_json_tables, type_counts


def test_json_first_record_names_the_columns(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1, "y": "b"}, {"x": 2, "z": 3}]))
    (tmp_path / "bad.json").write_text("{")
    got = sorted(tuple(r) for r in tables.read_json_tables(spark, str(tmp_path)).collect())
    assert got == [("a", 0, 0, "x", "1"), ("a", 0, 1, "y", "b"), ("a", 1, 0, "x", "2"), ("a", 1, 1, "y", "")]


def test_ragged_csv_is_mended(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,,a\n1,2\n\n"x, \\"y\\"",5,6\n7,8,9\n')
    cells = tables.mend_csv(tables.read_csv_strict(spark, str(tmp_path)))
    rows = {r.row_idx: list(r.row) for r in tables.to_rows(cells).collect()}
    assert rows == {0: ["1", "2", ""], 1: ["x, 'y'", "5", "6"], 2: ["7", "8", "9"]}
    assert tables.table_shape(cells).first().header == ["a", "NO-HEADER1", "a 2"]


def test_single_header_and_short_header(spark):
    mk = lambda rows: spark.createDataFrame([("t", i, r) for i, r in enumerate(rows)], "table_id string, row_idx long, fields array<string>")
    assert tables.table_shape(tables.mend_csv(mk([["title"], ["a", "b"], ["1", "2"]]))).first()[1:] == (["a", "b"], 2, 1)
    assert tables.table_shape(tables.mend_csv(mk([["a", "b"], ["1", "2", "3"], ["4", "5", "6"]]))).first()[1:] == (["a", "b", "NO-HEADER2"], 3, 3)


def test_directory_is_converted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text("a,b\n1,é\n")
    assert [tuple(r) for r in tables.convert_directory(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()] == [("t", 1, True, None)]


def test_turtle_lines_and_exports_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("http://a", "http://x/p", "http://b", "uri", None), ("http://a", "http://x/q", 'say "hi"', "literal", None)], "s string, p string, o string, o_kind string, o_datatype string")
    export.write_rdf(t, str(tmp_path / "nt"))
    back = triples.read_ntriples(spark, str(tmp_path / "nt"))
    assert sorted((r.p, r.o, r.o_kind) for r in back.collect()) == [("http://x/p", "http://b", "uri"), ("http://x/q", 'say "hi"', "literal")]
    assert json.loads(export.json_ld(t).first().value)["http://x/q"] == [{"@value": 'say "hi"'}]
    assert export.turtle(t).count() == 1


def test_every_file_of_an_export_is_a_document(spark, tmp_path):
    rows = [(f"http://a/{i}", f"http://x#p{i % 3}", f"http://b?x=1&y={i}" if i % 2 else 'a <b> & "c"\r\n\td\x01é', "uri" if i % 2 else "literal", None if i % 2 else "http://www.w3.org/2001/XMLSchema#string") for i in range(40)]
    t = spark.createDataFrame([*rows, ("_:n#1", "http://x#p0", "_:m#2", "blank", None)], "s string, p string, o string, o_kind string, o_datatype string")
    rdf, seen = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", 0
    export.write_rdf(t.repartition(3), str(tmp_path / "xml"), "xml")
    for part in (tmp_path / "xml").glob("part*"):
        root = xml.etree.ElementTree.fromstring(part.read_bytes())
        assert root.tag == rdf + "RDF"
        for node in root:
            seen += len(node)
            if int((node.get(rdf + "about") or "/0").rsplit("/", 1)[1]) % 2 == 0 and node.get(rdf + "about"):
                assert node[0].text == 'a <b> & "c"\r\n\td\ufffdé'
    assert seen == 41
    export.write_rdf(t.repartition(3), str(tmp_path / "json"), "json-ld")
    nodes = [n for part in (tmp_path / "json").glob("part*") for n in json.loads(part.read_text())]
    assert len(nodes) == 41
    for fmt, read in (("nt", triples.read_ntriples), ("turtle", triples.read_turtle)):
        export.write_rdf(t, str(tmp_path / fmt), fmt)
        back = {(r.s, r.p, r.o, r.o_kind, r.o_datatype) for r in read(spark, str(tmp_path / fmt) + "/part*").where("o_kind <> 'blank'").collect()}
        assert back == set(rows)
    assert triples.unread_lines(spark, str(tmp_path / "nt")).isEmpty()
    bad = spark.createDataFrame([("http://a", "http://x/1", "b", "literal", None)], t.schema)
    with pytest.raises(Exception, match="no XML name"):
        export.rdf_xml(bad).collect()


def test_turtle_with_lists_and_blank_nodes(spark, tmp_path):
    (tmp_path / "g.ttl").write_text(
        '@prefix ex: <http://ex.org/> .\nPREFIX : <http://d/>\n@base <http://base/x/> .\n# a comment\n'
        'ex:a a ex:B ; ex:p 1, 2.5, true, -1e3 ; ex:q "x \\"y\\" \\u00e9"@en-GB, "5"^^ex:int ;\n .\n_:b ex:p [ ex:z ( 1 <c> ) ], [] .\n:x ex:long """a "q"\nb""", \'s\' .\n[ ex:p <../z> ] ex:q ex:a.b .\n'
    )
    got = {tuple(r) for r in triples.read_turtle(spark, str(tmp_path)).collect()}
    ex, xsd = "http://ex.org/", "http://www.w3.org/2001/XMLSchema#"
    assert {r[2:] for r in got if r[0] == ex + "a"} == {
        (ex + "B", "uri", None, None), ("1", "literal", xsd + "integer", None), ("2.5", "literal", xsd + "decimal", None), ("true", "literal", xsd + "boolean", None),
        ("-1e3", "literal", xsd + "double", None), ('x "y" é', "literal", None, "en-GB"), ("5", "literal", ex + "int", None),
    }
    assert {r[2] for r in got if r[0] == "http://d/x"} == {'a "q"\nb', "s"}
    assert sum(r[1].endswith("#first") for r in got) == 2 and ("http://base/x/c", "uri") in {r[2:4] for r in got} and ("http://base/z", "uri") in {r[2:4] for r in got}
    assert (ex + "q", ex + "a.b") in {r[1:3] for r in got} and len({r[0] for r in got if r[0].startswith("_:")}) == 5
    (tmp_path / "bad.ttl").write_text("<a> <b> <c> . <d> nothing")
    with pytest.raises(Exception, match="bad.ttl"):
        triples.read_turtle(spark, str(tmp_path)).collect()
    assert triples.read_turtle(spark, str(tmp_path / "bad.ttl"), strict=False).count() == 1


def test_info_tables_and_targets(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({
        "table_name": "t", "subject_col": 0, "subject_cols_paper": [0, 0, 1, 0], "ne_cols": [{"index": 0, "header": "a", "score": {"uc": 1.0, "finalScore": 2.5}, "type": "City", "winning_concepts": {"City": 3}}],
        "lit_cols": [{"index": 1, "header": "b", "regex_type": ["numeric"], "data_type": [{"label": "float", "uri": "http://x"}], "type_freq_table": [{"name": "numeric", "occurrences": 3, "rate": 1.0}]}], "no_ann_cols": [{"index": 2, "header": "c", "type": ""}],
    }))
    r = tables.read_info_tables(spark, str(tmp_path / "i.json")).first()
    assert r.ne_cols[0].score.finalScore == 2.5 and r.ne_cols[0].winning_concepts == {"City": 3.0} and r.lit_cols[0].data_type[0].label == "float" and r.lit_cols[0].regex_type == ["numeric"]
    (tmp_path / "cea.csv").write_text('"t", "1", "7"\n')
    assert tuple(tables.read_targets(spark, str(tmp_path / "cea.csv"), "cea").first()) == ("t", 1, 7)
    (tmp_path / "old.csv").write_text('"t", "1", "7", "http://x"\n')
    assert tuple(tables.read_export(spark, str(tmp_path / "old.csv")).first()) == ("t", 1, 7, "http://x")


def test_corpus_assets_and_unread_files(spark, tmp_path):
    (tmp_path / "r4" / "converted").mkdir(parents=True)
    (tmp_path / "r4" / "converted" / "a.json").write_text(json.dumps([{"x": 1}]))
    (tmp_path / "r4" / "converted" / "b.json").write_text("{")
    got = tables.read_corpus(spark, str(tmp_path), "r4").collect()
    assert [(r.table_id, r.gs_type) for r in got] == [("a", "r4")]
    path = str(tmp_path / "r4" / "converted")
    assert [r.table_id for r in tables.unread_json_tables(spark, path).collect()] == ["b"] and [r.name for r in tables.list_files(spark, path).collect()] == ["a.json", "b.json"]


def test_log_is_kept_by_run(spark, tmp_path):
    entry = lambda body, group, task: spark.range(1).select(export.log_record("x", F.lit(body), F.lit("t"), F.lit("name"), group, task).alias("log"))
    for body, group, task in (("one", "errors", "r1"), ("two", "errors", "r1"), ("no", "warnings", "r1"), ("", "errors", "r1"), ("three", "errors", "r2")):
        export.write_log(entry(body, group, task), str(tmp_path / "log"))
    got = {r.task_id: [e.body for e in r.errors] for r in export.read_log(spark, str(tmp_path / "log")).collect()}
    assert got == {"r1": ["one", "two"], "r2": ["three"]}
    assert spark.range(1).select(export.lookup_log(F.lit("q"), F.lit("timeout"), F.lit("t")).alias("l")).first().l.type == "lookup"


def test_append_and_routed_exports(spark, tmp_path):
    cols = spark.createDataFrame([("t", 0, "NE", {"City": 2}, "")], "table_id string, col_idx int, col_class string, winning_concepts map<string,int>, rel string")
    names = spark.createDataFrame([("t", "r4"), ("u", "r3")], "table_id string, gs_type string")
    to = export.export("CTA", "csv", str(tmp_path), {"columns": cols, "tables": names}, tag="r4")
    assert '"t","0","http://dbpedia.org/ontology/City"' in "".join(p.read_text() for p in pathlib.Path(to).glob("part*"))
    rows = spark.createDataFrame([("a", 1)], "x string, y int")
    for _ in range(2):
        export.write_csv(rows, str(tmp_path / "c"), append=True)
    assert spark.read.csv(str(tmp_path / "c")).count() == 2


def test_row_numbers_of_many_ranges(spark):
    df = spark.range(5000).selectExpr("if(id % 5 = 0, 'b', 'a') as t", "5000 - id as k").repartition(7)
    got = tables.row_numbers(df, "t", "k").collect()
    for t in "ab":
        own = sorted((r.k, r.row_idx) for r in got if r.t == t)
        assert [i for _, i in own] == list(range(len(own)))


@pytest.mark.parametrize("parts,coalesce", [(4, "true"), (8, "false"), (64, "false"), (64, "true")])
def test_row_numbers_of_many_rows_with_a_payload(spark, parts, coalesce):
    n = 500_000
    df = spark.range(n).selectExpr("if(id % 3 = 0, 'b', if(id % 1000 = 1, null, 'a')) as t", f"{n} - id as k", "repeat(cast(id as string), 12) as x", "array(id, id) as y").repartition(7)
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for c, v in zip(old, (str(parts), coalesce), strict=True):
            spark.conf.set(c, v)
        got = tables.row_numbers(df, "t", "k")
        got.createOrReplaceTempView("numbered")
        wrong = spark.sql("select count(*) n, count_if(row_idx <> want) wrong, count(x) xs from (select *, row_number() over (partition by t order by k) - 1 as want from numbered)").first()
        assert tuple(wrong) == (n, 0, n)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_csv_sink_quotes_all(spark, tmp_path):
    export.write_csv(spark.createDataFrame([("a", 1)], "x string, y int"), str(tmp_path / "c"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "c").glob("part*"))
    assert text == b'"a","1"\r\n'


def test_lexicons(spark, tmp_path):
    (tmp_path / "abbr.txt").write_text("st.*street\nca. circa\nst.*saint\n")
    assert [tuple(r) for r in lexicons.read_abbreviations(spark, str(tmp_path / "abbr.txt")).collect()] == [("st.", "street")]
    (tmp_path / "u.txt").write_text('"length"|"inch"|"in","inches"|"0.0254"\n')
    u = lexicons.read_units(spark, str(tmp_path / "u.txt")).first()
    assert (u.unit, u.abbrs, u["mul"], u["add"]) == ("inch", ["in", "inches"], 0.0254, 0.0)


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text(json.dumps([{"x": "1"}, {"x": "rome"}]))
    q = type_counts(stream_json_tables(spark, str(tmp_path / "s"))).writeStream.outputMode("complete").format("memory").queryName("types").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert {(r.cell_type, r.n) for r in spark.table("types").collect()} == {("numeric", 1), ("", 1)}
    finally:
        q.stop()


def test_subject_first_and_log(spark):
    c = spark.createDataFrame([("t", 0, 0, "a"), ("t", 0, 1, "b")], "table_id string, row_idx long, col_idx int, value string")
    assert export.subject_first(c, spark.createDataFrame([("t", 1)], "table_id string, subject_col int")).first().row == ["b", "a"]
    assert spark.range(1).select(export.log_record("error", F.lit("x"), F.lit("t")).alias("l")).first().l.type == "error"


def test_records_of_a_json_table_are_handed_on_in_chunks(monkeypatch):
    """A large table is never one frame; what isn't an array to its end gives no rows."""
    import pandas as pd

    monkeypatch.setattr(tables, "CHUNK", 4)
    texts = pd.DataFrame({"table_id": ["a", "b", "c", "d"], "value": [json.dumps([{"x": i, "y": None} for i in range(5)]), '[{"x": 1}, {"x"', "[]", '[{"x": 1}] [']})
    got = list(tables._json_cells(iter([texts])))
    assert max(map(len, got)) <= 5 and sum(len(f) for f in got) == 10
    assert {(r.row_idx, r.value_raw) for f in got for r in f.itertuples() if r.header == "x"} == {(i, str(i)) for i in range(5)}
