import pytest
from pyspark.sql import functions as F

from cellsense.functions.celltypes import ORDER, cell_type, is_credit_card, is_currency, is_float, is_integer, is_iso8601, is_person

CASES = [
    ("", "empty"), ("-", ""), ("12", "numeric"), ("-3.5", "numeric"), ("inf", "numeric"), ("1,234", "numeric"), ("1", "numeric"), ("1,234,567", "no_annotation"),
    ("1,234.5", "id"), ("1/2/2019", "id"), ("Yes", "boolean"), ("n", "boolean"), ("May 5", "date"), ("2019-01-05", "date"), ("2019-01-05T10:00:00Z", "date"),
    ("46.1368155, 9.61057690000007", "geo_coordinates"), ("x" * 81, "description"), ("35°56′51″N 75°45′12″E", "geo_coordinates"), ("a, b, c", "no_annotation"),
    ("AB12", "id"), ("USD", "id"), ("ASIA", "id"), ("5-LOW", "id"), ("#FFF", "id"), ("#ffaa00", "hex_color"), ("http://example.com/a", "url"), ("joe@example.com", "email"),
    ("12 main street", "address"), ("4111 1111 1111 1111", "address"), ("4111111111111111", "numeric"), ("192.168.0.1", "id"), ("192.168.100.200", "ip"),
    ("2001:db8::1", "ip"), ("photo.jpg", "image"), ("0-306-40615-2", "id"), ("978-0-306-40615-7", "isbn"), ("small ring", ""), ("lax", ""),
]


@pytest.mark.parametrize("exact", [False, True])
def test_types_of_fixtures(spark, exact):
    df = spark.createDataFrame(CASES, "v string, want string")
    wrong = df.withColumn("got", cell_type(F.col("v"), exact_dates=exact)).where("got <> want").collect()
    assert wrong == []


def test_airport_codes_are_a_parameter(spark):
    df = spark.createDataFrame([("lax",), ("view",)], "v string")
    got = df.select(cell_type(F.col("v"), F.array(F.lit("LAX"))).alias("t")).collect()
    assert [r.t for r in got] == ["iata", ""]


def test_rules_that_others_precede(spark):
    r = spark.createDataFrame([("4111 1111 1111 1111", "EUR", "2019-01-05T10:00:00Z")], "a string, b string, c string").select(is_credit_card(F.col("a")).alias("a"), is_currency(F.col("b")).alias("b"), is_iso8601(F.col("c")).alias("c")).first()
    assert r == (True, True, True)


UNITS = [".a", "_1", "1_", "A.", "a@", "@a", "1-", '"', '\\"', "1", "a", " ", "x.y@", "1 a ", "12 b st", ":", "1:", "#f", ",", "1,", "°", ".png", "[", "2019-", "-"]


def test_long_texts_end_no_task(spark):
    """A megabyte of repeated units through every predicate."""
    rows = [(i, head + (u * (1_000_000 // len(u) + 1))[:1_000_000] + tail) for i, (u, head, tail) in enumerate((u, h, t) for u in UNITS for h, t in (("", ""), ("a", "@b"), ('"', '"@b.c'), ("1", "")))]
    df = spark.createDataFrame(rows, "i int, v string").repartition(32)
    tests = {k: f(F.col("v")) for k, f in ORDER} | {"person": is_person(F.col("v")), "float": is_float(F.col("v")), "integer": is_integer(F.col("v")), "type": cell_type(F.col("v"))}
    got = df.select("i", *[t.alias(k) for k, t in tests.items()]).collect()
    assert len(got) == len(rows) and all(r.description and r.type in ("numeric", "description") for r in got)
    assert {rows[r.i][1][:4] for r in got if r.numeric} == {"1111", "1   ", "1_1_"}


def test_long_lines_of_triples_are_read(spark):
    from cellsense.sources import triples

    text = "é \\" + '"' + "x" * 500_000 + "\\n"
    lines = spark.createDataFrame([(f'<http://a> <http://p> "{text * 2}"@en .',), ("<http://a> <http://p> \"" + "\\\\" * 500_000 + "\" .",), ("<http://a> " * 100_000,)], "value string")
    got = triples.parse_ntriples(lines).collect()
    assert sorted(len(r.o) for r in got) == [500_000, 2 * (500_000 + 4)]
