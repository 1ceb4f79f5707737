import pytest
from pyspark.sql import functions as F

from cellsense.functions import text as X


@pytest.mark.parametrize(
    ("text", "want"),
    [("1 america", "erica"), ("1st street", "street"), ("Milan's (big) city", "milan city"), ("can't stop", "ca n stop"), ("http://example.com/a b", "http://example.com/ab"), ("New-York [x] 12.5", "new york 12.5"), ('a"b c"d', "a d"), ("left (open", "left"), ("", ""), ("日本", "")],
)
def test_clean(text, want):
    assert X.clean(text) == want


def test_tokens():
    assert X.tokenize_text("a@b.com #tag £5") == [("EMAIL", "a@b.com"), ("HASHTAG", "#tag"), ("CURRENCY", "£"), ("NUMBER", "5")]


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


def test_column_functions(spark):
    assert col(spark, "the big house", X.query_text) == '"big" AND "house"'
    assert col(spark, "a b", X.query_text) == '"a b"'
    assert col(spark, "", X.query_text) == ""
    assert col(spark, "one three seventeen fourteen", X.lookup_query) == "seventeen fourteen three"
    assert col(spark, "ab longest longer", X.or_query) == '"longest" OR "longer"'
    assert col(spark, "http://dbpedia.org/resource/New_York%21", X.entity_name) == "new york!"
    assert col(spark, "john fitzgerald", X.initial_name) == "j fitzgerald"
    assert col(spark, "My_Table_-_(a)#x", X.table_name_tokens) == ["my", "table", "a"]
    assert col(spark, "http://www.w3.org/2001/XMLSchema#int", X.short_label) == "xsd:int"
    assert col(spark, '"Rom"@de', X.literal_value) is None
    assert col(spark, '"Rome"@en', X.literal_value) == "Rome"
    assert col(spark, "cities", X.singular) == "city" and col(spark, "city", X.plural) == "cities"
    assert col(spark, "Ã©\\u0041\x07 ’x’", X.sanitize).endswith("A 'x'")
    assert col(spark, ["a", "b", "a"], X.bag, "array<string>") == {"a": 2, "b": 1}


def test_bag_of_a_long_text_takes_time_in_proportion(spark):
    """60,000 words, all but one distinct: work in proportion to their square would take many minutes."""
    import time

    text = spark.range(1).select(F.concat(F.lit("w7 "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")).alias("t"))
    start = time.monotonic()
    n, seven = text.select(X.bag(F.split("t", " ")).alias("b")).select(F.size("b"), F.col("b")["w7"]).first()
    assert (n, seven) == (60_000, 2)
    assert time.monotonic() - start < 60
