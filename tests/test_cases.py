"""Rules against literal answers: what a rule gives for fixed inputs, whatever pattern the code uses."""

import datetime

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from cellsense.functions import celltypes as T
from cellsense.functions import similarity as S
from cellsense.functions import text as X
from cellsense.operators import prepare

#: What dates leave open is taken from this day.
_DAY = datetime.date(2001, 2, 2)
CASES = {}


def cases(name, rows, f):
    CASES[name] = (rows, f)


def _bags(v: Column) -> Column:
    b = X.bags(v, F.lit("rome"), F.lit(""))
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e.key, e.value)), ",")
    return F.concat_ws("|", shown(b.cell), shown(b.entity), shown(b.abstract))


def _row_context(v: Column) -> Column:
    part = [F.split(p, " ") for p in (F.split(v, r"\|")[0], F.split(v, r"\|")[1], F.split(v, r"\|")[2])]
    return S.row_context(*part, (X.singular, X.plural))


def yes_no(yes: list[str], no: list[str]) -> list[tuple[str, str]]:
    return [(v, "true") for v in yes] + [(v, "false") for v in no]


cases("types_of_cells", [
    ("", "empty"), ("-", ""), ("12", "numeric"), ("-3.5", "numeric"), ("inf", "numeric"), ("1,234", "numeric"), ("1,234,567", "no_annotation"), ("1_000", "numeric"), ("1e5", "numeric"),
    ("1,234.5", "id"), ("1/2/2019", "id"), ("Yes", "boolean"), ("n", "boolean"), ("May 5", "date"), ("2019-01-05", "date"), ("2019-01-05T10:00:00Z", "date"),
    ("46.1368155, 9.61057690000007", "geo_coordinates"), ("x" * 81, "description"), ("35°56′51″N 75°45′12″E", "geo_coordinates"), ("a, b, c", "no_annotation"),
    ("AB12", "id"), ("USD", "id"), ("ASIA", "id"), ("5-LOW", "id"), ("#FFF", "id"), ("#ffaa00", "hex_color"), ("http://example.com/a", "url"), ("joe@example.com", "email"),
    ("12 main street", "address"), ("4111 1111 1111 1111", "address"), ("4111111111111111", "numeric"), ("192.168.0.1", "id"), ("192.168.100.200", "ip"),
    ("2001:db8::1", "ip"), ("photo.jpg", "image"), ("0-306-40615-2", "id"), ("978-0-306-40615-7", "isbn"), ("small ring", ""), ("lax", ""),
], T.cell_type)
cases("numeric_cases", yes_no(["0", " 7 ", "+1.", ".5", "-.5e-3", "1,5", "1_0.0_1e1_0", "Infinity", "-inf", "007"], ["", "nan", "NaN", ".", "1_", "_1", "1__0", "1_.5", "1._5", "1e", "e5", "1.2,3", "0x10", "1 2", "--1"]), T.is_numeric)
cases("geo_cases", yes_no(["0,0", "-90.0, +180", "45.5,-122.25", "1°2'3''s 4°5'6''w", "35°56′51″n,,75°45′12″e", "at:\n45,45"], ["91,0", "45,181", "45;45", "35°56′51″N", "x 45,45"]), T.is_geo)
cases("email_cases", yes_no(["joe@example.com", "see J.O.E+x@a-b.co.uk now", '"joe smith"@x.org' .replace(" ", ""), '"a\\"b"@x.org', "joe@[10.0.0.1]", "..a@b.c"], ["joe@example", "@example.com", "joe@.com", "joe@-a.com", "joe at example.com", "joe@[300.0.0.1]", '"@x.org']), T.is_email)
cases("ip_cases", yes_no(["1.2.3.4", "255.255.255.255", "::", "::1", "2001:DB8::1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4"], ["256.1.1.1", "1.2.3", "01.2.3.4", "1::2::3", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.400", "12345::"]), T.is_ip)
cases("address_cases", yes_no(["12 main street", "at 5 Elm Ave", "3 Oak Dr.", "1 Lake Lane", "10 downing st", "12 ab 7", "3\\4"], ["main street", "street 12", "12street", "12 main road", "12 ab"]), T.is_address)
cases("isbn_cases", yes_no(["0-306-40615-2", "0306406152", "080442957X", "0 8044 2957 x", "978-0-306-40615-7", "9791034304097"], ["0-306-40615-3", "978-0-306-40615-8", "97803064061", "977-0-306-40615-7", "X306406152", "", "isbn 0306406152"]), T.is_isbn)
cases("airport_cases", yes_no(["lax", "LAX", "lax jfk", "lax/jfk", "jfk-lax", "klax", "a lax"], ["la", "laxx", "los", "lax airport", "lax jfk sfo"]), lambda v: T.is_airport(v, F.array(*[F.lit(c) for c in ("LAX", "JFK", "KLAX")])))
cases("date_cases", yes_no(["2019-01-05", "5-1-2019", "31-12-19", "2019-1-5 10:30", "2019-01-05T10:00:00.5+02:00", "may", "Dec 2001", "SEPTEMBER"], ["2019-13-05", "2019-01-32", "1-2-3-4", "monday", "2019/01/05", "2019-01", "mayor 5"]), T.is_date)
cases("person_cases", yes_no(["J. Smith", "j.smith", "J. R. R. Tolkien", "A.B."], ["Smith J.", "J Smith", "Jr. Smith", "J. ", "1. x", ""]), S.is_person)
cases("float_cases", yes_no(["1", "1.5", "nan", "inf", "1_0", " 2e3 "], ["1,5", "a", "", "1_"]), T.is_float)
cases("integer_cases", yes_no(["1", "-20", "1_000", " 7 "], ["1.0", "", "1,000", "_1", "1e3"]), T.is_integer)
cases("image_cases", yes_no(["a.png", "x/y.JPG", "b.svg?x=1", "c.tiff"], ["png", "a.txt", "a.png.txt", ""]), T.is_image)
cases("iso8601_cases", yes_no(["2019-01-05T10:00:00Z", "2019-01-05T10:00:00", "2019-01-05T10:00:00.123+01:00", "-12019-01-05T23:59:59Z"], ["2019-01-05", "2019-1-5T10:00:00", "2019-01-05T24:00:00", "2019-01-05 10:00:00"]), T.is_iso8601)
cases("url_cases", yes_no(["http://example.com", "see HTTPS://www.a-b.org/x?y", "http://a.b.museum"], ["example.com", "ftp://example.com", "http://localhost", "http://x.c"]), T.is_url)
cases("color_cases", yes_no(["#fff", "#FFAA00"], ["fff", "#ffff", "#ggg", "#fffffff"]), T.is_hex_color)
cases("card_cases", yes_no(["4111111111111111", "4111 1111\t1111 1111", "0", "18"], ["4111111111111112", "", "4111-1111", "a", "1"]), T.is_credit_card)

joined = lambda c: F.array_join(F.transform(c, lambda t: F.concat_ws(":", t.tag, t.value)), " ")
cases("token_cases", [
    ("a@b.com #tag £5", "EMAIL:a@b.com HASHTAG:#tag CURRENCY:£ NUMBER:5"), ("see http://x.com/a?b=1", "WORD:see URL:http://x.com/a?b=1"), ('say "hi you" now', 'WORD:say QUOTED_PHRASE:"hi you" WORD:now'),
    ("@joe 3.5 1/2", "MENTION:@joe NUMBER:3.5 NUMBER:1/2"), ("21st 3rd", "ORDINAL:21st ORDINAL:3rd"), ("can't won't", "WORD:ca WORD:n't WORD:wo WORD:n't"), ("dog's dogs'", "WORD:dog WORD:'s WORD:dogs WORD:'"),
    ("o'neil", "WORD:o PUNCTUATION:' WORD:neil"), ("(x)! a+b", "PUNCTUATION:( WORD:x PUNCTUATION:) PUNCTUATION:! WORD:a SYMBOL:+ WORD:b"), ("日本 x", "ALIEN:日本 WORD:x"), ("", ""),
], lambda v: joined(X.tokenize(v)))
cases("clean_cases", [
    ("1st street", "street"), ("Milan's (big) city", "milan city"), ("can't stop", "ca n stop"), ("http://example.com/a b", "http://example.com/ab"), ("New-York [x] 12.5", "new york 12.5"),
    ('a"b c"d', "a d"), ("left (open", "left"), ("", ""), ("日本", ""), ("Brand#13", "brand 13"),
], X.clean_text)
cases("sanitize_cases", [("a\x07b", "ab"), ("it’s “so”…", "it's \"so\"..."), ("café", "cafe"), ("cafÃ©", "cafe"), ("A &amp; B", "A & B"), ("x\\u0041\\x42", "xAB"), ("tab\\tend", "tab\tend"), ("straße", "strasse")], X.sanitize)
cases("singular_cases", [("cities", "city"), ("boxes", "box"), ("churches", "church"), ("dogs", "dog"), ("bus", "bus"), ("glass", "glass"), ("men", "man"), ("children", "child"), ("days", "day")], X.singular)
cases("plural_cases", [("city", "cities"), ("box", "boxes"), ("church", "churches"), ("dog", "dogs"), ("day", "days"), ("man", "men"), ("foot", "feet")], X.plural)
cases("uri_bag_cases", [
    ("http://dbpedia.org/resource/New_York|Big Apple", "new york big apple"), ("http://other.org/x|plain", "plain"), ("http://dbpedia.org/resource/Milan|http://dbpedia.org/ontology/x", "milan"), ("a-b", "a b"),
], lambda v: F.array_join(X.context_bag(F.split(v, r"\|")), " "))
cases("local_name_cases", [("http://a/b|http://a/c/d", "b d"), ("x", "x"), ("http://a/", "")], lambda v: F.array_join(X.local_names(F.split(v, r"\|")), " "))
cases("label_cases", [("http://www.w3.org/2001/XMLSchema#int", "xsd:int"), ("http://a/b/C", "C"), ("x", "x")], X.short_label)
cases("entity_name_cases", [("http://dbpedia.org/resource/New_York%21", "new york!"), ("http://dbpedia.org/resource/A+B", "a+b"), ("http://dbpedia.org/resource/100%", "100%"), ("http://dbpedia.org/resource/Caf%C3%A9", "café")], X.entity_name)
cases("table_name_cases", [("My_Table_-_(a)#x", "my table a"), ("List_of_Caf%C3%A9s", "list of cafes"), ("one", "one"), ("#1_hits", "#1 hits")], lambda v: F.array_join(X.table_name_tokens(v), " "))
cases("literal_cases", [('"Rom"@de', None), ('"Rome"@en', "Rome"), ('"a "b" c"@en', 'a "b" c'), ('"5"^^<http://www.w3.org/2001/XMLSchema#int>', "5"), ('"plain"', "plain"), ("http://dbpedia.org/resource/Rome", "rome"), ("bare", "bare")], X.literal_value)
cases("query_text_cases", [("the big house", '"big" AND "house"'), ("a b", '"a b"'), ("", ""), ("of rome", '"rome"'), ("the who", '"the who"')], X.query_text)
cases("lookup_query_cases", [("one three seventeen fourteen", "seventeen fourteen three"), ("a b c", "a b c"), ("", ""), ("aa bb cc dd", "aa bb cc")], X.lookup_query)
cases("or_query_cases", [("ab longest longer", '"longest" OR "longer"'), ("same same four", '"same" OR "four"'), ("a b", None), ("", None)], X.or_query)
cases("three_bag_cases", [("a b a", "a=2,b=1|rome=1|"), ("", "|rome=1|"), ("x", "x=1|rome=1|")], lambda v: _bags(v))
cases("number_cases", [("1,234.5", "1234.5"), ("1.234,5", "1234.5"), ("1,234,567", "1234567"), ("1,5", "1.5"), ("1,234", "1234"), ("1.234.567", "1234567"), ("12", "12")], prepare.number_of)
cases("conversion_cases", [("2019-01-05", "2019-05-01"), ("5-1-2019", "2019-05-01"), ("January 5, 2019", "2019-05-01"), ("5 Jan 2019 10:00", "2019-05-01"), ("May 2001", "2001-02-05"), ("may be", "may be")], lambda v: prepare.convert(v, v, F.lit("date"), _DAY))
cases("typed_conversion_cases", [("1,234", "1234"), ("12.5", "12.5"), ("1,234,567", "1234567")], lambda v: prepare.convert(v, v, F.lit("numeric")))
cases("xsd_cases", [("numeric", "float,integer,double"), ("url", "anyURI"), ("boolean", "boolean"), ("date", "date"), ("id", "string"), ("", "string")], lambda v: F.array_join(F.transform(T.xsd_types(v), lambda x: x.label), ","))
cases("person_similarity_cases", [("j smith|john smith", "1.0"), ("j smith|jane smith", "1.0"), ("j smyth|john smith", "0.857143"), ("smith|john smith", "0.714286")], lambda v: F.round(1 - S.person(F.split(v, r"\|")[0], F.split(v, r"\|")[1]), 6))
cases("row_context_cases", [("city river|cities|milan river", "2"), ("cities dog city|city|dog", "3"), ("x|y|z", "0")], lambda v: _row_context(v))


@pytest.mark.parametrize("name", list(CASES))
def test_rule_gives_its_answers(spark, name):
    rows, f = CASES[name]
    got = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "i int, v string").select("i", f(F.col("v")).cast("string").alias("got")).orderBy("i").collect()
    assert [(v, r.got) for (v, _), r in zip(rows, got, strict=True)] == rows
