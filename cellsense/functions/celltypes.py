"""Semantic types of cells: one ordered CASE over predicates; the first that holds names the type."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import CURRENCIES, IMAGE_EXTENSIONS, MONTHS

#: Patterns (fixed values). None repeats a group without a bound or by backtracking, and none tries a run of characters again from
#: each of its places: the matcher's stack and time stay in line with the text's length.
NUMBER = r"^\s*[+-]?(([0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)([eE][+-]?[0-9][0-9_]*)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
INTEGER = r"^\s*[+-]?[0-9][0-9_]*\s*$"
#: An underscore that doesn't stand between two digits.
LOOSE_UNDERSCORE = r"(^|[^0-9])_|_([^0-9]|$)"
LAT_LON = r"(?im)^[-+]?([1-8]?\d(\.\d+)?|90(\.0+)?),\s*[-+]?(180(\.0+)?|((1[0-7]\d)|([1-9]?\d))(\.\d+)?)$"
DEGREES = r"(?im)^[0-9]+°[0-9]+(′|')[0-9]+(″|''|′′)\s*[N|S](,)*\s*[0-9]+°[0-9]+(′|')[0-9]+(″|''|′′)\s*[W,E]"
STREET = r"(?<!\d)\d++\s++\w++\s++(?:st(?:\.|reet)?|ave(?:nue)?|lane|dr(?:\.|ive)?)"
HOUSE = r"^[\d]+[A-z\s,]+[\d]"
HEX_COLOR = r"^#(?:[0-9a-fA-F]{3}){1,2}$"
URL = r"https?:\/\/(www\.)?[-a-zA-Z0-9@:%._\+~#=]{2,256}\.[a-z]{2,6}\b"
OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: An address is looked for, not matched as a whole: the last character of its local part (or a quoted one from its last quotation mark
#: on: what is right from an earlier, escaped one is right from there), the at-sign, and the domain up
#: to the first letter after its first full stop (or one in brackets) tell it.
LOCAL = r"(?:[a-z0-9!#$%&'*+/=?^_`{|}~-]|\"(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21\x23-\x5b\x5d-\x7f]++|\\[\x01-\x09\x0b\x0c\x0e-\x21\x23-\x7f])*+\")"
DOMAIN = rf"(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.[a-z0-9]|\[(?:{OCTET}\.){{3}}(?:{OCTET}|[a-z0-9-]*[a-z0-9]:[\x01-\x08\x0b\x0c\x0e-\x1f\x21-\x7f]+)\])"
EMAIL = f"{LOCAL}@{DOMAIN}"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
IPV6 = r"^(([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|([0-9a-f]{1,4}:){1,7}:|([0-9a-f]{1,4}:){1,6}:[0-9a-f]{1,4}|([0-9a-f]{1,4}:){1,5}(:[0-9a-f]{1,4}){1,2}|([0-9a-f]{1,4}:){1,4}(:[0-9a-f]{1,4}){1,3}|([0-9a-f]{1,4}:){1,3}(:[0-9a-f]{1,4}){1,4}|([0-9a-f]{1,4}:){1,2}(:[0-9a-f]{1,4}){1,5}|[0-9a-f]{1,4}:(:[0-9a-f]{1,4}){1,6}|:((:[0-9a-f]{1,4}){1,7}|:))$"
ISO8601 = r"^(-?(?:[1-9][0-9]*)?[0-9]{4})-(1[0-2]|0[1-9])-(3[01]|0[1-9]|[12][0-9])T(2[0-3]|[01][0-9]):([0-5][0-9]):([0-5][0-9])(\.[0-9]+)?(Z|[+-](?:2[0-3]|[01][0-9]):[0-5][0-9])?$"
DASHED = r"[0-9]+-[0-9]+-[0-9]+"
#: Calendar dates that parse: year first, or day and month first; then at most a time and a zone.
PARSED_DATE = r"^\s*(\d{4}-(0?[1-9]|1[0-2])-(0?[1-9]|[12]\d|3[01])|(0?[1-9]|[12]\d|3[01])-(0?[1-9]|1[0-2])-(\d{4}|\d{2})|(0?[1-9]|1[0-2])-(1[3-9]|2\d|3[01])-(\d{4}|\d{2}))([T ]\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?)?\s*(Z|[+-]\d{2}:?\d{2}|[AaPp][Mm])?\s*$"
IMAGE = r"(?i)\.(" + "|".join(IMAGE_EXTENSIONS) + r")([?#].*)?$"
#: An initial with a full stop, then a name or a further initial.
PERSON = r"(?i)^[A-Z]\.\s*\w"
#: An IPv4 address in the place of the last two groups of an IPv6 address.
EMBEDDED = rf":{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def is_empty(v: Column) -> Column:
    return F.length(v) == 0


def _matches_number(v: Column, pattern: str) -> Column:
    return v.rlike(pattern) & ~(v.contains("_") & v.rlike(LOOSE_UNDERSCORE))


def is_numeric(v: Column) -> Column:
    """What a float parser takes, with either comma or full stop."""
    return (F.lower(v) != "nan") & ~(v.contains(".") & v.contains(",")) & _matches_number(F.replace(v, F.lit(","), F.lit(".")), NUMBER)


def is_boolean(v: Column) -> Column:
    return F.lower(v).isin("y", "yes", "n", "no", "1", "0", "true", "false")


def _dashed(v: Column) -> Column:
    return v.rlike(f"(?<![0-9]){DASHED}") & (F.length(v) - F.length(F.regexp_extract(v, f"({DASHED})", 1)) <= 19)


def is_date(v: Column) -> Column:
    """A month as the first word, or a dashed date with at most 19 other characters that parses."""
    return F.substring_index(F.lower(v), " ", 1).isin(*MONTHS) | (v.rlike(PARSED_DATE) & _dashed(v) & ~is_numeric(v))


#: No date that the general parser reads is longer.
LONGEST_DATE = 200


@F.pandas_udf(T.BooleanType())
def parses_as_date(s: pd.Series) -> pd.Series:
    """Exact parse by the general date parser, where the shared pattern is too narrow."""
    from dateutil import parser

    def one(x):
        try:
            parser.parse(x)
            return True
        except (ValueError, OverflowError, TypeError):
            return False

    return s.map(one)


def is_date_exact(v: Column) -> Column:
    return F.substring_index(F.lower(v), " ", 1).isin(*MONTHS) | ((F.length(v) <= LONGEST_DATE) & _dashed(v) & ~is_numeric(v) & parses_as_date(v))


def is_geo(v: Column) -> Column:
    return v.rlike(LAT_LON) | v.rlike(DEGREES)


def is_description(v: Column) -> Column:
    return F.length(v) > 80


def is_no_annotation(v: Column) -> Column:
    return F.length(v) - F.length(F.replace(v, F.lit(","), F.lit(""))) > 1


def bare(v: Column) -> Column:
    """Words and single spaces of a short cell; null for one of 15 characters or more, which no rule on it takes."""
    return F.when(F.length(v) < 15, _bare(v))


def _bare(v: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(v, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def is_id(v: Column, x: Column | None = None) -> Column:
    """Short codes: see each branch. ``x``: the cell's ``bare`` form, where it is at hand."""
    x = bare(v) if x is None else x
    letters, digits = F.length(F.regexp_replace(x, "[^A-Za-z]", "")), F.length(F.regexp_replace(x, "[^0-9]", ""))
    spaces, n, upper = F.length(F.regexp_replace(x, r"(?U)[^\s]", "")), F.length(x), x == F.upper(x)
    one = (spaces == 0) & (((digits > 0) & (letters > 0) & (n < 5)) | (upper & (letters > 0) & ((n < 6) | ((n < 7) & (digits == 0)))))
    more = (spaces >= 1) & upper & (digits > 0) & ~v.contains(" ")
    return (F.length(v) < 15) & (one | more)


def is_url(v: Column) -> Column:
    return F.lower(v).rlike(URL)


def is_email(v: Column) -> Column:
    return F.lower(v).rlike(EMAIL)


def is_address(v: Column) -> Column:
    return F.lower(v).rlike(STREET) | (v.rlike(HOUSE) & v.rlike(r"\d$"))


def is_hex_color(v: Column) -> Column:
    return v.rlike(HEX_COLOR)


def is_ip(v: Column) -> Column:
    six = F.regexp_replace(F.lower(v), EMBEDDED, ":0:0")
    return (F.length(v) < 50) & (v.rlike(IPV4) | six.rlike(IPV6))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def is_credit_card(v: Column) -> Column:
    """All digits after white space is removed, with a right check digit."""
    s = F.regexp_replace(v, r"\s", "")
    return s.rlike(r"^\d+$") & F.coalesce(_luhn(s), F.lit(False))


def is_image(v: Column) -> Column:
    return v.rlike(IMAGE)


def _weighted(s: Column, weight) -> Column:
    chars = F.transform(F.split(s, ""), lambda c, i: F.when(F.upper(c) == "X", 10).otherwise(F.expr("0") + c.try_cast("int")) * weight(i))
    return F.aggregate(chars, F.lit(0), lambda a, x: a + F.coalesce(x.cast("int"), F.lit(0)))


def is_isbn(v: Column) -> Column:
    """ISBN-10 or ISBN-13 with a right check digit, dashes and spaces aside."""
    s = F.regexp_replace(v, "[- ]", "")
    ten = s.rlike(r"^\d{9}[\dXx]$") & (_weighted(s, lambda i: F.lit(10) - i) % 11 == 0)
    thirteen = s.rlike(r"^97[89]\d{10}$") & (_weighted(s, lambda i: F.when(i % 2 == 0, 1).otherwise(3)) % 10 == 0)
    return ten | thirteen


def is_iso8601(v: Column) -> Column:
    return v.rlike(ISO8601)


def is_currency(v: Column, x: Column | None = None) -> Column:
    return (F.length(v) < 15) & (bare(v) if x is None else x).isin(*CURRENCIES)


def is_airport(v: Column, codes: Column | None) -> Column:
    """A code of three or four letters among at most two words; without a code list nothing is one."""
    if codes is None:
        return F.lit(False)
    s = F.regexp_replace(F.lower(v), "[-/&,:;_]", " ")
    parts = F.split(s, " ")
    fits = (F.length(v) == 3) | F.length(s).between(4, 8)
    return fits & (F.size(parts) < 3) & F.exists(parts, lambda w: F.length(w).between(3, 4) & F.array_contains(codes, F.upper(w)))


def is_person(v: Column) -> Column:
    return v.rlike(PERSON)


def is_float(v: Column) -> Column:
    return _matches_number(v, NUMBER)


def is_integer(v: Column) -> Column:
    return _matches_number(v, INTEGER)


#: Type and predicate in order.
ORDER = [
    ("empty", is_empty), ("numeric", is_numeric), ("boolean", is_boolean), ("date", is_date), ("geo_coordinates", is_geo),
    ("description", is_description), ("no_annotation", is_no_annotation), ("id", is_id), ("url", is_url), ("email", is_email),
    ("address", is_address), ("hex_color", is_hex_color), ("ip", is_ip), ("credit_card", is_credit_card), ("image", is_image),
    ("isbn", is_isbn), ("iso8601", is_iso8601), ("currency", is_currency),
]

#: Types that schema labels name otherwise than as strings (fixed values).
XSD = {"numeric": ["float", "integer", "double"], "url": ["anyURI"], "boolean": ["boolean"], "date": ["date"]}
XSD_BASE = "http://www.w3.org/2001/XMLSchema#"


def cell_type(v: Column, airports: Column | None = None, exact_dates: bool = False, x: Column | None = None) -> Column:
    """The semantic type of a cell, '' for none. ``airports``: an array of codes; ``x``: see ``with_type``."""
    rules = [(k, is_date_exact if k == "date" and exact_dates else f) for k, f in ORDER] + [("iata", lambda v: is_airport(v, airports))]
    test = lambda k, f: f(v, x) if k in ("id", "currency") else f(v)
    return reduce(lambda rest, r: F.when(test(*r), F.lit(r[0])).otherwise(rest), reversed(rules), F.lit(""))


def with_type(df: DataFrame, value: str, airports: Column | None = None, exact_dates: bool = False) -> DataFrame:
    """The frame with cell_type; the form that several rules look at is worked out once per row, in a projection below."""
    return df.withColumn("_bare", bare(F.col(value))).withColumn("cell_type", cell_type(F.col(value), airports, exact_dates, F.col("_bare"))).drop("_bare")


def xsd_types(kind: Column) -> Column:
    """Array of (label, uri) of a type."""
    pick = lambda names: F.array(*[F.struct(F.lit(n).alias("label"), F.lit(XSD_BASE + n).alias("uri")) for n in names])
    return reduce(lambda rest, k: F.when(kind == k, pick(XSD[k])).otherwise(rest), XSD, pick(["string"]))


def xsd_uri(label: Column) -> Column:
    """The address of a schema label, null if unknown."""
    return F.when(label.isin("float", "integer", "double", "anyURI", "boolean", "date", "string"), F.concat(F.lit(XSD_BASE), label))
