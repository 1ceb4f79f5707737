"""Data preparation: cells get a type, a clean value and a query text."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.celltypes import LONGEST_DATE, with_type
from ..functions.text import clean_text, query_text

#: Lexicons are broadcast up to this number of rows; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """The frame, marked for broadcast when a count proves it small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def expand_abbreviations(cells: DataFrame, abbreviations: DataFrame, value: str = "value_raw") -> DataFrame:
    """Replace a cell whose whole lower-cased text is a key of ``abbreviations(key, expansion)``."""
    lex = small(abbreviations.groupBy("key").agg(F.min("expansion").alias("expansion")))
    joined = cells.join(lex, F.lower(F.trim(F.col(value))) == F.col("key"), "left")
    return joined.withColumn(value, F.coalesce("expansion", F.trim(F.col(value)))).drop("key", "expansion")


#: Formats of dates that are read without Python, and of the result.
DATE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'")
DATE_RESULT = "yyyy-dd-MM"


def general_date(today: datetime.date | None = None):
    """A column function: any date that the general parser reads, as text of year, day and month; null for others. What a date leaves
    open is taken from ``today``."""
    day = today or datetime.date.today()

    @F.pandas_udf(T.StringType())
    def read(s: pd.Series) -> pd.Series:
        from dateutil import parser

        default = datetime.datetime.combine(day, datetime.time())

        def one(x: str) -> str | None:
            try:
                d = parser.parse(x, default=default)
            except (ValueError, OverflowError, TypeError):
                return None
            return f"{d.year:04}-{d.day:02}-{d.month:02}"

        return s.map(one, na_action="ignore")

    return read


def convert(text: Column, original: Column, kind: Column, today: datetime.date | None = None) -> Column:
    """The value by type: numbers lose commas, dates become year-day-month, others (and dates that don't parse) stay. Only what
    no format reads goes to the general parser."""
    day = F.date_format(F.coalesce(*[F.try_to_timestamp(original, F.lit(f)) for f in DATE_FORMATS]), DATE_RESULT)
    rest = general_date(today)(F.when((kind == "date") & day.isNull() & (F.length(original) <= LONGEST_DATE), original))
    return F.when(kind == "numeric", F.replace(text, F.lit(","), F.lit(""))).when(kind == "date", F.coalesce(day, rest, text)).otherwise(text)


#: A text that fills a column is worked out in so many tasks at most, not in one.
SALTS = 16


def prepare(cells: DataFrame, abbreviations: DataFrame | None = None, airports: Column | None = None, today: datetime.date | None = None) -> DataFrame:
    """Add value, value_original, value_for_query, cell_type and comment to cells(table_id, row_idx, col_idx, header, value_raw).

    Types and clean texts are worked out once per distinct text (and salt, so that a frequent text is no task's only key) and joined
    back, so a text that fills a column is tokenised a few times."""
    expanded = expand_abbreviations(cells, abbreviations) if abbreviations is not None else cells.withColumn("value_raw", F.trim("value_raw"))
    expanded = expanded.withColumn("_salt", F.pmod(F.xxhash64("table_id", "row_idx"), F.lit(SALTS)))
    texts = expanded.select("value_raw", "_salt").distinct()
    typed = with_type(texts, "value_raw", airports).withColumn("_clean", clean_text("value_raw"))
    typed = typed.withColumn("value", convert(F.col("_clean"), F.col("value_raw"), F.col("cell_type"), today)).withColumn("value_for_query", query_text(F.col("_clean"))).drop("_clean")
    out = expanded.join(typed, ["value_raw", "_salt"]).drop("_salt")
    return out.withColumn("value_original", F.col("value_raw")).withColumn("comment", F.when(F.col("value") != F.col("value_raw"), F.col("value_raw")).otherwise(F.lit("")))


def number_of(c: Column) -> Column:
    """A number as text in plain notation, by where its commas and full stops stand."""
    commas, stops = F.length(c) - F.length(F.replace(c, F.lit(","), F.lit(""))), F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    last = F.regexp_extract(c, r"([.,])[^.,]*$", 1)
    both = F.when(last == ",", F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(c, F.lit(","), F.lit("")))
    thousand = F.split(c, ",")[1].rlike("[0-9]{3}")
    one = F.when(thousand, F.replace(c, F.lit(","), F.lit(""))).otherwise(F.replace(c, F.lit(","), F.lit(".")))
    return F.when((commas > 0) & (stops > 0), both).when(commas > 1, F.replace(c, F.lit(","), F.lit(""))).when(commas == 1, one).when(stops > 1, F.replace(c, F.lit("."), F.lit(""))).otherwise(c)


def convert_units(measures: DataFrame, units: DataFrame) -> DataFrame:
    """measures(num, unit_text, ..) joined with units(quantity, unit, abbrs, mul, add): adds quantity, base_value and unit."""
    names = units.select("quantity", "unit", "mul", "add", F.explode(F.array_distinct(F.concat(F.array("unit"), "abbrs"))).alias("unit_text"))
    names = small(names.groupBy("unit_text").agg(F.min(F.struct("quantity", "unit", "mul", "add")).alias("u")))
    value = number_of(F.col("num")).try_cast("double") * F.col("u.mul") + F.col("u.add")
    return measures.join(names, "unit_text", "left").withColumn("quantity", F.col("u.quantity")).withColumn("base_value", value).withColumn("base_unit", F.col("u.unit")).drop("u")
