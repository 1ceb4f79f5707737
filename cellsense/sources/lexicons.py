"""Lexicons given as files: abbreviations, units of measure, code lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_lines


def read_abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """(key, expansion) of lines ``key*expansion``; the first line of a key counts, lines without ``*`` are left out."""
    return abbreviations(read_lines(spark, path))


def abbreviations(lines: DataFrame) -> DataFrame:
    """The same of lines(value) at hand."""
    rows = lines.where(F.col("value").contains("*"))
    rows = rows.select(F.substring_index("value", "*", 1).alias("key"), F.split("value", r"\*")[1].alias("expansion"), F.monotonically_increasing_id().alias("line"))
    return rows.groupBy("key").agg(F.min_by("expansion", "line").alias("expansion"))


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """(quantity, unit, abbrs, mul, add) of pipe-delimited lines of three to five fields."""
    return units(read_lines(spark, path))


def units(lines: DataFrame) -> DataFrame:
    """The same of lines(value) at hand."""
    part = F.split("value", r"\|")
    bare = lambda i: F.replace(part[i], F.lit('"'), F.lit(""))
    number = lambda i, default: F.when(F.size(part) > i, F.replace(F.get(part, F.lit(i)), F.lit('"'), F.lit("")).try_cast("double")).otherwise(F.lit(default))
    rows = lines.where(F.size(part).between(3, 5))
    return rows.select(bare(0).alias("quantity"), bare(1).alias("unit"), F.transform(F.split(bare(2), ","), lambda x: F.trim(x)).alias("abbrs"), number(3, 1.0).alias("mul"), number(4, 0.0).alias("add"))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).where("trim(value) <> ''").select(F.trim("value").alias("code")).distinct()
