"""Evaluation against gold standards, and consistency of target files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_metrics(found: DataFrame, truth: DataFrame, always: str = "Country") -> DataFrame:
    """(perfect, annotated, gold, precision, recall, f1): precision over annotated tables, recall over gold tables, to four digits.

    found and truth(table_id, col_idx, class); a gold class ``always`` counts as right."""
    both = found.select("table_id", "col_idx", F.col("class").alias("found")).join(truth, ["table_id", "col_idx"])
    perfect = both.agg(F.count_if((F.col("found") == F.col("class")) | (F.col("class") == always)).alias("perfect"))
    sizes = found.agg(F.count_distinct("table_id").alias("annotated")), truth.agg(F.count_distinct("table_id").alias("gold"))
    one = perfect.join(sizes[0], F.lit(True)).join(sizes[1], F.lit(True))  # three single rows
    return _ratios(one)


def column_metrics(found: DataFrame, truth: DataFrame) -> DataFrame:
    """The same per column: precision over annotated columns, recall over gold columns, no class counted by default."""
    both = found.select("table_id", "col_idx", F.col("class").alias("found")).join(truth, ["table_id", "col_idx"], "full")
    return _ratios(both.agg(F.count_if(F.col("found") == F.col("class")).alias("perfect"), F.count("found").alias("annotated"), F.count("class").alias("gold")))


def _ratios(one: DataFrame) -> DataFrame:
    p, r = F.col("perfect") / F.greatest("annotated", F.lit(1)), F.col("perfect") / F.greatest("gold", F.lit(1))
    return one.select("perfect", "annotated", "gold", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"))


def subject_accuracy(found: DataFrame, target: DataFrame) -> DataFrame:
    """(right, targets, accuracy) over all targets; found and target(table_id, subject_col)."""
    both = target.select("table_id", F.col("subject_col").alias("want")).join(found, "table_id", "left")
    return both.agg(F.count_if(F.col("want") == F.col("subject_col")).alias("right"), F.count(F.lit(1)).alias("targets")).select("right", "targets", F.round(F.col("right") / F.greatest("targets", F.lit(1)), 4).alias("accuracy"))


def agreement_percent(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(equal, total, percent) of two lists of answers, matched by key."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    return both.agg(F.count_if(F.col("x").eqNullSafe(F.col("y"))).alias("equal"), F.count(F.lit(1)).alias("total")).select("equal", "total", (F.col("equal") * 100 / F.greatest("total", F.lit(1))).alias("percent"))


def missing_from(rows: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't among the targets."""
    return rows.join(target.select(*keys).distinct(), keys, "left_anti")


def in_target(rows: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is among the targets."""
    return rows.join(target.select(*keys).distinct(), keys, "left_semi")


def fill_predicates(columns: DataFrame, properties: DataFrame, ontology: str) -> DataFrame:
    """columns(.., header, rel): a relation that is no address is filled from the header when that names a property."""
    known = columns.join(properties.select(F.col("name").alias("header")).distinct().withColumn("_k", F.lit(1)), "header", "left")
    rel = F.when(~F.coalesce(F.col("rel"), F.lit("")).startswith("http") & F.col("_k").isNotNull(), F.concat(F.lit(ontology), F.col("header"))).otherwise(F.col("rel"))
    return known.withColumn("rel", rel).drop("_k").select(*columns.columns)
