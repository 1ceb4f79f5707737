"""Tables as a stream of files: the same stateless expressions over readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.celltypes import with_type
from ..sources.tables import CELLS, _json_cells, _table_name


def stream_json_tables(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of cells from JSON files as they arrive."""
    texts = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).text(path)
    return texts.select(_table_name(F.col("_metadata.file_path")).alias("table_id"), "value").mapInPandas(_json_cells, CELLS)


def typed_stream(cells: DataFrame) -> DataFrame:
    """Cells with their type; no state is kept."""
    return with_type(cells.withColumn("_value", F.trim("value_raw")), "_value").drop("_value")


def type_counts(cells: DataFrame) -> DataFrame:
    """Running type counts per column, for the complete or update output mode."""
    return typed_stream(cells).groupBy("table_id", "col_idx", "header", "cell_type").agg(F.count(F.lit(1)).alias("n"))
