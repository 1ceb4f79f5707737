"""Tables between phases."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of tables between phases: ``spark.checkpoint.dir``, or one in the warehouse where that is unset. On a cluster, a folder of
    one machine's own disk holds no such table, so there ``spark.checkpoint.dir`` must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and warehouse.split(":", 1)[0] in ("file", warehouse):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: the warehouse {warehouse} is a machine's own")
    return f"{warehouse}/cellsense-scratch"


def folder(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there goes when the session ends."""
    path = f"{shared_root(spark)}/cellsense-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def staged(df: DataFrame) -> DataFrame:
    """The frame written as Parquet and read again: the next phase's plan begins here, and what is lost with an executor is read, not worked
    out anew. The table lies in the shared folder until the session ends."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that one task makes triples, words or pairs of.
ROWS = 50_000


def dealt(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """A table of more than ``rows`` rows dealt by its keys to as many tasks as it fills. A file of one row group is read by one task, and what that
    task makes of its rows would grow with the table."""
    n = tasks_for(df, rows)
    return df if n == 1 else df.repartition(n, *keys)


def tasks_for(df: DataFrame, rows: int = ROWS) -> int:
    """The number of tasks of ``rows`` rows each that a table fills, at least one."""
    return max(1, -(-df.count() // rows))
