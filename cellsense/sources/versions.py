"""Tables that change while they are read: every change is a new folder, and a folder counts once it is complete.

A number is claimed by creating a file that must not exist yet, so two writers never write to one folder; Spark's commit puts ``_SUCCESS`` into
a folder last, and readers see only folders that have it. So a reader sees the state before a change or after it, a writer that dies leaves
nothing that counts, and a frame made from an older version stays readable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """The versions of a table below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.root}/_claims"))

    def folder(self, version: int) -> str:
        return f"{self.root}/v{version:010}"

    def complete(self) -> list[int]:
        """The numbers of the complete versions, in order."""
        found = (x.getPath().getName() for x in self.fs.listStatus(self._path(self.root)) if x.isDirectory())
        return sorted(int(n[1:]) for n in found if n.startswith("v") and self.fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def _claim(self) -> int:
        claimed = [int(x.getPath().getName()) for x in self.fs.listStatus(self._path(f"{self.root}/_claims"))]
        version = max(claimed, default=0) + 1
        while not self.fs.createNewFile(self._path(f"{self.root}/_claims/{version}")):
            version += 1
        return version

    def publish(self, df: DataFrame) -> int:
        """Write a frame as the next version; its number."""
        version = self._claim()
        df.write.parquet(self.folder(version))
        return version

    def latest(self) -> DataFrame | None:
        """The newest complete version; None if there is none."""
        done = self.complete()
        return self.spark.read.parquet(self.folder(done[-1])) if done else None

    def history(self, upto: int | None = None) -> DataFrame | None:
        """All complete versions (up to one) as one frame with ``version``; None if there is none."""
        done = [v for v in self.complete() if upto is None or v <= upto]
        if not done:
            return None
        rows = self.spark.read.parquet(*[self.folder(v) for v in done])
        return rows.withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), r"/v(\d{10})/", 1).cast("long"))

    def update(self, changes: DataFrame, keys: list[str], removed: DataFrame | None = None) -> int:
        """A new version in which ``changes`` replace or join the rows of the newest one that have their keys, and rows with keys of ``removed`` are gone."""
        now = self.latest()
        if now is None:
            return self.publish(changes)
        gone = changes.select(*keys) if removed is None else changes.select(*keys).unionByName(removed.select(*keys))
        return self.publish(now.join(gone.distinct(), keys, "left_anti").unionByName(changes))


def merged(versions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of ``history``: that of the latest version."""
    rest = [c for c in versions.columns if c not in (*keys, "version")]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("x"))
    return newest.select(*keys, "x.*")
