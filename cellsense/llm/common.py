"""Helpers shared by the text operators: materialising in the shared folder, stable slots, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hex digits of a row's hash that name its bucket: rows of a group are numbered in 16 ** DIGITS buckets, not in one task.
DIGITS = 3
#: A side of a join is broadcast up to this counted number of (narrow) rows, else joined by a shuffle.
BROADCAST_ROWS = 200_000
#: So many counted links (16 bytes each) at most are settled in one task; the result is the same either way.
ONE_TASK = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one in the warehouse where that is unset."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/cellsense-scratch"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


class Scratch:
    """Tables in the shared folder that only the steps of one computation read; ``drop`` removes them when it is done.

    What a returned frame reads is written by ``written`` instead: it goes when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def write(self, df: DataFrame) -> DataFrame:
        out, path = _written(df)
        self.paths.append(path)
        return out

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """A table whose files are dealt by ``key`` as they are written, so that joins on it shuffle the other side only."""
        name, path = f"cellsense_{uuid.uuid4().hex}", new_folder(self.spark)
        self.paths.append(path)
        self.tables.append(name)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(parts, key).mode("overwrite").option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []
        for path in self.paths:
            target, fs = _at(self.spark, path)
            fs.delete(target, True)
        self.paths = []


def new_folder(spark: SparkSession) -> str:
    """A new name in the shared folder; what lies there goes when the session ends."""
    path = f"{shared_dir(spark)}/cellsense-{uuid.uuid4().hex}"
    target, fs = _at(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellsense-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, fs = _at(spark, path)
    fs.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """Materialise a frame as a Parquet table in the shared folder, which cuts its lineage; the files go when the session ends."""
    return _written(df)[0]


def side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written frame as one side of a join: broadcast if a count shows at most ``rows`` rows. A larger one is shuffled, and as
    both sides are then plain scans below the exchange, a key with many rows on the other side is split by Spark's skew join."""
    return F.broadcast(df) if df.count() <= rows else df


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python by ``rows`` at a time where the session still has the default of 10000, whose Arrow buffers
    (in the JVM and in Python) are sized for numbers; a setting of the session's own stays. The setting outlives the call, as
    Spark reads it when a frame is run, not when it is made."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def group_key(col: Column) -> Column:
    """A never-null text form of a group column, in which null differs from every value."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


def row_hash(*cols: Column) -> Column:
    """A hash of some columns as hex text, the same in every engine: rows are put in its order."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).cast("binary"))


def slots(df: DataFrame, group: str, key: str, level: str | None = None) -> DataFrame:
    """Add ``_slot``: each row's place from 0 in its group by (level, key), gapless, the same in every run.

    ``key`` is hex text (see ``row_hash``). Rows are numbered within (group, level, first digits of the key), so a group
    of any size is spread over many windows; counts per bucket are summed before running sums over the buckets of a
    level and over the levels of a group. No task ever holds a group. ``group`` and ``level`` must not be null. Rows with
    the same key are alike and take neighbouring slots.
    """
    own = level is None
    level = level or "_level"
    rows = (df.withColumn(level, F.lit(0)) if own else df).withColumn("_bucket", F.substring(key, 1, DIGITS))
    keys = [group, level, "_bucket"]
    ranked = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(key)) - 1)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    inner = Window.partitionBy(group, level).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(group).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    by_level = counts.groupBy(group, level).agg(F.sum("_n").alias("_n")).select(
        group, level, F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_before_level")
    )
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(inner), F.lit(0)).alias("_before"))
    starts = starts.join(by_level, [group, level]).select(*keys, (F.col("_before") + F.col("_before_level")).alias("_start"))
    out = ranked.join(starts, keys).withColumn("_slot", (F.col("_start") + F.col("_local")).cast("long"))
    return out.drop("_bucket", "_local", "_start", *([level] if own else []))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a counted, small number of links in one task: the smaller of two tops becomes the top of both."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        path = []
        while (up := top.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            top[y] = x
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    nodes = list(top)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    At most ``one_task`` counted links are settled in one task; beyond that:

    Each node points to its smallest neighbour where that is smaller; a node that points nowhere and that none points to
    points to its smallest neighbour all the same. That makes a forest whose trees have two nodes or more; pointer
    jumping finds the tops, and the tops with the links between trees are the next, at most half as large graph. So the
    rounds, and the jumps of each, are logarithmic whatever the order of the ids.

    A hub or a large component costs no task more than its share: every aggregate is a minimum, which combines before the
    shuffle, and what is looked up by a shared key (a tree's top) is one row per tree, kept apart in its own written table
    and joined as ``side`` says. Frames are written, not checkpointed: a checkpoint keeps its plan's estimated size, whose
    digits double with every join. The tables of the rounds are removed at the end.
    """
    scratch = Scratch(edges.sparkSession)
    links = scratch.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if links.count() <= one_task:
        out = written(links.coalesce(1).mapInArrow(_settle, "node long, root long"))
        scratch.drop()
        return out
    rounds = []
    while not rounds or not links.isEmpty():
        both = links.union(links.select("b", "a"))
        low = scratch.write(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), "low"))
        met = scratch.write(low.where("low < node").select(F.col("low").alias("met")).distinct())
        alone = (F.col("low") > F.col("node")) & F.col("met").isNotNull()
        tops = scratch.write(low.join(side(met), low.node == met.met, "left").select("node", F.when(alone, F.col("node")).otherwise(F.col("low")).alias("top")))
        while True:
            # one row per node that others point to and that points on itself
            named = tops.select(F.col("top").alias("node")).distinct()
            far = scratch.write(tops.where("top <> node").join(named, "node", "left_semi").select(F.col("node").alias("top"), F.col("top").alias("far")))
            if far.isEmpty():
                break
            tops = scratch.write(tops.join(side(far), "top", "left").select("node", F.coalesce("far", "top").alias("top")))
        rounds.append(tops)
        known = side(tops)
        one, two = known.select(F.col("node").alias("a"), F.col("top").alias("x")), known.select(F.col("node").alias("b"), F.col("top").alias("y"))
        links = scratch.write(links.join(one, "a").join(two, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    labels = rounds.pop()
    while rounds:
        last = labels.select(F.col("node").alias("top"), F.col("top").alias("far"))
        labels = scratch.write(rounds.pop().join(side(last), "top", "left").select("node", F.coalesce("far", "top").alias("top")))
    least = scratch.write(labels.groupBy("top").agg(F.min("node").alias("root")))
    out = written(labels.join(side(least), "top").select("node", "root"))
    scratch.drop()
    return out


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; 0 for a null id."""
    return F.pmod(F.coalesce(F.crc32(col.cast("string").cast("binary")), F.lit(0)), F.lit(n))


def bounded_labels(labels: DataFrame, label: str, per_class: tuple[int, int], where: Column) -> DataFrame:
    """At most ``per_class`` labelled ids of class 0 and of class 1, by the hash of the id: (doc_id, label). Bounded, so it may be broadcast."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & where).select("doc_id", F.col(label).cast("int").alias("label"))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    pick = lambda v: rows.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[v])
    return pick(0).unionByName(pick(1))
