"""A knowledge graph kept on disk in the two orders that joins need, and an index of its labels by word.

Both are bucketed Parquet tables at a path: a join of candidates with the triples' subjects, or objects, shuffles the candidates only; the
triples are read in place, already dealt and sorted. The tables are registered anew in every session that opens the path."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import long_words
from ..operators.prepare import small
from .stage import staged, tasks_for
from .tables import row_numbers

#: Postings of a block of the label index.
BLOCK = 256


def _bucketed(df: DataFrame, path: str, keys: list[str], order: list[str], buckets: int) -> None:
    name = f"cellsense_{uuid.uuid4().hex}"
    spark = df.sparkSession
    dealt = df.repartition(buckets, *keys)  # a task writes one bucket, so a bucket is one sorted file
    dealt.write.bucketBy(buckets, *keys).sortBy(*order).mode("overwrite").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # an external table's files stay


def _opened(spark: SparkSession, path: str, columns: str, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    if not re.fullmatch(r"[^'`\\]+", path):
        raise ValueError("a path without quotes is needed")
    name = f"cellsense_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


class TripleStore:
    """Triples by subject and by object."""

    COLUMNS = "s STRING, p STRING, o STRING, o_kind STRING, o_datatype STRING, o_lang STRING"

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.buckets = int(spark.read.text(f"{self.path}/buckets").first().value)
        self.by_subject = _opened(spark, f"{self.path}/by_subject", self.COLUMNS, ["s"], ["s", "p"], self.buckets)
        self.by_object = _opened(spark, f"{self.path}/by_object", self.COLUMNS, ["o"], ["o", "p"], self.buckets)

    @classmethod
    def write(cls, triples: DataFrame, path: str, buckets: int | None = None) -> TripleStore:
        """Keep triples at a path, each once. ``buckets`` (the session's shuffle partitions by default) should be no fewer than the partitions of the
        joins to come, else Spark deals the triples anew."""
        spark = triples.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        once = triples.select("s", "p", "o", "o_kind", "o_datatype", "o_lang").distinct()
        _bucketed(once, f"{path.rstrip('/')}/by_subject", ["s"], ["s", "p"], n)
        # literals are never joined as objects by their text
        _bucketed(spark.read.parquet(f"{path.rstrip('/')}/by_subject").where("o_kind <> 'literal'"), f"{path.rstrip('/')}/by_object", ["o"], ["o", "p"], n)
        spark.createDataFrame([(str(n),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/buckets")
        return cls(spark, path)

    def outgoing(self, subjects: DataFrame) -> DataFrame:
        """The triples of subjects(s, ..)."""
        return self.by_subject.hint("merge").join(subjects, "s")

    def incoming(self, objects: DataFrame) -> DataFrame:
        """The triples that point at objects(o, ..)."""
        return self.by_object.hint("merge").join(objects, "o")


class LabelIndex:
    """Postings of every word in labels, the shortest addresses first, in blocks.

    (word, block, df, postings): ``postings`` are (n, s, label, words) in the order of (length of the address, address);
    ``df`` counts the word's labels in all blocks. A query of one word reads only as many blocks as its answer fills."""

    COLUMNS = "word STRING, block BIGINT, df BIGINT, postings ARRAY<STRUCT<n: INT, s: STRING, label: STRING, words: ARRAY<STRING>>>"

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.buckets = int(spark.read.text(f"{self.path}/buckets").first().value)
        self.table = _opened(spark, f"{self.path}/postings", self.COLUMNS, ["word"], ["word", "block"], self.buckets)

    @classmethod
    def write(cls, labels: DataFrame, path: str, buckets: int | None = None, block: int = BLOCK) -> LabelIndex:
        """Index labels(s, label) at a path. A word's postings are numbered in ranges of (length of the address, address, label), so that a word that stands in
        most labels isn't numbered by one task."""
        spark = labels.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        words = F.array_distinct(long_words(F.lower("label")))
        each = labels.select("s", "label").distinct().withColumn("words", words).select(F.length("s").alias("n"), "s", "label", "words", F.explode("words").alias("word"))
        dealt = row_numbers(each.withColumn("at", F.struct("n", "s", "label")), "word", "at", tasks_for(each)).drop("at")
        counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        placed = dealt.join(small(staged(counts)), "word").withColumn("block", F.floor(F.col("row_idx") / block))
        posts = placed.groupBy("word", "block", "df").agg(F.array_sort(F.collect_list(F.struct("n", "s", "label", "words"))).alias("postings"))
        _bucketed(posts.select("word", "block", "df", "postings"), f"{path.rstrip('/')}/postings", ["word"], ["word", "block"], n)
        spark.createDataFrame([(str(n),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/buckets")
        return cls(spark, path)

    def match(self, queries: DataFrame, k: int | None = None, block: int = BLOCK) -> DataFrame:
        """(q, s, label) of the labels that hold all words of each query of queries(q); with ``k``, of the first k subjects by (length, address).

        A query meets the blocks of its rarest word; with ``k``, a query of one word meets the first k / block + 1 of them (a subject's labels
        stand side by side, and each subject counts once, so more are read where subjects have several labels with the word)."""
        asked = queries.select("q", F.array_distinct(long_words(F.lower("q"))).alias("asked")).where(F.size("asked") > 0).distinct()
        need = asked.select("q", "asked", F.explode("asked").alias("word"))
        df = self.table.where("block = 0").select("word", "df")
        known = df.hint("merge").join(need, "word").groupBy("q", "asked").agg(F.min(F.struct("df", "word")).alias("best"), F.count(F.lit(1)).alias("n"))
        rarest = small(staged(known.where(F.col("n") == F.size("asked")).select("q", "asked", F.col("best.word").alias("word"))))
        hits = self.table.hint("merge").join(rarest, "word")
        rows = hits.select("q", "asked", F.inline("postings")).where(F.size(F.array_except("asked", "words")) == 0)
        if k is None:
            return rows.select("q", "s", "label").distinct()
        alone = rarest.where(F.size("asked") == 1)
        head = self._head(alone, k, block)
        rest = rows.where(F.size("asked") > 1).select("q", "s", "label").distinct()
        top = F.dense_rank().over(Window.partitionBy("q").orderBy(F.length("s"), "s"))
        return head.unionByName(rest).withColumn("_n", top).where(F.col("_n") <= k).drop("_n")

    def _head(self, alone: DataFrame, k: int, block: int) -> DataFrame:
        """(q, s, label) that hold at least the first k subjects of each one-word query: blocks are added until every query has k subjects or no blocks are left."""
        upto = -(-k // block)
        while True:
            blocks = self.table.where(F.col("block") < upto).hint("merge").join(alone.select("q", "word"), "word")
            got = blocks.select("q", F.inline("postings")).select("q", "s", "label").distinct()
            short = got.groupBy("q").agg(F.count_distinct("s").alias("n")).where(F.col("n") < k)
            wide = blocks.groupBy("q").agg(F.max("block").alias("last"), F.max("df").alias("df")).where(F.col("df") > (F.col("last") + 1) * block)
            if short.join(wide, "q", "left_semi").isEmpty():
                return got
            upto *= 2
