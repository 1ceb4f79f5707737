"""Mixing sources to target weights by systematic sampling.

Targets are shared out by weight and stop at ``limit`` times a source's size; each document then expects the same
number of copies r = target / source size. Documents of a source stand in a fixed order (size, hash of the
row); the document in place k is emitted once per integer in (u + r k, u + r (k + 1)], u being the source's one
random offset. Ordering by size keeps the words taken near the target. Places come from bucket counts
(see ``common.slots``), so a source of any size is spread over the cluster and reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, the last; a source without words has
target 0 and its documents are not emitted; ties and repeated rows stand side by side, each with its own place;
texts of any length are counted whole; any number of sources is mixed; an empty table gives no rows. ``mix_plan`` drops other columns, ``mix`` keeps all columns of the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, group_key, row_hash, slots, written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def share_out(sizes: Sequence[int], weights: Sequence[float], total: float, limit: float) -> list[float]:
    """Targets by weight, of which none passes ``limit`` times its size: the level at which the capped targets add up to the total.

    Sources are capped in the order of their cap per weight, until the level of the others is below the next cap."""
    order = sorted(range(len(sizes)), key=lambda i: (limit * sizes[i] / weights[i], i))
    capped, weight = 0.0, float(sum(weights))
    level = 0.0
    for i in order:
        level = (total - capped) / weight
        if level <= limit * sizes[i] / weights[i]:
            break
        capped, weight = capped + limit * sizes[i], weight - weights[i]
    else:
        level = float("inf")
    return [min(w * level, limit * s) if s else 0.0 for s, w in zip(sizes, weights, strict=True)]


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("source", n_words().alias("_size"))


def water_level(sized: DataFrame, total: float, limit: float) -> float:
    """The level of ``share_out`` for sized(n, w) of any length: sources below the level are capped until none is left below it."""
    cap, level = F.lit(limit) * F.col("n"), -1.0
    while True:
        below = cap < F.col("w") * level if level >= 0 else F.lit(False)
        r = sized.agg(F.sum(F.when(below, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(below, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if not r.w:
            return float("inf")
        if (total - r.capped) / r.w <= level:
            return level
        level = (total - r.capped) / r.w


def targets(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, small: int = BROADCAST_ROWS) -> DataFrame:
    """(_g, source_size, target) of every source of ``sized(source, _size)``; weights go by code point, null last.

    Up to ``small`` counted sources the shares are worked out on the driver and the frame is marked for broadcast; more stay in Spark:
    the order comes from a sort by ranges, the level from one sum per step."""
    spark = sized.sparkSession
    found = written(sized.groupBy("source").agg(F.sum("_size").alias("n")))
    if found.count() <= small:
        rows = sorted(((r.source, r.n) for r in found.collect()), key=lambda x: (x[0] is None, x[0] or ""))
        sizes = [n for _, n in rows]
        goal = share_out(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), limit)
        plan = [("n" if s is None else f"v{s}", n, t) for (s, n), t in zip(rows, goal, strict=True)]
        return F.broadcast(spark.createDataFrame(plan, "_g string, source_size long, target double"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = written(found.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before, at = {}, 0
    for r in sorted(ranged.groupBy("_part").count().collect()):  # one row per partition
        before[r["_part"]], at = at, at + r["count"]
    starts = spark.createDataFrame(list(before.items()), "_part int, _start long")
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = ranged.join(F.broadcast(starts), "_part").withColumn("_i", place)
    shares = written(placed.select("source", "n", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")).alias("w")))
    level = water_level(shares, share * (shares.agg(F.sum("n")).first()[0] or 0), limit)
    target = F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.col("w") * level, F.lit(limit) * F.col("n")))
    return written(shares.select(group_key(F.col("source")).alias("_g"), F.col("n").alias("source_size"), target.alias("target")))


def _sampled(rows: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with _g, _row, _size) with source_size, target and copies."""
    placed = slots(rows, "_g", "_row", level="_size").join(goals, "_g")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_g")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    edge = lambda k: F.floor(offset + rate * k)
    return placed.withColumn("copies", (edge(F.col("_slot") + 1) - edge(F.col("_slot"))).cast("int"))


def _keyed(docs: DataFrame, *keep: Column) -> DataFrame:
    """The kept columns with size, source key and a hash of the row."""
    return docs.select(*keep, n_words().alias("_size"), group_key(F.col("source")).alias("_g"), row_hash(F.col("doc_id"), F.col("source"), F.col("text")).alias("_row"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every document; only sizes and hashes are shuffled."""
    rows = written(_keyed(docs, F.col("doc_id"), F.col("source")))
    out = _sampled(rows.drop("source"), targets(rows, weights, share, limit), seed)
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).cast("long").alias("taken"), "copies")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: each document as many times as the plan takes it, with the columns of ``docs``."""
    goals = targets(sizes(docs), weights, share, limit)
    boxed = _keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_box"))  # no name of the documents can clash
    placed = _sampled(boxed, goals, seed).where("copies > 0")
    return placed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_box.*")
