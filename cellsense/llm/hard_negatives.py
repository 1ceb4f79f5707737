"""Hard negatives by dual-tree search over anchors and candidates.

Vectors become integers (floor of ``scale`` times the component), so every score is an exact integer inner product.

Trees. The upper tree halves the vectors at the mean of the axis of largest spread; it is fitted on a bounded sample and every vector
descends it. A leaf of one label is dealt into blocks of about ``block`` rows at most (by the id's hash, so copies of one vector in any number make many equal
blocks); anchors have blocks of their own, by the upper levels of the same tree (and by label where positives are looked for). Below that, each block is a tree of balls (center and radius), built
where the block is read.

Search. The inner product of a vector of one ball with one of another lies within <c, d> +- (|c| s + |d| r + r s). Block pairs whose interval
misses what the anchors of the block ask for are never read; of the rest, every anchor block first meets the few candidate blocks of the highest bound, which gives it
floors (the least of its anchors' k-th best scores), then those whose bound reaches the floor. Within a pair both trees are
descended together, high bounds first: a pair of nodes whose interval is below all its anchors' floors, or above all their limits, goes as a whole; leaf pairs
are scored exactly. One task streams the candidate blocks of one anchor block, so it holds two blocks at a time and k rows per anchor.

The search is run twice: for the positives (the first ``positives`` rows of the anchor's label), then for the negatives, with a band of scores for every
anchor and positive. Nothing is sampled or capped in either.

Defined cases: rows with a null id, label or vector or a null or non-finite component take no part, nor do those with a component of 2 ** 18 or
more in size, whose scores can pass 64 bits; empty vectors score 0; the shorter of two vectors counts as filled with zeros; of
repeated ids the row least by label, then vector counts; ties go to the smaller id; an empty table, or one without anchors, gives no rows; other columns
are not read. Anchors without positives, and positives without negatives, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import small
from .common import Scratch, side, written

#: Candidates and anchors of a block, about; rows of a leaf in a block; vectors of the sample that the upper tree is fitted on; its levels at most; blocks met first; block summaries of a lane.
BLOCK, ANCHORS, LEAF, SAMPLE, DEPTH, FIRST, LANE = 2048, 2048, 64, 20_000, 11, 3, 256
POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
_LARGEST, _LEAST, _MOST = 1 << 26, -(1 << 62), 1 << 62


def integers(rows: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q) of the rows that take part, each id once."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < _LARGEST / scale))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False)))
    one = kept.select("vec_id", F.struct(label.cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("q")).alias("v"))
    return one.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.label", "v.q")


def halves(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """The upper tree as a heap of (axis, threshold): child 2i + 1 is below the threshold, 2i + 2 is not."""
    out: list[tuple[int, float]] = [(0, 0.0)] * ((1 << depth) - 1)
    parts = {0: sample}
    for i in range(len(out)):
        x = parts.pop(i)
        if len(x):
            axis = int(np.argmax(x.var(axis=0)))
            out[i] = axis, float(x[:, axis].mean())
            below = x[:, axis] < out[i][1]
            parts[2 * i + 1], parts[2 * i + 2] = x[below], x[~below]
        else:
            parts[2 * i + 1] = parts[2 * i + 2] = x
    return out


def descend(vectors: DataFrame, tree: list[tuple[int, float]], depth: int) -> DataFrame:
    """vectors with ``leaf``, the number of its leaf in the upper tree, which stands in the plan as two literal arrays of 2 ** DEPTH numbers at most."""
    if not depth:
        return vectors.withColumn("leaf", F.lit(0))
    axes, cuts = F.array(*[F.lit(a) for a, _ in tree]), F.array(*[F.lit(c) for _, c in tree])
    below = lambda node: F.coalesce(F.get("q", F.get(axes, node)), F.lit(0)) < F.get(cuts, node)
    leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda node, _: 2 * node + F.when(below(node), 1).otherwise(2))
    return vectors.withColumn("leaf", leaf - ((1 << depth) - 1))


def matrix(rows: list, width: int = 0) -> np.ndarray:
    """Vectors as one matrix, filled with zeros to the longest."""
    width = max([width, *map(len, rows)], default=width)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def stored(rows) -> np.ndarray:
    """The matrix of one cell of arrays."""
    size = np.diff(rows.offsets.to_numpy())
    if len(size) and (size == size[0]).all():
        return rows.flatten().to_numpy().reshape(len(size), size[0])
    return matrix(rows.to_pylist())


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    center = x.mean(axis=0)
    return center, float(np.sqrt(((x - center) ** 2).sum(axis=1).max())) if len(x) else 0.0


def interval(c: np.ndarray, r: float, d: np.ndarray, s: float) -> tuple[float, float]:
    """Bounds of the inner products of two balls' vectors, widened by what rounding may take."""
    w = min(len(c), len(d))
    mid, far = float(c[:w] @ d[:w]), float(np.linalg.norm(c)) * s + float(np.linalg.norm(d)) * r + r * s
    slack = 1e-6 + 1e-9 * (abs(mid) + far)
    return mid - far - slack, mid + far + slack


class Tree:
    """A block's rows in the order of a tree of balls; nodes are (start, end, center, radius, left, right)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(ids))
        self.nodes: list[list] = []
        self._split(rows.astype(np.float64), 0, len(ids), leaf)
        self.ids, self.rows = ids[self.order], rows[self.order]

    def _split(self, x: np.ndarray, start: int, end: int, leaf: int) -> int:
        here = self.order[start:end]
        center, radius = ball(x[here])
        at = len(self.nodes)
        self.nodes.append([start, end, center, radius, None, None])
        if end - start > leaf and (radius > 0 or end - start > 4 * leaf):
            axis = int(np.argmax(x[here].var(axis=0))) if x.shape[1] else 0
            values = x[here, axis] if x.shape[1] else np.zeros(len(here))
            below = values < values.mean()
            if 20 * min(below.sum(), (~below).sum()) < len(here):  # a lone few, or equal rows: halves
                below = np.argsort(values, kind="stable").argsort() < len(here) // 2
            mid = int(below.sum())
            self.order[start:end] = np.concatenate((here[below], here[~below]))
            self.nodes[at][4] = self._split(x, start, start + mid, leaf)
            self.nodes[at][5] = self._split(x, start + mid, end, leaf)
        return at


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where every sum is an exact double, else by 64-bit integers."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    most = w * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


class Anchors:
    """A block of anchors with their labels, their bands (low and high score per anchor and band) and the best k of each."""

    def __init__(self, ids, rows, labels, low, high, k: int, same: bool):
        self.tree, self.k, self.same = Tree(ids, rows), k, same
        self.labels, self.low, self.high = labels[self.tree.order], low[self.tree.order], high[self.tree.order]
        self.asking = np.ones(len(ids), dtype=bool)
        self.best = np.full((*self.low.shape, k), _LEAST)
        self.who = np.full((*self.low.shape, k), _MOST)
        self.fresh()

    def fresh(self) -> None:
        self.floor = np.where(self.asking[:, None], np.maximum(self.low, self.best[:, :, -1]), _MOST)

    def meet(self, other: Tree, label: int) -> None:
        """The candidates of a block, all of one label, meet the anchors of that label, or those of others."""
        self.asking = (self.labels == label) == self.same
        self.fresh()
        a, b = self.tree.nodes, other.nodes
        stack = [(0, 0)]
        while stack:
            i, j = stack.pop()
            s0, s1, c, r, left, right = a[i]
            t0, t1, d, s, below, above = b[j]
            lo, hi = interval(c, r, d, s)
            if hi < self.floor[s0:s1].min() or lo > self.high[s0:s1].max():
                continue
            if left is None and below is None:
                self.score(s0, s1, other.ids[t0:t1], other.rows[t0:t1])
                continue
            if below is None or (left is not None and s1 - s0 >= t1 - t0):
                next_ = [(left, j), (right, j)]
            else:
                next_ = [(i, below), (i, above)]
            next_.sort(key=lambda p: float(a[p[0]][2][: len(b[p[1]][2])] @ b[p[1]][2][: len(a[p[0]][2])]))
            stack += next_  # the higher one is looked at first

    def score(self, s0: int, s1: int, ids: np.ndarray, rows: np.ndarray) -> None:
        got = products(self.tree.rows[s0:s1], rows)
        own = self.tree.ids[s0:s1, None] == ids[None, :]
        for m in range(self.low.shape[1]):
            fit = (got >= self.floor[s0:s1, m, None]) & (got <= self.high[s0:s1, m, None]) & ~own
            who = np.flatnonzero(fit.any(axis=1))
            if not len(who):
                continue
            u, v = np.nonzero(fit[who])
            n = len(who) * self.k
            at = np.concatenate((np.repeat(np.arange(len(who)), self.k), u))
            score = np.concatenate((self.best[s0 + who, m].reshape(n), got[who[u], v]))
            name = np.concatenate((self.who[s0 + who, m].reshape(n), ids[v]))
            by = np.lexsort((name, -score, at))
            at = at[by]
            first = np.searchsorted(at, np.arange(len(who)))
            top = by[(first[:, None] + np.arange(self.k)[None, :]).reshape(-1)]
            self.best[s0 + who, m], self.who[s0 + who, m] = score[top].reshape(-1, self.k), name[top].reshape(-1, self.k)
        self.fresh()

    def rows(self) -> list[tuple]:
        i, m, r = np.nonzero(self.best > _LEAST)
        return [self.tree.ids[i], m, r, self.best[i, m, r], self.who[i, m, r]]


SUMMARY = "center array<double>, radius double, floor double, ceiling double"


def blocks(placed: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """(block, ids, labels, rows): vectors of equal ``keys`` in blocks of about ``size`` rows at most, in order of their ids."""
    counts = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("_parts"))
    rows = placed.join(side(counts), keys).withColumn("block", F.concat_ws("/", *keys, part))
    held = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "label", "q"))).alias("held"))
    take = lambda c: F.transform("held", lambda x: x[c])
    return held.select("block", take("vec_id").alias("ids"), take("label").alias("labels"), take("q").alias("rows"))


def summaries(of: DataFrame) -> DataFrame:
    """(block, labels, center, radius, floor, ceiling) of written blocks; floor and ceiling are what the anchors of a block ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            center, radius = ball(stored(batch.column(2)[0].values).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([center.tolist()], pa.list_(pa.float64())), pa.array([radius]), batch.column(3), batch.column(4)], names=["block", "labels", "center", "radius", "floor", "ceiling"])

    ask = [c if c in of.columns else F.lit(0.0).alias(c) for c in ("floor", "ceiling")]
    return of.select("block", F.array_distinct("labels").alias("labels"), "rows", *ask).mapInArrow(run, "block string, labels array<long>, center array<double>, radius double, floor double, ceiling double")


def reachable(anchors: DataFrame, cands: DataFrame, lanes: int, same: bool) -> DataFrame:
    """(a_block, c_block, hi): pairs of blocks whose interval meets what the anchors ask for, labels equal or not as ``same`` says.

    Candidate summaries are gathered in lanes of about LANE; an anchor block meets each lane's ball first, then the blocks in it."""
    each = cands.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes))).groupBy("lane").agg(F.collect_list(F.struct("block", F.element_at("labels", 1).alias("label"), "center", "radius")).alias("held"))
    asked = anchors.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 16):
            for a_block, labels, center, radius, floor, ceiling, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = [h for h in held if (h["label"] in labels if same else labels != [h["label"]])]
                if not held:
                    continue
                center, mids = np.array(center), [np.array(h["center"]) for h in held]
                wide = max(map(len, mids))
                inner = np.stack([np.pad(m, (0, wide - len(m))) for m in mids])
                hub = inner.mean(axis=0)
                reach = max(float(np.linalg.norm(m - hub)) + h["radius"] for m, h in zip(inner, held, strict=True))
                lo, hi = interval(center, radius, hub, reach)
                if hi < floor or lo > ceiling:
                    continue
                spans = [(h["block"], *interval(center, radius, m, h["radius"])) for m, h in zip(mids, held, strict=True)]
                out = [(a_block, name, hi) for name, lo, hi in spans if hi >= floor and lo <= ceiling]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["a_block", "c_block", "hi"])

    met = asked.join(each, "lane").select("block", "labels", "center", "radius", "floor", "ceiling", "held")
    return met.mapInArrow(run, "a_block string, c_block string, hi double")


FOUND = "a_block string, anchor_id long, band int, place int, score long, cand_id long"


def stream(pairs: DataFrame, anchors: DataFrame, cands: DataFrame, k: int, same: bool) -> DataFrame:
    """FOUND of pairs(a_block, c_block, hi): anchors(block, ids, labels, rows, low, high) meet the candidate blocks of their pairs, the highest bound first."""
    none = F.lit(None)
    head = anchors.join(pairs.select(F.col("a_block").alias("block")).distinct(), "block", "left_semi")
    first = head.select(F.col("block").alias("a_block"), F.lit(float("inf")).alias("hi"), "ids", "labels", "rows", "low", "high")
    rest = pairs.join(cands.select(F.col("block").alias("c_block"), "ids", F.slice("labels", 1, 1).alias("labels"), "rows"), "c_block").select("a_block", "hi", "ids", "labels", "rows", none.cast("array<array<long>>").alias("low"), none.cast("array<array<long>>").alias("high"))
    rows = first.unionByName(rest).repartition("a_block").sortWithinPartitions("a_block", F.desc("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None

        def out() -> pa.RecordBatch:
            ids, band, place, score, who = held.rows()
            return pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(ids), pa.array(band, pa.int32()), pa.array(place, pa.int32()), pa.array(score), pa.array(who)], names=["a_block", "anchor_id", "band", "place", "score", "cand_id"])

        for batch in small(batches, 1):
            ids, labels = (batch.column(i)[0].values.to_numpy() for i in (2, 3))
            vectors = stored(batch.column(4)[0].values)
            if batch.column(5)[0].is_valid:
                if held is not None:
                    yield out()
                name, held = batch.column(0)[0].as_py(), Anchors(ids, vectors, labels, *(stored(batch.column(i)[0].values) for i in (5, 6)), k, same)
            else:
                held.meet(Tree(ids, vectors), labels[0])
        if held is not None:
            yield out()

    return rows.mapInArrow(run, FOUND)


def search(anchors: DataFrame, cands: DataFrame, cand_balls: DataFrame, lanes: int, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """(anchor_id, band, place, score, cand_id): the first k candidates of each anchor and band, ``place`` from 0.

    anchors(block, ids, labels, rows, low, high), low and high per anchor and band."""
    flat = lambda c: F.flatten(F.col(c))
    anchors = scratch.write(anchors.withColumn("floor", F.array_min(flat("low")).cast("double")).withColumn("ceiling", F.array_max(flat("high")).cast("double")))
    pairs = scratch.write(reachable(scratch.write(summaries(anchors)), cand_balls, lanes, same))
    order = Window.partitionBy("a_block").orderBy(F.desc("hi"), "c_block")
    ranked = scratch.write(pairs.withColumn("n", F.row_number().over(order)))
    one = scratch.write(stream(ranked.where(F.col("n") <= FIRST), anchors, cands, k, same))
    # an anchor's floor is its k-th score so far, or the band's low; a block's the least of its anchors' and bands'
    kth = one.where(F.col("place") == k - 1).select("a_block", "anchor_id", "band", "score")
    asked = anchors.select(F.col("block").alias("a_block"), F.explode(F.arrays_zip("ids", "low")).alias("x")).select("a_block", F.col("x.ids").alias("anchor_id"), F.posexplode("x.low").alias("band", "low"))
    floors = asked.join(kth, ["a_block", "anchor_id", "band"], "left").groupBy("a_block").agg(F.min(F.greatest("low", F.coalesce("score", "low"))).alias("least"))
    left = ranked.where(F.col("n") > FIRST).join(floors, "a_block").where(F.col("hi") >= F.col("least")).select("a_block", "c_block", "hi")
    two = stream(scratch.write(left), anchors, cands, k, same)
    both = one.unionByName(two).select("anchor_id", "band", "score", "cand_id")
    place = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "cand_id")
    return scratch.write(both.withColumn("place", F.row_number().over(place) - 1).where(F.col("place") < k))


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, group: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors(vec_id, label, q).

    ``anchor`` tells the anchors. A negative has another label and a score of ``low`` to ``high`` percent of the positive's."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    try:
        vectors = scratch.write(vectors)
        largest = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        depth = min(DEPTH, (largest // block).bit_length())
        drawn = vectors.select("q").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect() if depth else []  # at most SAMPLE vectors
        tree = halves(matrix([r.q for r in drawn]), depth) if max((len(r.q) for r in drawn), default=0) else []
        depth = depth if tree else 0
        levels = min(depth, (vectors.where(anchor).count() // group).bit_length())
        placed = scratch.write(descend(vectors, tree, depth).withColumn("node", F.shiftright("leaf", depth - levels)))
        cands = scratch.write(blocks(placed, block, ["label", "leaf"]))
        balls = scratch.write(summaries(cands))
        lanes = max(1, -(-balls.count() // LANE))
        own = placed.where(anchor)
        band = lambda v: F.transform("ids", lambda _: F.array(F.lit(v).cast("long")))
        found = search(blocks(own, group, ["label"]).withColumn("low", band(_LEAST)).withColumn("high", band(_MOST)), cands, balls, lanes, positives, True, scratch)
        spans = scratch.write(found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("score").alias("positive_score"), F.col("cand_id").alias("positive_id")))).alias("ps")))
        # bands in whole numbers, from the least score of ``low`` percent or more to the largest of ``high`` percent or less; none below zero
        share = lambda p, percent: p.positive_score.cast("decimal(28,0)") * percent / 100
        lows = F.transform("ps", lambda p: F.when(p.positive_score >= 0, F.ceil(share(p, low)).cast("long")).otherwise(_MOST))
        highs = F.transform("ps", lambda p: F.when(p.positive_score >= 0, F.floor(share(p, high)).cast("long")).otherwise(_LEAST))
        full = lambda xs, v: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(xs, i), F.lit(v).cast("long")))
        bands = scratch.write(spans.select(F.col("anchor_id").alias("id"), full(lows, _MOST).alias("low"), full(highs, _LEAST).alias("high")))
        mixed = blocks(own.join(bands.select(F.col("id").alias("vec_id")), "vec_id", "left_semi"), group, ["node"])
        each = mixed.select("block", F.explode(F.arrays_zip("ids", "labels", "rows")).alias("x")).select("block", "x.*").join(bands, F.col("ids") == F.col("id"))
        banded = each.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("ids", "labels", "rows", "low", "high"))).alias("xs"))
        take = lambda c: F.transform("xs", lambda x: x[c]).alias(c)
        banded = banded.select("block", *map(take, ("ids", "labels", "rows", "low", "high")))
        hard = search(banded, cands, balls, lanes, negatives, False, scratch)
        names = spans.select("anchor_id", F.posexplode("ps").alias("band", "p")).select("anchor_id", "band", "p.positive_id", "p.positive_score")
        out = hard.join(names, ["anchor_id", "band"])
        return written(out.select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("cand_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    finally:
        scratch.drop()


def hard_negatives(rows: DataFrame, every: int = 50, moved: int = 7, classes: int = 10) -> DataFrame:
    """The anchors are rows whose id is divisible by ``every``; where it is divisible by ``moved``, the label first becomes the next of ``classes``."""
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    return mine(integers(rows, label), F.col("vec_id") % every == 0)

