"""Phrase collocations by word-id suffix arrays.

Texts are cut into pieces and words; a task gathers the words of each language into shards, and closes the largest whenever it holds ``shard``
words in all: a vocabulary and an array of word ids with 0 between pieces. A shard's suffix array is built by numpy prefix doubling (to the longest phrase's length; nothing
deeper is asked); the intervals of its LCP array are the distinct n-grams with their counts, which are merged over the shards by key.

What can't be frequent is left out before it is shuffled, and exactly so, since a phrase is at most as frequent as any part of it:
1. words are counted per shard and merged; each shard gets back the global numbers of those of its words that are frequent (a word's number is the
   least place it has in any shard, so numbers need no table of their own);
2. pairs of frequent words come from the suffix arrays of order two; each shard gets back its frequent pairs;
3. longer phrases are looked for only where every pair is frequent.
So what is shuffled is a row per distinct word or phrase of a shard, never a row per occurrence; what goes back to a shard is part of what it has
sent. A shard's pairs and longer phrases, by far the most, go in order and packed, dealt to buckets by their words' numbers; a bucket holds at most about ``BUCKET`` of them,
and the pairs that it sends back are packed as well. Keys are global word numbers, so no hash can confuse two phrases; sums are 64-bit, products decimal.

Then every candidate is cut at each of its places, joined with the counts of both parts (which are frequent too), and dropped if a longer
candidate that holds it is nearly as frequent. The best of each language are chosen in two steps, the first over buckets.

Defined cases: null text is empty; a null language is ``und``; repeated rows count as often as they come; ties go to the count, then the phrase
in byte order; texts of any length are read whole (one text's words are one task's); words are whatever stands between blanks, tabs and the
separators, with only A-Z lower-cased; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import small
from .common import Scratch, short_batches, side, written

#: Words that a task holds in open shards, about; longest phrase; least count; share (in hundredths) of a phrase's count that lets a longer one stand for it; phrases of a language; buckets of the first choice.
SHARD, LONGEST, LEAST, COVER, TOP, BUCKETS = 3_000_000, 4, 30, 80, 2000, 32
SCALE = 2_000_000
#: Words of the corpus for each bucket that pairs and longer phrases are dealt to.
BUCKET = 1_000_000

#: A-Z lower-cased, every separator (.,;:!? and the line ends from x0A to x0D) a full stop.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9)


class Vocabulary(dict):
    """Word to id, given on first use; 0 is the separator."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


class Shard:
    def __init__(self):
        self.words, self.parts, self.size = Vocabulary({b".": 0}), [], 0

    def add(self, text: bytes) -> None:
        words = text.translate(FOLD).replace(b".", b" . ").split()
        words.append(b".")
        self.parts.append(np.fromiter(map(self.words.__getitem__, words), dtype=np.int32, count=len(words)))
        self.size += len(words)


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """(shard, lang, words, counts, ids): word i of ``words`` has id i + 1 in ``ids`` (little-endian 32-bit) and stands there ``counts[i]`` times."""
    names = ["shard", "lang", "words", "counts", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Shard] = {}
        number = TaskContext.get().partitionId() << 41  # and the words of the task's shards so far: a word's place is its shard's number and its id

        def out(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for lang in langs:
                s = open_.pop(lang)
                ids, words = np.concatenate(s.parts), list(s.words)[1:]
                if words:
                    flat = pa.array(words, pa.binary()).view(pa.string())
                    counts = pa.array(np.bincount(ids, minlength=len(words) + 1)[1:], pa.int64())
                    ends = pa.array([0, len(words)], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lang]), pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, counts), pa.array([ids.tobytes()], pa.binary())], names=names)
                    number += len(words)

        for batch in small(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    open_.setdefault("und" if lang is None else lang, Shard()).add(text)
                    if sum(s.size for s in open_.values()) >= size:
                        yield from out([max(sorted(open_), key=lambda x: open_[x].size)])
        yield from out(sorted(open_))

    short_batches(docs.sparkSession)
    return docs.select("lang", "text").mapInArrow(run, "shard long, lang string, words array<string>, counts array<long>, ids binary")


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``ids`` (0 ends a suffix; none starts there) in order of their first ``depth`` words, and the LCP of each with the one
    before, at most ``depth``. Prefix doubling: the order by h words gives ranks, pairs of ranks h apart the order by 2h."""
    n = len(ids)
    at = np.flatnonzero(ids)
    if not len(at):
        return at, at
    rank = ids.astype(np.int64)
    order, h = at, 1
    ends = np.append(np.flatnonzero(ids == 0), n)
    left = ends[np.searchsorted(ends, at)] - at  # words to the end of the suffix
    while h < depth:
        behind = np.zeros(len(at), dtype=np.int64)
        more = left > h
        behind[more] = rank[at[more] + h]
        key = rank[at] * (int(rank.max()) + 1) + behind
        by = np.argsort(key, kind="stable")
        s = key[by]
        new = np.zeros(n, dtype=np.int64)
        new[at[by]] = np.concatenate(([1], 1 + np.cumsum(s[1:] != s[:-1])))
        rank, order, h = new, at[by], 2 * h
    padded = np.concatenate((ids, np.zeros(depth, dtype=ids.dtype)))
    lcp, same = np.zeros(len(order), dtype=np.int8), np.ones(len(order) - 1, dtype=bool)
    for k in range(depth):
        x = padded[order + k]
        same &= (x[1:] == x[:-1]) & (x[1:] != 0)
        lcp[1:] += same
    return order, lcp


def intervals(ids: np.ndarray, order: np.ndarray, lcp: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-grams as rows of ids, and their counts: the intervals of the LCP array of k or more."""
    padded = np.concatenate((ids, np.zeros(k, dtype=ids.dtype)))
    starts = np.flatnonzero(lcp < k)
    first = order[starts]
    grams = np.stack([padded[first + j] for j in range(k)], axis=1)
    counts = np.diff(np.append(starts, len(order)))
    whole = (grams != 0).all(axis=1)  # suffixes that end before k words
    return grams[whole], counts[whole]


def _frequent(raw: bytes, local) -> tuple[np.ndarray, np.ndarray]:
    """The shard's ids anew, in the order of the words' global numbers and 0 for words that aren't frequent; the number of each new id."""
    ids = np.frombuffer(raw, dtype="<i4")
    at, number = local.field(0).to_numpy(), local.field(1).to_numpy()
    order = np.argsort(number)
    new = np.zeros(int(ids.max(initial=0)) + 1, dtype=np.int32)
    new[at[order]] = np.arange(1, len(at) + 1)
    return new[ids], np.concatenate(([-1], number[order]))


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers of which the first column never falls, as differences, by planes of their bytes: most planes are nearly all zeros."""
    rows = np.stack([np.diff(columns[0], prepend=0), *columns[1:]]).astype("<i8")
    return pa.compress(np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1, 8).transpose(0, 2, 1)), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, columns: int) -> np.ndarray:
    """The ``columns`` of ``n`` numbers each."""
    planes = np.frombuffer(pa.decompress(data, decompressed_size=columns * n * 8, codec="zstd"), dtype=np.uint8).reshape(columns, 8, n)
    rows = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(columns, n)
    return np.concatenate((np.cumsum(rows[:1], axis=1), rows[1:]))


def _dealt(grams: np.ndarray, c: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Phrases of a shard, in order, and their counts: the buckets they are dealt to, the number of phrases of each, and these packed."""
    mixed = np.zeros(len(c), dtype=np.uint64)
    for w in grams.T:
        mixed = (mixed ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    bucket = (mixed % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    grams, c = grams[by], c[by]
    names, starts = np.unique(bucket[by], return_index=True)
    ends = np.append(starts[1:], len(by)).astype(int)
    return names, ends - starts, [pack(*grams[x:y].T, c[x:y]) for x, y in zip(starts, ends, strict=True)]


def _merged(table: pa.Table, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Packed phrases of ``k`` words in order: their words, the table's row that each comes from, where each distinct one starts, and its count."""
    n = table.column("n").to_pylist()
    *words, c = np.concatenate([unpack(data, x, k + 1) for data, x in zip(table.column("data").to_pylist(), n, strict=True)], axis=1)
    order = np.lexsort(words[::-1])
    words = [w[order] for w in words]
    starts = np.flatnonzero(np.append(True, reduce(np.logical_or, [w[1:] != w[:-1] for w in words])))
    return words, np.repeat(np.arange(len(n)), n)[order], starts, np.add.reduceat(c[order], starts)


def pairs(numbered: DataFrame, buckets: int) -> DataFrame:
    """(bucket, shard, n, data): the distinct pairs of frequent words of a shard by their numbers, with their counts; ``n`` of them in order, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, number = _frequent(batch.column(1)[i].as_py(), batch.column(2)[i].values)
                grams, c = intervals(ids, *suffix_array(ids, 2), 2)
                if not len(c):
                    continue
                names, n, data = _dealt(number[grams], c, buckets)
                shard = np.full(len(names), batch.column(0)[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(shard), pa.array(n, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "shard", "n", "data"])

    return numbered.select("shard", "ids", "local").mapInArrow(run, "bucket int, shard long, n int, data binary")


def frequent_pairs(found: DataFrame, least: int) -> DataFrame:
    """(w1, w2, f) of the pairs that all shards together have ``least`` times, and (shard, n, data) of each shard's among them, packed, in rows of their own."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard").to_pylist()
        (w1, w2), at, starts, f = _merged(table, 2)
        often = f >= least
        first = starts[often]
        keep = np.repeat(often, np.diff(np.append(starts, len(w1))))
        one, two, at = w1[keep], w2[keep], at[keep]
        by = np.argsort(at, kind="stable")
        one, two, at = one[by], two[by], at[by]
        ends = np.searchsorted(at, np.arange(len(shard) + 1))
        own = [(k, ends[k], ends[k + 1]) for k in range(len(shard)) if ends[k] < ends[k + 1]]
        p, q = len(first), len(own)
        none = lambda k, kind: pa.nulls(k, kind)
        columns = {
            "w1": [pa.array(w1[first]), none(q, pa.int64())], "w2": [pa.array(w2[first]), none(q, pa.int64())], "f": [pa.array(f[often]), none(q, pa.int64())],
            "shard": [none(p, pa.int64()), pa.array([shard[k] for k, _, _ in own], pa.int64())], "n": [none(p, pa.int32()), pa.array([y - x for _, x, y in own], pa.int32())],
            "data": [none(p, pa.binary()), pa.array([pack(one[x:y], two[x:y]) for _, x, y in own], pa.binary())],
        }
        return pa.table({k: pa.chunked_array(v) for k, v in columns.items()})

    return found.groupBy("bucket").applyInArrow(run, "w1 long, w2 long, f long, shard long, n int, data binary")


def longer(numbered: DataFrame, buckets: int, longest: int = LONGEST) -> DataFrame:
    """(bucket, k, n, data): the distinct phrases of three to ``longest`` words of a shard all of whose pairs are frequent; ``n`` of ``k`` words in order, packed;
    numbered(shard, ids, local, good) with the shard's frequent pairs of numbers in ``good``, in packed parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, number = _frequent(batch.column(1)[i].as_py(), batch.column(2)[i].values)
                good = np.concatenate([unpack(x["data"], x["n"], 2) for x in batch.column(3)[i].as_py()], axis=1)
                a, b = (np.searchsorted(number, x).astype(np.int64) for x in good)
                keys = np.sort(a * len(number) + b)
                here = ids[:-1].astype(np.int64) * len(number) + ids[1:]
                where = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
                joined = (keys[where] == here) & (ids[:-1] > 0) & (ids[1:] > 0)
                # 0 between words that make no frequent pair: runs are laid out anew, and runs of one word go
                keep = np.zeros(len(ids), dtype=bool)
                keep[:-1] |= joined
                keep[1:] |= joined
                at = np.flatnonzero(keep)
                if not len(at):
                    continue
                cut = np.append(True, ~joined)[at]  # the first of a run
                runs = np.zeros(len(at) + int(cut.sum()), dtype=ids.dtype)
                runs[np.arange(len(at)) + np.cumsum(cut)] = ids[at]
                order, lcp = suffix_array(runs, longest)
                for size in range(3, longest + 1):
                    grams, c = intervals(runs, order, lcp, size)
                    if len(c):
                        names, n, data = _dealt(number[grams], c, buckets)
                        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), size, dtype=np.int32)), pa.array(n, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "k", "n", "data"])

    return numbered.select("shard", "ids", "local", "good").mapInArrow(run, "bucket int, k int, n int, data binary")


def frequent_phrases(found: DataFrame, least: int) -> DataFrame:
    """(words, f) of the longer phrases that all shards together have ``least`` times."""

    def run(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        words, _, starts, f = _merged(table, k)
        first = starts[f >= least]
        rows = np.stack([w[first] for w in words], axis=1)
        return pa.table({"words": pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, k), pa.int32()), pa.array(rows.reshape(-1))), "f": pa.array(f[f >= least])})

    return found.groupBy("bucket", "k").applyInArrow(run, "words array<long>, f long")


def phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, size: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, f) of all frequent phrases of one to ``longest`` words by their numbers; (lang, word, number, f) of the frequent words; (lang, n)."""
    held = scratch.dealt(shards(docs, size), "shard")  # the shards stay where they are; what is looked up for them comes to them
    each = held.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select("shard", "lang", (F.col("pos") + 1).alias("at"), F.col("col.words").alias("word"), F.col("col.counts").alias("c"))
    total = scratch.write(held.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    # every shard has a word once, so a word's rows are at most the shards; its number is its least (shard, place)
    word = Window.partitionBy("lang", "word")
    place = F.col("shard") + F.col("at")
    known = scratch.write(each.withColumn("f", F.sum("c").over(word)).withColumn("number", F.min(place).over(word)).where(F.col("f") >= least).select("shard", "at", "number", "lang", F.when(F.col("number") == place, F.col("word")).alias("word"), "f"))
    words = scratch.write(known.where("word is not null").select("lang", "word", "number", "f"))
    local = scratch.write(known.groupBy("shard").agg(F.collect_list(F.struct("at", "number")).alias("local")))
    numbered = held.select("shard", "ids").join(local.hint("shuffle_hash"), "shard")
    buckets = max(1, -(-(total.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    found = scratch.write(frequent_pairs(pairs(numbered, buckets), least))
    good = scratch.write(found.where("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("n", "data")).alias("good")))
    more = frequent_phrases(longer(numbered.join(good.hint("shuffle_hash"), "shard"), buckets, longest), least)
    two = found.where("f is not null").select(F.array("w1", "w2").alias("words"), "f")
    return scratch.write(words.select(F.array("number").alias("words"), "f").unionByName(two).unionByName(more)), words, total


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP, size: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of two to ``longest`` words.

    a, l and r count the phrase and the two parts of its lowest-scoring cut, n all words of the language."""
    scratch = Scratch(docs.sparkSession)
    try:
        every, words, total = phrases(docs, scratch, least, longest, size)
        long_ = every.where(F.size("words") > 1)
        exact = lambda c: F.col(c).cast("decimal(38,0)")
        part = lambda i, n: F.slice("words", i, n)
        # longer phrases that stand for the shorter ones in them
        inner = [part(i, n) for n in range(2, longest) for i in range(1, longest - n + 2)]
        fits = [F.when(F.size("words") > n, part(i, n)) for n in range(2, longest) for i in range(1, longest - n + 2)]
        inside = long_.where(F.size("words") > 2).select(F.explode(F.array_distinct(F.filter(F.array(*fits), lambda x: x.isNotNull()))).alias("words"), "f") if inner else None
        if inside is not None:
            most = inside.groupBy("words").agg(F.max("f").alias("most"))
            kept = long_.join(most, "words", "left").where(F.col("most").isNull() | (100 * exact("most") < cover * exact("f"))).select("words", "f")
        else:
            kept = long_
        cuts = reduce(DataFrame.unionByName, [kept.where(F.size("words") > k).select("words", F.col("f").alias("a"), F.lit(k).alias("k"), part(1, k).alias("one"), F.slice("words", F.lit(k + 1), F.size("words") - k).alias("two")) for k in range(1, longest)])
        left, right = every.select(F.col("words").alias("one"), F.col("f").alias("l")), every.select(F.col("words").alias("two"), F.col("f").alias("r"))
        scored = cuts.join(left, "one").join(right, "two").withColumn("score", F.expr(f"CAST(floor({SCALE}BD * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))) AS BIGINT)"))
        best = scored.groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("words", "a", "x.l", "x.r", "x.score")
        best = best.join(side(words.select("lang", F.col("number").alias("w"))), F.get("words", F.lit(0)) == F.col("w")).drop("w")
        # by score and count first, which needs no words; all that tie with the last place stay
        near = Window.partitionBy("lang", "bucket").orderBy(F.desc("score"), F.desc("a"))
        some = scratch.write(best.withColumn("bucket", F.pmod(F.xxhash64("words"), F.lit(BUCKETS))).withColumn("place", F.rank().over(near)).where(F.col("place") <= top).drop("bucket", "place"))
        name = words.select(F.col("number").alias("w"), "word")
        spelt = some.select("words", F.posexplode("words").alias("pos", "w")).join(side(name), "w").groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
        named = some.join(spelt, "words")
        order = [F.desc("score"), F.desc("a"), "phrase"]
        first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).orderBy(*order)
        fewer = named.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
        ranked = fewer.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return written(ranked.join(F.broadcast(total) if total.count() < 1000 else total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    finally:
        scratch.drop()
