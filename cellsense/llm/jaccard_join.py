"""N-gram Jaccard join by prefix filtering under several global token orders.

1. ``prefixes``: each task hashes whole texts to shingle sets and sends, packed by hash range, each distinct token of a
   chunk of documents once. A range's task sums document frequencies and sends back only tokens of two or more; the
   chunk then knows how many of a document's tokens are its own and which shared ones stand in its prefix. Three orders
   are used, all rare-first: by frequency, by the logarithm of the frequency, and by "shared or not", each with its own hash.
   Two linked documents share a prefix token under every order. Documents with equal sets are one node from here on.
2. A pair is a candidate when it meets in the index of the first order, shares a prefix token under each of the other two, and
   the set sizes allow the similarity: the filters are intersected per pair, before any text is read.
3. ``stars``: in each index list, every set is paired with the list's head (the set with the fewest tokens of its own); the
   candidates among these pairs, as many as index rows at most, are verified on whole sets. Their components hold
   most of every group of near copies, however large, for the price of its rows.
4. ``rest``: lists that still touch two components are dealt in blocks: sets outside the list's largest component against
   all of its sets. A block first looks at prefixes only, each pair in the first list it meets in; sets that still
   have a partner in the block go on with their texts to verification. A block of any stage returns ties, at most one per
   set, never pairs.
5. Ties are joined to components.

Exact: no candidate is dropped, whatever the group's size: pairs inside one component need no verification, all others
get it. Shingles are compared as 64-bit hashes. Texts of any length are read whole, one at a time.

Defined cases: null, empty and blank texts have an empty set and link with nothing (component: their own id); a text of
fewer words than a shingle is one shingle; repeated rows share a component; null ids take part and the component's id
is the smallest id that isn't null (null if there is none); ties (several sets as good a head) go to the smallest set id and
don't change the result; other columns are not read by ``join`` and kept by ``distinct``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import small
from .common import Scratch, components, short_batches, side, written
from .shingles import forget, mix, set_id, shingle_set

ORDERS = 3
#: A chunk holds at most so many documents and about so many tokens; a block at most so many documents a side.
CHUNK_DOCS, CHUNK_TOKENS, BLOCK = 20_000, 1_500_000, 512
#: Bits of a token inside its range. Ranges grow with the input, so as many tokens share a shortened token (about 4 in 100,000)
#: at any size; a shared one can only add a candidate.
BITS = 32
#: Blocks are run in bundles of about so many rows or bytes of text.
BUNDLE_ROWS, BUNDLE_BYTES = 4000, 4_000_000
#: Odd number that tells the orders' hashes apart (fixed value).
ODD = 0x9E3779B97F4A7C15

DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("th", "<i8"), ("n", "<i4"), ("cid", "<i8"), ("row", "<i4")])
PACKED = "key long, chunk long, kind int, a binary, b binary, c binary"
_packed = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _packed.field(i).type) for i in range(6)], schema=_packed)


def _bin(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _map(width: int, bits: int):
    """Documents to packed rows. kind 0: distinct tokens of a range; 1: the chunk's documents; 2: tokens the chunk has twice or more."""

    def flush(chunk: int, docs: list[tuple], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield _rows([(-1 - chunk, chunk, 1, np.array(docs, dtype=DOC).tobytes(), None, None)])
        tok = np.concatenate([*sets, np.empty(0, np.uint64)]) >> np.uint64(64 - BITS - bits)
        idx = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        order = np.argsort(tok, kind="stable")
        tok, idx = tok[order], idx[order]
        start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.empty(0, np.int64)
        count = np.diff(np.r_[start, len(tok)])
        many = np.repeat(count > 1, count)
        if many.any():
            yield _rows([(-1 - chunk, chunk, 2, _bin(tok[many]), _bin(idx[many]), None)])
        one, own = tok[start], np.where(count > 1, 0xFFFF, idx[start]).astype(np.uint16)
        rest, out = one.astype(np.uint32), []
        high = (one >> np.uint64(BITS)).astype(np.int64)
        cuts = np.r_[np.flatnonzero(np.diff(high, prepend=-1)), len(high)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out.append((int(high[a]), chunk, 0, _bin(rest[a:b]), _bin(own[a:b]), _bin(count[a:b][own[a:b] == 0xFFFF].astype(np.uint32))))
            if len(out) >= 256:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, docs, sets, seen, held = TaskContext.get().partitionId() << 24, [], [], {}, 0
        for batch in small(batches):
            for key, text, th in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = shingle_set(text or b"", width)
                cid = set_id(s)
                new = cid not in seen
                if new:
                    seen[cid] = len(sets)
                    sets.append(s)
                    held += len(s)
                docs.append((key or 0, key is None, th, len(s), cid, seen[cid] if new else -1))
                if len(docs) >= CHUNK_DOCS or held >= CHUNK_TOKENS:
                    yield from flush(chunk, docs, sets)
                    chunk, docs, sets, seen, held = chunk + 1, [], [], {}, 0
        if docs:
            yield from flush(chunk, docs, sets)
        forget()

    return run


def _count(table: pa.Table) -> pa.Table:
    """One range: the tokens with a document frequency of two or more, for each chunk that has them. Other rows pass."""
    if table.num_rows == 0 or table["key"][0].as_py() < 0:
        return table.set_column(0, "key", table["chunk"])
    a = [np.frombuffer(x, np.uint32) for x in table["a"].to_pylist()]
    own = [np.frombuffer(x, np.uint16) for x in table["b"].to_pylist()]
    n = [np.ones(len(x), np.int64) for x in a]
    for k, o, c in zip(n, own, table["c"].to_pylist(), strict=True):
        k[o == 0xFFFF] = np.frombuffer(c, np.uint32)
    tok, cnt = np.concatenate(a), np.concatenate(n)
    order = np.argsort(tok, kind="stable")
    s = tok[order]
    start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    df = np.empty(len(tok), np.int64)
    df[order] = np.repeat(np.add.reduceat(cnt[order], start), np.diff(np.r_[start, len(s)]))
    high, rows, at = table["key"][0].as_py(), [], 0
    for x, o, chunk in zip(a, own, table["chunk"].to_pylist(), strict=True):
        d = df[at : at + len(x)]
        at += len(x)
        if (two := d > 1).any():
            rows.append((chunk, chunk, high << 2, _bin(x[two]), _bin(o[two]), _bin(np.minimum(d[two], 0xFFFFFFFF).astype(np.uint32))))
    return pa.Table.from_batches([_rows(rows)])


def _finish(percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("own", pa.int64()), *[(f"pre{k}", pa.list_(pa.int64())) for k in range(ORDERS)]])

    def run(table: pa.Table) -> pa.Table:
        docs, many, ones, known = np.empty(0, DOC), [], [], []
        for kind, a, b, c in zip(*[table[x].to_pylist() for x in ("kind", "a", "b", "c")], strict=True):
            if kind == 1:
                docs = np.frombuffer(a, DOC)
            elif kind == 2:
                many.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint16)))
            else:
                tok = np.frombuffer(a, np.uint32).astype(np.uint64) | np.uint64((kind >> 2) << BITS)
                own, df = np.frombuffer(b, np.uint16), np.frombuffer(c, np.uint32)
                ones.append((tok[own != 0xFFFF], own[own != 0xFFFF], df[own != 0xFFFF]))
                known.append((tok[own == 0xFFFF], df[own == 0xFFFF]))
        cat = lambda xs, i, t: np.concatenate([x[i] for x in xs] or [np.empty(0, t)])
        tok, idx, df = cat(ones, 0, np.uint64), cat(ones, 1, np.uint16), cat(ones, 2, np.uint32)
        if many:
            t, d = cat(known, 0, np.uint64), cat(known, 1, np.uint32)
            order = np.argsort(t)
            m = cat(many, 0, np.uint64)
            tok, idx = np.r_[tok, m], np.r_[idx, cat(many, 1, np.uint16)]
            df = np.r_[df, d[order][np.searchsorted(t[order], m)]]
        first = docs["row"] >= 0
        n = docs["n"][first].astype(np.int64)
        sets = len(n)
        shared = np.bincount(idx, minlength=sets)
        room = np.where(n > 0, prefix_length(n, percent) - (n - shared), 0)
        on = room[idx] > 0
        tok, idx, df = tok[on], idx[on].astype(np.int64), df[on]
        rank = np.log2(np.maximum(df, 1)).astype(np.int64)
        where = np.cumsum(first) - 1
        alone = np.zeros(len(docs), np.int64)
        alone[first] = n - shared
        lists = []
        for k, level in enumerate((df, rank, np.zeros_like(rank))):
            order = np.lexsort((mix(tok ^ np.uint64((k + 1) * ODD % (1 << 64))), level, idx))
            t, i = tok[order].astype(np.int64), idx[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            keep = place < room[i]
            size = np.zeros(len(docs), np.int64)
            size[first] = np.bincount(i[keep], minlength=sets)
            lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(t[keep])))
        assert not len(where) or where[-1] + 1 == sets
        ids = pa.array(docs["id"], mask=docs["null"].astype(bool))
        return pa.Table.from_arrays([ids, pa.array(docs["th"]), pa.array(docs["n"].astype(np.int64)), pa.array(docs["cid"]), pa.array(alone), *lists], schema=schema)

    return run


def prefixes(docs: DataFrame, percent: int, width: int, ranges: int | None = None) -> DataFrame:
    """(doc_id, th, n, cid, own, pre0..) per document: set size, id of the set, and, on the chunk's first row of each set, how many of
    its tokens no other set has and the shared tokens in its prefix under each order.

    ``ranges`` (a power of two) bounds what one task counts at a time; by default there is one for each MB of input.
    """
    if ranges is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        ranges = 1 << min(28, max(8, (size >> 20).bit_length()))  # 28: beyond, as for an unknown size, nothing is gained by more
    bits = ranges.bit_length() - 1
    if not 6 <= bits <= 28:
        raise ValueError("ranges: a power of two from 64")
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    short_batches(docs.sparkSession)
    packed = body.mapInArrow(_map(width, bits), PACKED)
    counted = packed.groupBy("key").applyInArrow(_count, PACKED)
    pre = ", ".join(f"pre{k} array<long>" for k in range(ORDERS))
    return counted.groupBy("key").applyInArrow(_finish(percent), f"doc_id long, th long, n long, cid long, own long, {pre}")


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    ends = np.cumsum(flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(flat.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def _meet(one: list[np.ndarray], two: list[np.ndarray], below: int | None = None) -> np.ndarray:
    """Which list of ``one`` shares a token with which of ``two``; only tokens below a limit count, if there is one."""
    out = np.zeros((len(one), len(two)), dtype=bool)
    rows: dict[int, tuple[list[int], list[int]]] = {}
    for k, lists in enumerate((one, two)):
        for i, x in enumerate(lists):
            for t in x.tolist():
                if below is None or t < below:
                    rows.setdefault(t, ([], []))[k].append(i)
    for a, b in rows.values():
        if a and b:
            out[np.ix_(a, b)] = True
    return out


def _shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each set of ``one`` with each of ``two``."""
    if len(one) == 1 or len(two) == 1:
        single, many = (one[0], two) if len(one) == 1 else (two[0], one)
        ends = np.cumsum([len(x) for x in many])
        tok = np.concatenate(many)
        at = np.minimum(np.searchsorted(single, tok), len(single) - 1)
        hits = np.r_[0, np.cumsum(single[at] == tok)][np.r_[0, ends]]
        return np.diff(hits).reshape(len(one), len(two))
    both = np.intersect1d(np.unique(np.concatenate(one)), np.unique(np.concatenate(two)), assume_unique=True)
    out = np.zeros((len(one), len(two)), np.float32)
    for lo in range(0, len(both), 4096):
        part = both[lo : lo + 4096]
        m = [np.array([np.isin(part, x, assume_unique=True) for x in xs], np.float32) for xs in (one, two)]
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _forest(linked: np.ndarray, one: list[int], two: list[int]) -> list[tuple[int, int]]:
    """Ties with the components of the links between ``one`` and ``two``, fewer than there are sets."""
    out, left, right = [], np.ones(len(one), dtype=bool), np.ones(len(two), dtype=bool)
    for i in range(len(one)):
        if left[i]:
            left[i], todo = False, [i]
            while todo:
                new = np.flatnonzero(linked[todo.pop()] & right)
                right[new] = False
                out += [(one[i], two[j]) for j in new]
                more = np.flatnonzero(linked[:, new].any(axis=1) & left)
                left[more] = False
                out += [(one[i], one[j]) for j in more]
                todo += more.tolist()
    return [(a, b) for a, b in out if a != b]


def _blocks(table: pa.Table) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
    """The blocks of a bundle: their token, and the rows of either side."""
    tok = table["tok"].to_pylist()
    key = np.array([table["at"].to_numpy(), table["p"].to_numpy(), table["q"].to_numpy()]).T
    order = np.lexsort(key.T[::-1])
    cuts = np.flatnonzero((np.diff(key[order], axis=0) != 0).any(axis=1)) + 1
    outside = table["outside"].to_numpy(zero_copy_only=False).astype(bool)
    for rows in np.split(order, cuts):
        if len(rows):
            yield tok[rows[0]], rows[outside[rows]], rows[~outside[rows]]


class _Sets(dict):
    """Prefixes of rows as sets, made when first asked for."""

    def __init__(self, lists: list[np.ndarray]):
        self.lists = lists

    def __missing__(self, i: int) -> set[int]:
        out = self[i] = set(self.lists[i].tolist())
        return out


def _candidates(table: pa.Table, percent: int):
    """For a block: which of its pairs pass all filters. Blocks of a star (without a token) hold pairs that have passed already."""
    pre = [_Sets(_lists(table[f"pre{k}"])) for k in range(ORDERS)]
    met = _Sets(_lists(table["met"]))
    n, comp, cid, big = (table[c].to_numpy() for c in ("n", "comp", "cid", "big"))
    ids = cid.tolist()

    def run(tok: int | None, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        if tok is None:
            return np.ones((len(one), len(two)), dtype=bool)
        a, b = n[one][:, None], n[two][None, :]
        ok = (comp[one][:, None] != comp[two][None, :]) & ((comp[two] == big[two])[None, :] | (cid[one][:, None] < cid[two][None, :]))
        ok &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        if ok.sum() > 8 * ok.size**0.5:  # many: token by token for the whole block
            for k in range(1, ORDERS):
                ok &= _meet([pre[k].lists[i] for i in one], [pre[k].lists[i] for i in two])
            if ok.any():  # each pair counts in the list of its smallest shared token
                ok &= ~_meet([pre[0].lists[i] for i in one], [pre[0].lists[i] for i in two], below=tok)
        for i, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
            x, y = one[i], two[j]
            ok[i, j] = not (
                ids[x] in met[y] or ids[y] in met[x]  # they met in a star
                or any(pre[k][x].isdisjoint(pre[k][y]) for k in range(1, ORDERS)) or min(pre[0][x] & pre[0][y]) < tok
            )
        return ok

    return run


BLOCK_ROW = "at long, tok long, p int, q int, outside boolean, cid long, comp long, big long"


def _filter(percent: int):
    """Rows of sets that have a candidate in their block."""

    def run(table: pa.Table) -> pa.Table:
        passes, keep = _candidates(table, percent), []
        for tok, one, two in _blocks(table):
            ok = passes(tok, one, two)
            keep += [*one[ok.any(axis=1)], *two[ok.any(axis=0)]]
        return table.select(["at", "tok", "p", "q", "outside", "cid", "comp", "big"]).take(pa.array(sorted(keep), pa.int64()))

    return run


def _verify(percent: int, width: int):
    """Ties (a, b) of what a block finds linked, and one row (null, null, number of pairs verified) per bundle."""

    def run(table: pa.Table) -> pa.Table:
        cid, texts = table["cid"].to_numpy(), table["text"].cast(pa.binary())
        known: dict[int, np.ndarray] = {}
        for i, c in enumerate(cid.tolist()):
            if c not in known:
                known[c] = shingle_set(texts[i].as_py() or b"", width)
        passes, out, checked = _candidates(table, percent), [], 0
        for tok, one, two in _blocks(table):
            ok = passes(tok, one, two)
            checked += int(ok.sum())
            one, two, ok = one[ok.any(axis=1)], two[ok.any(axis=0)], ok[np.ix_(ok.any(axis=1), ok.any(axis=0))]
            if len(one):
                x, y = [known[c] for c in cid[one].tolist()], [known[c] for c in cid[two].tolist()]
                both = _shared(x, y)
                size = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - both
                out += _forest(ok & (100 * both >= percent * size), cid[one].tolist(), cid[two].tolist())
        forget()
        a, b = [r[0] for r in out], [r[1] for r in out]
        return pa.table({"a": pa.array([*a, None], pa.int64()), "b": pa.array([*b, None], pa.int64()), "checked": pa.array([0] * len(out) + [checked], pa.int64())})

    return run


VERIFIED = "a long, b long, checked long"


def _bundled(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("bundle", F.pmod(F.xxhash64("at", "p", "q"), F.lit(max(1, size))))


def sets_of(marked: DataFrame) -> DataFrame:
    """(cid, n, own, pre0.., _id, _th) of every distinct set with a shared prefix token, with one document that has it."""
    has = marked.where(F.size("pre0") > 0)
    same = [F.first(c).alias(c) for c in ("n", "own", *(f"pre{k}" for k in range(ORDERS)))]
    one = has.groupBy("cid").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("th").alias("_th"))).alias("doc"), *same)
    return one.select("cid", "n", "own", *(f"pre{k}" for k in range(ORDERS)), "doc.*")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def stars(index: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(cid, head): the pairs of a set with the head of an index list it stands in, and the candidates among them."""
    best = index.groupBy("tok").agg(F.min(F.struct("own", "cid", "n")).alias("h"), F.count(F.lit(1)).alias("size")).where("size > 1")
    heads = scratch.write(best.select("tok", F.col("h.cid").alias("head"), F.col("h.n").alias("m")))
    pairs = index.join(side(heads), "tok").where((F.col("cid") != F.col("head")) & _sizes_fit(F.col("n"), F.col("m"), percent))
    pairs = scratch.write(pairs.select("cid", "head").distinct())
    mine = sets.select("cid", *[f"pre{k}" for k in range(1, ORDERS)])
    theirs = sets.select(F.col("cid").alias("head"), *[F.col(f"pre{k}").alias(f"_{k}") for k in range(1, ORDERS)])
    met = pairs.join(mine, "cid").join(theirs, "head")  # both sides are scans below their exchange: a large head's rows are split
    return pairs, scratch.write(met.where(" and ".join(f"arrays_overlap(pre{k}, _{k})" for k in range(1, ORDERS))).select("cid", "head"))


def star_blocks(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs as rows of blocks: the head on one side, at most about BLOCK sets on the other."""
    size = scratch.write(pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")))
    sets = pairs.join(side(size), "head").select(F.col("head").alias("at"), F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("q"), F.lit(False).alias("outside"), "cid")
    heads = size.select(F.col("head").alias("at"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"), F.lit(True).alias("outside"), F.col("head").alias("cid"))
    rows = sets.unionByName(heads)
    return scratch.write(rows.select("at", F.lit(None).cast("long").alias("tok"), F.lit(0).alias("p"), "q", "outside", "cid"))


def rest_blocks(index: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of blocks for index lists that touch several components: sets outside the list's largest component against all its sets."""
    known = roots.select(F.col("node").alias("cid"), F.col("root"))
    placed = scratch.write(index.join(side(known), "cid", "left").select("tok", "cid", F.coalesce("root", "cid").alias("comp")))
    parts = placed.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("c"))
    alive = parts.groupBy("tok").agg(F.max(F.struct("c", "comp")).alias("big"), F.sum("c").alias("s"), F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    alive = scratch.write(alive.select("tok", F.col("big.comp").alias("big"), blocks(F.col("s") - F.col("big.c")).alias("ps"), blocks(F.col("s")).alias("qs")))
    rows = placed.join(side(alive), "tok").withColumn("p", F.pmod(F.xxhash64("cid"), "ps").cast("int")).withColumn("q", F.pmod(F.xxhash64("cid"), "qs").cast("int"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    outside = rows.where("comp <> big").select("tok", "p", each("qs").alias("q"), F.lit(True).alias("outside"), "cid", "comp", "big")
    inside = rows.select("tok", each("ps").alias("p"), "q", F.lit(False).alias("outside"), "cid", "comp", "big")
    return scratch.write(outside.unionByName(inside).select(F.col("tok").alias("at"), "tok", "p", "q", "outside", "cid", "comp", "big"))


def links(docs: DataFrame, marked: DataFrame, percent: int, width: int, verified: list[DataFrame] | None = None) -> DataFrame:
    """Ties (a, b) between set ids, whose components are those of all links. ``verified`` receives the tables of what was verified."""
    scratch = Scratch(docs.sparkSession)
    sets = scratch.write(sets_of(marked))
    index = scratch.write(sets.select("cid", "n", "own", F.explode("pre0").alias("tok")))
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64("text").alias("_th"), "text")

    def texts(rows: DataFrame) -> DataFrame:
        """(cid, text) of the sets of some rows, once each."""
        wanted = scratch.write(sets.join(rows.select("cid").distinct(), "cid", "left_semi").select("cid", "_id", "_th"))
        return scratch.write(text.join(side(wanted), ["_id", "_th"]).select("cid", "text").dropDuplicates(["cid"]))

    def verify(rows: DataFrame) -> DataFrame:
        """Ties of the blocks of some rows (of BLOCK_ROW, n, comp and lists)."""
        found = texts(rows)
        size = found.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
        many = rows.count()
        bundles = max(many // BUNDLE_ROWS, size[0] * many // (max(1, size[1]) * BUNDLE_BYTES))
        done = written(_bundled(rows.join(found, "cid"), bundles).groupBy("bundle").applyInArrow(_verify(percent, width), VERIFIED))
        if verified is not None:
            verified.append(done)
        return done.where("a is not null").select("a", "b")

    none = [F.lit(0).cast("long").alias(c) for c in ("n", "comp", "big")] + [F.array().cast("array<long>").alias(c) for c in ("met", *(f"pre{k}" for k in range(ORDERS)))]
    pairs, near = stars(index, sets, percent, scratch)
    near = verify(star_blocks(near, scratch).select("*", *none))
    roots = components(near)
    rest = rest_blocks(index, roots, scratch)
    met = pairs.groupBy("cid").agg(F.collect_set("head").alias("met"))  # one per prefix token at most
    lists = scratch.write(sets.select("cid", "n", *(f"pre{k}" for k in range(ORDERS))).join(met, "cid", "left").withColumn("met", F.coalesce("met", F.array().cast("array<long>"))))
    full = _bundled(rest.join(lists, "cid"), rest.count() // BUNDLE_ROWS)
    left = scratch.write(full.groupBy("bundle").applyInArrow(_filter(percent), BLOCK_ROW))
    more = verify(left.join(lists, "cid"))
    out = written(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    scratch.drop()
    return out


def resolved(docs: DataFrame, percent: int, width: int, ranges: int | None = None) -> DataFrame:
    """(doc_id, th, n, cid, root) of every document; documents of one component share the root."""
    docs = docs.select("doc_id", "text")
    marked = written(prefixes(docs, percent, width, ranges))
    roots = components(links(docs, marked, percent, width))
    named = marked.select("doc_id", "th", "n", "cid").join(side(roots), F.col("cid") == F.col("node"), "left")
    return named.select("doc_id", "th", "n", "cid", F.coalesce("root", "cid").alias("root"))


def join(docs: DataFrame, percent: int = 90, width: int = 3, ranges: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; linked when 100 x intersection >= percent x union."""
    named = resolved(docs, percent, width, ranges)
    least = written(named.groupBy("root").agg(F.min("doc_id").alias("least")))  # on its own, so that a large component's side of the join can be split
    out = named.join(side(least), "root")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def distinct(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The documents, same columns, with one row of each component: that of the smallest id (of repeated rows, one).

    Documents without words are linked with nothing and all stay. Only what has to go is sent to the documents."""
    key = [F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("th").alias("_th")]
    found = written(resolved(docs, percent, width).where("n > 0").select("root", *key).groupBy("root", "_null", "_id", "_th").agg(F.count(F.lit(1)).alias("copies")))
    first = written(found.groupBy("root").agg(F.min(F.struct("_null", "_id", "_th")).alias("x"), F.sum("copies").alias("rows")).where("rows > 1").select("root", "x"))
    marked = written(found.join(side(first), "root").withColumn("stays", F.struct("_null", "_id", "_th") == F.col("x")).where("not stays or copies > 1").select("_null", "_id", "_th", "stays"))
    id_ = F.col("doc_id").cast("long")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_box"), id_.isNull().alias("_null"), F.coalesce(id_, F.lit(0)).alias("_id"), F.xxhash64("text").alias("_th"))
    joined = boxed.join(side(marked), ["_null", "_id", "_th"], "left")
    alone = joined.where("stays is null").select("_box.*")
    if marked.where("stays").isEmpty():
        return alone
    return alone.unionByName(joined.where("stays").dropDuplicates(["_null", "_id", "_th"]).select("_box.*"))
