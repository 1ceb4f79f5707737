"""Packing token ids into fixed windows by minimum bin slack.

Every document is tokenised once; its whole windows leave at once and the remainders wait in a buffer of at most
``window`` pieces per task. For the longest waiting piece a bitset subset-sum over the multiset of waiting lengths
finds the multiset that fills the window closest to capacity; backtracking gives the count of each length, and the
pattern is used again while its counts last. Where no multiset is exact, the longest waiting piece is cut to close
the slack. What is left when a task ends (under one window) is cut at powers of two, which need no padding.
One pass, no shuffle: memory is bounded by the buffer, and a lost task repeats with the same result.

Defined cases: null text is the empty text (one end id); a null doc_id stays null; repeated rows are packed as
often as they come; pieces of equal length (ties) leave in the order they came; texts of any length are tokenised whole; a task's tail makes at
most 11 sequences shorter than a window; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import insort
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import small
from .common import short_batches

CAPACITY, END_ID, WINDOW = 2048, 1, 1024

#: What the tokenizer's pattern takes for white space (Unicode's White_Space; Python's own class has four more).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Several white-space characters before a word: the last one goes with what follows, so a text is cut before it.
RUN = re.compile(f"[{SPACE}][{SPACE}][^{SPACE}]")


class Encoder:
    """Little-endian 32-bit ids of whole texts."""

    def __init__(self, path: str):
        import tiktoken

        vocab = json.load(open(path, encoding="utf-8"))
        split = [x for x in (vocab.get("pre_tokenizer") or {}).get("pretokenizers", [vocab.get("pre_tokenizer")]) if x]
        assert vocab["model"]["type"] == "BPE" and split[-1]["type"] == "ByteLevel", "a byte-level BPE file is needed"
        special = {x["content"]: x["id"] for x in vocab.get("added_tokens", [])}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab["model"]["vocab"].items() if t not in special}
        # byte-level BPE's pattern without its look-ahead, which texts cut at RUN don't need: it takes half the time and can't backtrack
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
        self.special = special
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def raw(self, text: str) -> bytes:
        ids = self.encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        """The ids of a text, encoded in one call but for special texts and runs of white space. No word is kept: a table of words
        met before costs more than it saves where new words keep coming."""
        if any(s in text for s in self.special):
            parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
            return b"".join(struct.pack("<I", self.special[x]) if x in self.special else self.ids(x) for x in parts if x)
        cuts = [0, *(x.start() + 1 for x in RUN.finditer(text)), len(text)]
        return b"".join(self.raw(text[a:b]) for a, b in pairwise(cuts))


_encoders: dict[str, Encoder] = {}


def words(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Fills sequences of ``capacity`` from pieces (key, start, ids bytes, document's length); ``out`` collects the results."""

    def __init__(self, capacity: int, window: int, first: int):
        self.capacity, self.window, self.next, self.held = capacity, window, first, 0
        self.lengths: list[int] = []
        self.waiting: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def add(self, key, ids: bytes) -> None:
        n, step = len(ids) // 4, self.capacity
        whole = n - n % step
        for s in range(0, whole, step):
            self.emit([(key, s, ids[4 * s : 4 * (s + step)], n)])
        if whole < n:
            self.wait((key, whole, ids[4 * whole :], n))
            if self.held >= self.window:
                while self.held > self.window // 2:
                    self.fill()

    def wait(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        if n not in self.waiting:
            self.waiting[n] = []
            insort(self.lengths, n)
        self.waiting[n].append(piece)
        self.held += 1

    def take(self, n: int) -> tuple:
        held = self.waiting[n]
        piece = held.pop()
        self.held -= 1
        if not held:
            del self.waiting[n]
            self.lengths.remove(n)
        return piece

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for key, start, ids, n in pieces:
            self.out.append((key, start, len(ids) // 4, zlib.crc32(ids), n, self.next, at, ids))
            at += len(ids) // 4
        self.next += 1

    def pattern(self) -> tuple[dict[int, int], int]:
        """Counts of lengths with the longest waiting one among them, whose sum is as near to capacity as any; the slack."""
        top = self.lengths[-1]
        goal = self.capacity - top
        bits, mask, steps = 1, (1 << (goal + 1)) - 1, []
        for n in reversed(self.lengths):
            if n > goal:
                continue
            left, k = min(len(self.waiting[n]) - (n == top), goal // n), 1
            while left > 0 and not bits >> goal & 1:
                k = min(k, left)
                steps.append((n, k, bits))
                bits |= bits << (k * n) & mask
                left -= k
                k *= 2
            if bits >> goal & 1:
                break
        at = bits.bit_length() - 1
        counts, slack = {top: 1}, goal - at
        for n, k, before in reversed(steps):
            if not before >> at & 1:
                counts[n] = counts.get(n, 0) + k
                at -= k * n
        return counts, slack

    def fill(self) -> None:
        counts, slack = self.pattern()
        for _ in range(1 if slack else min(len(self.waiting[n]) // k for n, k in counts.items())):
            pieces = [self.take(n) for n, k in counts.items() for _ in range(k)]
            if slack and self.lengths:
                key, start, ids, n = self.take(self.lengths[-1])
                if slack < len(ids) // 4:
                    self.wait((key, start + slack, ids[4 * slack :], n))
                pieces.append((key, start, ids[: 4 * slack], n))
            self.emit(pieces)

    def end(self) -> None:
        while self.held and sum(n * len(x) for n, x in self.waiting.items()) >= self.capacity:
            self.fill()
        rest = [self.take(self.lengths[-1]) for _ in range(self.held)]
        total = sum(len(x[2]) // 4 for x in rest)
        while total:
            room = size = 1 << (total.bit_length() - 1)
            pieces = []
            while room:
                key, start, ids, n = rest.pop(0)
                if len(ids) // 4 > room:
                    rest.insert(0, (key, start + room, ids[4 * room :], n))
                    ids = ids[: 4 * room]
                pieces.append((key, start, ids, n))
                room -= len(ids) // 4
            self.emit(pieces)
            total -= size


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset; ``with_ids`` adds the ids (little-endian 32-bit binary).

    ``capacity`` must be a power of two. Sequence ids are unique: the task's number and a count within it.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    fields = [T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)

    def run(batches):
        table, end = words(vocabulary), struct.pack("<I", end_id)
        packer = Packer(capacity, window, TaskContext.get().partitionId() << 33)
        kinds: list = []

        def flush():
            cols = list(zip(*packer.out, strict=True)) if packer.out else [[]] * 8
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds + [pa.int64()] * 6 + [pa.binary()] * with_ids, strict=False)], names=schema.names)

        for batch in small(batches):
            kinds = [batch.schema.field(0).type]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(key, (table.ids(text) if text else b"") + end)
                if len(packer.out) >= 5000:
                    yield flush()
        if kinds:
            packer.end()
            yield flush()

    short_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)
