"""Token ids on disk as bit planes: fixed-size blocks of ids, transposed into byte or bit planes, each plane compressed on its own.

Layout below one folder, both Parquet so that Spark's committers and file systems hold (a task that is lost leaves nothing behind):

* ``chunks``: one row per block of at most ``block`` ids: shard, chunk (its number in the shard), first (its place in the shard),
  n_ids, planes (array of zstandard frames, lowest plane first) and docs, the chunk index: for every document that the block meets, doc_id,
  its place in the shard and its length. A document may span blocks; within a shard blocks are full but for the last one.
* ``shards``: one row per shard: shard, start (ids in all shards before it) and n_ids.

Documents are dealt to shards by ranges of doc_id (and the text's hash, so that repeated ids don't fill one shard) and sorted within,
then tokenised and encoded in one stage; one sum per shard gives the places in the whole corpus. Every chunk can be read by itself:
a piece of a document contributes its crc32, moved on by the bytes of the document that follow it, and the pieces' values
are joined by exclusive or, in any order. So a reader needs no neighbours, and a document of any length no single task.

Defined cases: null text is the empty text (its end id only); a null doc_id comes first; repeated rows are written as often as they come,
equal ids in the order of the text's hash; texts of any length are tokenised whole; an empty table writes no chunk and gives no rows; other
columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import small
from .common import short_batches

#: Ids of a block; words kept at hand by a task (about 200 bytes each, in each of two generations); zstandard's level; id at the end of a document.
BLOCK, CACHE, LEVEL, END_ID = 1 << 16, 700_000, 1, 0

#: A space within or at the end of a longer run of white space: such a text isn't cut into words. It needs a pair of AFTER, or a space at the end.
RUN = re.compile(r"\s (?:\s|\Z)")
AFTER = [" " + c for c in map(chr, range(0x3001)) if c.isspace()]


#: How a byte-level tokenizer cuts a text into pieces, and the characters that stand for the bytes it can't print (fixed values).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
SPACE, STOPS = BYTE_CHARS[32], frozenset(".,;:!?")
LATIN = {c: chr(c).encode().decode("latin-1").translate(BYTE_CHARS) for c in range(128, 0x250)}
PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class Ids(dict):
    """Little-endian 32-bit ids, by the tokenizers library, of words with the space before them.

    A byte-level tokenizer that splits before spaces (checked) never joins ids across the space before a word, so a distinct word
    is encoded once and kept, also for the worker's next task; when there are too many, those that weren't met since the last time go. Words of Latin letters are cut into pieces here and each distinct piece
    goes to the library's model; all else goes to the whole tokenizer."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import regex
        from tokenizers import Tokenizer

        text = open(path, encoding="utf-8").read()
        model = json.loads(text)
        split = [x for x in (model.get("pre_tokenizer") or {}).get("pretokenizers", [model.get("pre_tokenizer")]) if x]
        assert model["model"]["type"] == "BPE" and split[-1]["type"] == "ByteLevel" and not split[-1].get("add_prefix_space"), "a byte-level BPE file without prefix spaces is needed"
        plain = len(split) == 1 and split[0].get("use_regex", True) and not model.get("normalizer")
        self.library = Tokenizer.from_str(text)
        self.special = [x["content"] for x in model.get("added_tokens", [])]
        self.tokenize, self.old, self.pieces, self.cut, self.last = self.library.model.tokenize, {}, {}, regex.compile(PIECE).findall, "\u024f" if plain else ""

    def raw(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, shown: str) -> bytes:
        """The ids of a piece whose bytes are shown by characters."""
        if (out := self.pieces.get(shown)) is None:
            ids = [t.id for t in self.tokenize(shown)]
            out = self.pieces[shown] = PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)
        return out

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        if (out := self.old.get(word)) is not None:
            self[word] = out
            return out
        core, stop = (word[:-1], word[-1]) if word[-1:] in STOPS else (word, "")
        if core.isalpha() and max(core) <= self.last:  # most words: Latin letters, or letters and a stop
            out = self.piece(SPACE + (core if core.isascii() else core.translate(LATIN)))
            if stop:
                out += self.piece(stop)
        elif max(text := " " + word) <= self.last:
            out = b"".join([self.piece(p.encode().decode("latin-1").translate(BYTE_CHARS)) for p in self.cut(text)])
        else:
            out = self.raw(text)
        self[word] = out
        return out

    def of(self, text: str) -> bytes:
        if (text.endswith(" ") or any(x in text for x in AFTER)) and RUN.search(text) or any(s in text for s in self.special):
            return self.raw(text)
        first, *rest = text.split(" ")
        return self.raw(first) + b"".join(map(self.__getitem__, rest))


_tables: dict[str, Ids] = {}


def table(path: str) -> Ids:
    if path not in _tables:
        _tables[path] = Ids(path)
    return _tables[path]


def planes(ids: np.ndarray, kind: str = "byte", level: int = LEVEL) -> list[bytes]:
    """The block's planes, lowest first: byte i of every id, or bit i of every id."""
    import zstandard

    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    flat = rows.T if kind == "byte" else np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)
    pack = zstandard.ZstdCompressor(level=level).compress
    return [pack(np.ascontiguousarray(x).tobytes()) for x in flat]


def ids_of(stored: list[bytes], n: int) -> np.ndarray:
    """The ids of a block of ``n`` from its 4 byte planes or 32 bit planes."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    flat = np.stack([np.frombuffer(unpack(x), dtype=np.uint8) for x in stored])
    if len(stored) == 32:
        flat = np.packbits(np.unpackbits(flat, axis=1, count=n).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(flat.T).view("<u4").reshape(-1)


DOC = "place long, n_tokens long"


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block: int = BLOCK, kind: str = "byte") -> None:
    """Tokenise all documents and write their ids, in ascending order of ``id_col``, below ``path``."""
    if kind not in ("byte", "bit"):
        raise ValueError("kind is byte or bit")
    spark = docs.sparkSession
    key = docs.schema[id_col].dataType
    entry = T.StructType([T.StructField("doc_id", key), *T.StructType.fromDDL(DOC).fields])
    schema = T.StructType([*T.StructType.fromDDL("shard int, chunk long, first long, n_ids int, planes array<binary>").fields, T.StructField("docs", T.ArrayType(entry))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, shard = table(vocabulary), struct.pack("<I", end_id), TaskContext.get().partitionId()
        held, met = bytearray(), []  # ids of the block that is being filled, documents that it meets
        first = chunk = 0
        arrow = None

        def out(size: int) -> pa.RecordBatch:
            nonlocal first, chunk, met
            x = np.frombuffer(bytes(held[: 4 * size]), dtype="<u4")
            here, cut = [d for d in met if d[1] < first + size], first + size
            index = pa.StructArray.from_arrays([pa.array([d[0] for d in here], arrow), pa.array([d[1] for d in here], pa.int64()), pa.array([d[2] for d in here], pa.int64())], names=entry.names)
            row = [pa.array([shard], pa.int32()), pa.array([chunk], pa.int64()), pa.array([first], pa.int64()), pa.array([size], pa.int32()), pa.array([planes(x, kind)], pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(here)], pa.int32()), index)]
            del held[: 4 * size]
            met = [d for d in met if d[1] + d[2] > cut]
            first, chunk = cut, chunk + 1
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        for batch in small(batches):
            arrow = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = (ids.of(text) if text else b"") + end
                met.append((doc, first + len(held) // 4, len(new) // 4))
                held += new
                while len(held) >= 4 * block:
                    yield out(block)
        if held:
            yield out(len(held) // 4)

    short_batches(spark)
    tie = F.xxhash64(text_col)
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), tie.alias("tie")).repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
    dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text").select("doc_id", "text").mapInArrow(run, schema).write.mode("overwrite").parquet(f"{path}/chunks")
    # one row per shard: the partitions of the dealing, however many documents they hold
    sums = spark.read.schema(schema).parquet(f"{path}/chunks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    sums.select("shard", F.coalesce(before, F.lit(0)).cast("long").alias("start"), "n_ids").write.mode("overwrite").parquet(f"{path}/shards")


#: x ** (8 * 2 ** i) modulo the polynomial of crc32, each found by squaring the one before.
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32 (bit 31 is the constant term)."""
    out, at = 0, 1 << 31
    while at:
        if a & at:
            out ^= b
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1
        at >>= 1
    return out


_powers = [1 << 23]


def moved(crc: int, n: int) -> int:
    """What ``crc`` contributes to the crc32 of a text in which ``n`` bytes follow."""
    i = 0
    while n:
        if i == len(_powers):
            _powers.append(_times(_powers[-1], _powers[-1]))
        if n & 1:
            crc = _times(_powers[i], crc)
        n >>= 1
        i += 1
    return crc


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks with ``start``, their place in the whole corpus."""
    shards = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("_start"))
    return spark.read.parquet(f"{path}/chunks").join(shards, "shard").withColumn("start", F.col("_start") + F.col("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, worked out from the ids in the files."""
    chunks = read_chunks(spark, path).select("_start", "shard", "first", "n_ids", "planes", "docs")
    key = chunks.schema["docs"].dataType.elementType["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", key), *T.StructType.fromDDL("shard int, place long, start long, n long, part long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for base, shard, first, n, stored, index in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), strict=True):
                raw = ids_of(stored, n).tobytes()
                doc = index.values.field(0)
                rows = []
                for place, size in zip(index.values.field(1).to_pylist(), index.values.field(2).to_pylist(), strict=True):
                    a, b = max(place, first) - first, min(place + size, first + n) - first
                    rows.append((shard, place, base + place, b - a, moved(zlib.crc32(raw[4 * a : 4 * b]), 4 * (place + size - first - b))))
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, pa.int64() if i else pa.int32()) for i, c in enumerate(zip(*rows, strict=True)))], names=schema.names)

    parts = chunks.mapInArrow(run, schema)
    whole = parts.groupBy("shard", "place").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32"))
    return whole.select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """(start, ids) of the blocks that meet the ``length`` ids from place ``start`` on, cut to them; only those blocks' planes are read."""
    chunks = read_chunks(spark, path).where((F.col("start") < start + length) & (F.col("start") + F.col("n_ids") > start)).select("start", "n_ids", "planes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for at, n, stored in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = max(start, at), min(start + length, at + n)
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([ids_of(stored, n)[a - at : b - at].astype(np.int64)], pa.list_(pa.int64()))], names=["start", "ids"])

    return chunks.mapInArrow(run, "start long, ids array<long>")
