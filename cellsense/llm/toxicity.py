"""Toxicity from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams and of the word itself; a document's is
the mean over its words; two softmax outputs stand on it. Vectors and outputs are trained together (Adam) on a bounded
sample of labelled rows. The model is linear in the document, so a word adds one fixed number to the logit: scoring
looks words up in a table that is filled on first use, unseen spellings through the n-grams they share.

Defined cases: null and empty texts have no words and score by the bias alone; without labels of both classes every
score is 0.5; null labels and label rows without a document are not used; of several labels of an id the largest
counts, and of several texts the smallest; repeated rows score alike; texts of any length are scored whole; a tie (score 0.5) is predicted 1;
an empty table gives no rows; only id and text of the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import small
from .common import Scratch, bounded_labels, crc_mod, short_batches

#: The training sample: at most so many documents of class 0 and of class 1, so many bytes of text in all and in one text.
SAMPLE_PER_CLASS, SAMPLE_BYTES, SAMPLE_TEXT = (6000, 2000), 40_000_000, 1_000_000
BUCKET_BITS, DIM, GRAMS, SCALE, EPOCHS, BATCH, RATE, DECAY = 16, 8, (3, 4, 5), 60.0, 4, 50, 0.01, 1e-6
BUCKETS, ODD, MIN_STEPS = 1 << BUCKET_BITS, 16777619, 800
STRIP = b".,;:!?\"'()[]{}*#$%&|<>-_"


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the n-grams of each word, marked at both ends, and of the word itself: (word's number, bucket)."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    marked = [b"<" + w + b">" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    start = np.r_[0, np.cumsum(size)[:-1]]
    x = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(x)) - start[word]
    power = (np.uint32(ODD) ** np.arange(int(size.max()), dtype=np.uint32)).astype(np.uint32)
    out = [(np.arange(len(words)), np.add.reduceat(x * power[place], start) ^ np.uint32(0x5BD1E995))]
    for n in GRAMS:
        h = sum(x[k : len(x) - n + 1 + k] * power[k] for k in range(n)) if len(x) >= n and size.max() >= n else np.empty(0, np.uint32)
        inside = place[: len(h)] + n <= size[word[: len(h)]] - (n == size[word[: len(h)]])
        out.append((word[: len(h)][inside], h[inside] + np.uint32(n)))
    who, h = (np.concatenate([o[i] for o in out]) for i in (0, 1))
    h = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return who, (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bag(text: bytes) -> list[bytes]:
    return [x for w in text.lower().split() if (x := w.strip(STRIP))]


class Model:
    """Vectors of the n-grams, outputs and bias."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.v = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
        self.u = np.zeros((DIM, 2), np.float32)
        self.u[:, 1] = rng.uniform(-1, 1, DIM)
        self.b = np.zeros(2, np.float32)

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> None:
        table: dict[bytes, int] = {}
        docs = []
        for t in texts:
            w = np.array([table.setdefault(x, len(table)) for x in bag(t)], np.int64)
            i, c = np.unique(w, return_counts=True)
            docs.append((i, (c * (SCALE / max(1, len(w)))).astype(np.float32)))
        who, flat = grams(list(table))
        flat = flat[np.argsort(who, kind="stable")]
        size = np.bincount(who, minlength=len(table))
        start = np.r_[0, np.cumsum(size)]
        del table, who
        rng, step = np.random.default_rng(seed), 0
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.v, self.u, self.b)]
        per_epoch = max(1, len(docs) // BATCH)
        for _ in range(max(epochs, -(-MIN_STEPS // per_epoch))):
            for part in np.array_split(rng.permutation(len(docs)), per_epoch):
                step += 1
                words, weights = (np.concatenate([docs[i][k] for i in part]) for k in (0, 1))
                doc = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
                used, at = np.unique(words, return_inverse=True)
                n = size[used]
                ids = flat[np.repeat(start[used] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                e = np.add.reduceat(self.v[ids], np.r_[0, np.cumsum(n)[:-1]], axis=0) / n[:, None] if len(ids) else np.zeros((0, DIM), np.float32)
                sums = lambda rows, to, m: np.stack([np.bincount(to, rows[:, k], m) for k in range(DIM)], 1).astype(np.float32)
                h = sums(e[at] * weights[:, None], doc, len(part))
                z = h @ self.u + self.b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), y[part]] -= 1
                p /= len(part)
                de = sums((p @ self.u.T)[doc] * weights[:, None], at, len(used)) / n[:, None]
                grad = sums(np.repeat(de, n, axis=0), ids, BUCKETS) + DECAY * self.v, h.T @ p, p.sum(0)
                for x, g, (m, s) in zip((self.v, self.u, self.b), grad, state, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def line(self) -> tuple[np.ndarray, float]:
        """What each n-gram bucket adds to the logit of class 1, and the bias."""
        return (self.v @ (self.u[:, 1] - self.u[:, 0])).astype(np.float64) * SCALE, float(self.b[1] - self.b[0])


class Words:
    """Logits of words as they stand in a text (lower case), computed in blocks on first use; the table starts anew when full."""

    def __init__(self, line: np.ndarray, most: int = 200_000):
        self.line, self.most, self.known = line, most, {}

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """The mean logit of each text's words, 0 without words."""
        split = [t.lower().split() if t else [] for t in texts]
        new = list({w for ws in split for w in ws}.difference(self.known))
        if len(self.known) + len(new) > self.most:
            self.known = {}
            new = list({w for ws in split for w in ws})
        bare = [w.strip(STRIP) for w in new]
        who, ids = grams(bare)
        total = np.bincount(who, self.line[ids], len(new)) / np.maximum(np.bincount(who, minlength=len(new)), 1)
        self.known.update((w, x if b else None) for w, x, b in zip(new, total.tolist(), bare, strict=True))
        out = np.zeros(len(texts))
        for i, ws in enumerate(split):
            got = [x for x in map(self.known.__getitem__, ws) if x is not None]
            if got:
                out[i] = sum(got) / len(got)
        return out


def sample(docs: DataFrame, labels: DataFrame, label: str, where, per_class: tuple[int, int] = SAMPLE_PER_CLASS, max_bytes: int = SAMPLE_BYTES, max_text: int = SAMPLE_TEXT) -> tuple[list[bytes], np.ndarray]:
    """The bounded training sample: whole texts in the order of the hash of the id; a text longer than ``max_text`` or than what is left
    of ``max_bytes`` is passed over. Sizes are looked at first, so the driver never holds more than ``max_bytes`` of text."""
    scratch = Scratch(docs.sparkSession)
    wanted = bounded_labels(labels, label, per_class, where)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")  # at most sum(per_class) ids
    rows = scratch.write(rows.where(F.octet_length("text") <= max_text).groupBy("doc_id", "label").agg(F.min("text").alias("text")).withColumn("_h", F.xxhash64("doc_id")))
    left, chosen = max_bytes, []
    for r in sorted(rows.select("_h", "doc_id", F.octet_length("text").alias("n")).collect()):
        if r.n <= left:
            left -= r.n
            chosen.append((r.doc_id,))
    picked = docs.sparkSession.createDataFrame(chosen, T.StructType([docs.schema["doc_id"]]))
    texts, y = [], []
    for r in rows.join(F.broadcast(picked), "doc_id").repartition(8, "_h").sortWithinPartitions("_h", "doc_id").toLocalIterator():  # max_bytes in all
        texts.append(r.text.encode())
        y.append(r.label)
    scratch.drop()
    return texts, np.array(y, np.int64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", where=None) -> tuple[np.ndarray, float] | None:
    texts, y = sample(docs, labels, label, F.lit(True) if where is None else where)
    if len(set(y.tolist())) < 2:
        return None
    model = Model()
    model.train(texts, y)
    return model.line()


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    line, bias = model if model else (np.zeros(BUCKETS), 0.0)
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((line.astype(np.float32), bias))  # a fixed 256 kB
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, score double, predicted int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, bias = shared.value
        words = Words(line)
        for batch in small(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            out = bias + words.score(texts)
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that aren't held out, score all."""
    return score(docs, fit(docs, labels, where=crc_mod(F.col("doc_id"), 5) != 0))
