"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Every whole text gives a fixed row of statistics. Random Fourier features approximate a Gaussian kernel on the
standardised statistics; each partition of a bounded labelled sample sums its normal equations, the sums are added
and solved. A part of the sample that the ridge fit doesn't see calibrates the scores by isotonic regression, joined
by straight lines between its steps. Scoring is one pass without a shuffle.

Defined cases: null and empty texts have the statistics of a text without words; without labels of both classes every score is 0.5;
null labels and label rows without a document are not used; of several labels of an id the largest counts; repeated rows score alike; a tie
(score 0.5) is predicted 1; texts of any length are measured whole, one at a time; an empty table gives no rows; only id and text of the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import small
from .common import bounded_labels, crc_mod, short_batches, written
from .quality_rules import WORDS, histograms
from .textstats import duplicate_lines

#: The sample holds at most so many documents of class 0 and of class 1; a third of it calibrates.
SAMPLE_PER_CLASS, FEATURES, RIDGE, WIDTH, SEED = (6000, 6000), 384, 1e-3, 0.35, 5
#: Statistics per text.
SIZE = 21


def statistics(text: bytes) -> np.ndarray:
    """The row of statistics of a whole text."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    chars, common = histograms(text, words)
    total = max(1, chars.sum())
    m = max(1, n)
    lines = text.count(b"\n") + 1
    return np.array([
        np.log1p(n), *np.sqrt(chars / total), np.sqrt(1 - common[len(WORDS)] / m), np.sqrt((common > 0).sum() / len(WORDS)),
        len(set(words)) / m, np.sqrt(sum(map(eq, words, words[1:])) / m), sum(map(bytes.isupper, words)) / m, sum(map(bytes.istitle, words)) / m,
        np.sqrt(text.count(b"!!") / m), np.sqrt(words.count(b"|") / m), np.log1p(size / m), np.log1p(m / lines), np.sqrt(duplicate_lines(text) / lines), np.sqrt((text.count(b".") + text.count(b",")) / m),
    ])


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.stack([statistics(t or b"") for t in texts]) if texts else np.empty((0, SIZE))


def lift(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of the standardised statistics, with a constant."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, WIDTH, (SIZE, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / scale, -5, 5)
    return np.hstack([np.cos(z @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the mean x and the level of each block, levels rising."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + t]
    return np.array([t / n for _, n, t in blocks]), np.array([s / n for s, n, _ in blocks])


class Model:
    def __init__(self, mean, scale, weights, at, level):
        self.mean, self.scale, self.weights, self.at, self.level = mean, scale, weights, at, level

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        raw = lift(matrix(texts), self.mean, self.scale) @ self.weights
        return np.clip(np.interp(raw, self.at, self.level), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", where=None, per_class: tuple[int, int] = SAMPLE_PER_CLASS) -> Model | None:
    """Fit on at most ``sum(per_class)`` labelled documents."""
    wanted = bounded_labels(labels, label, per_class, F.lit(True) if where is None else where)
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")  # at most sum(per_class) rows
    rows = sample.select("text", "label", (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(3)) == 0).alias("calibrate"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1), b.column(2)], names=["x", "label", "calibrate"])

    measured = written(rows.mapInArrow(measure, "x binary, label int, calibrate boolean"))  # a bounded table of statistics
    parts = measured.where("not calibrate")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, y = 0, np.zeros((2, SIZE)), [0, 0]
        for b in batches:
            x = np.array([np.frombuffer(r) for r in b.column(0).to_pylist()]).reshape(-1, SIZE)
            n, s, y = n + len(x), s + np.stack([x.sum(0), (x * x).sum(0)]), [y[k] + b.column(1).to_pylist().count(k) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()]), pa.array([y[0]]), pa.array([y[1]])], names=["n", "s", "a", "b"])

    got = parts.mapInArrow(moments, "n long, s binary, a long, b long").collect()
    n, zeros, ones = (sum(r[k] for r in got) for k in ("n", "a", "b"))
    if not zeros or not ones:
        return None
    first = sum(np.frombuffer(r.s).reshape(2, SIZE) for r in got) / n
    mean, scale = first[0], np.sqrt(np.maximum(first[1] - first[0] ** 2, 1e-6))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            z = lift(np.array([np.frombuffer(r) for r in b.column(0).to_pylist()]).reshape(-1, SIZE), mean, scale)
            y = np.array(b.column(1).to_pylist(), dtype=np.float64)
            a += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()])], names=["a"])

    sums = [np.frombuffer(r.a).reshape(FEATURES + 1, FEATURES + 2) for r in parts.coalesce(8).mapInArrow(normal, "a binary").collect()]
    total = np.sum(sums, axis=0)
    weights = np.linalg.solve(total[:, :-1] + RIDGE * np.eye(FEATURES + 1), total[:, -1])
    held = measured.where("calibrate").select("x", "label").collect()
    if not held:
        return Model(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    raw = lift(np.array([np.frombuffer(r.x) for r in held]), mean, scale) @ weights
    return Model(mean, scale, weights, *isotonic(raw, np.array([r.label for r in held], dtype=np.float64)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, score double, predicted int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            p = model.score(texts) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    short_batches(docs.sparkSession)
    return docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that aren't held out, score all."""
    return score(docs, fit(docs, labels, where=crc_mod(F.col("doc_id"), 3) != 1))
