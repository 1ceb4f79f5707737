"""Quality rules by distribution divergence.

A first pass sums, per language, the character classes and the counts of a fixed list of common words over all
documents of at least ``guard_words`` words: the language references. A reference needs ``LEAST_DOCS`` such documents. A second pass compares
each document's two histograms with the references by Jensen-Shannon distance, with its own counts left out of its language's, and keeps the
smaller distance of all languages, so a wrong or missing language mark does no harm, and a mark that no other document has is no
reference. A document fails when it is far from every reference; short ones are guarded, as a small histogram is far from any reference by chance alone.

Both passes work on whole texts, without a shuffle of rows: the first sends one sum per (language, cell) and task.

Defined cases: null and empty texts have no words and fail the base rule; null languages and those of one document give no reference, and without a column
``lang`` all documents give one; without any reference the distances are null and only the base rules speak; repeated rows are judged alike; a distance at its limit (a tie) passes; texts of any length are read whole,
one at a time; an empty table gives no rows; other columns are not read by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import small
from .common import short_batches
from .textstats import CLASSES, SPACE, SYMBOLS, class_counts, duplicate_lines, repeated_words

#: Common words of the four languages (fixed values).
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so dass kann aus sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont la avec son aux d'un",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque",
}
WORDS = sorted({w for x in COMMON.values() for w in x.split()})

#: Limits on the Jensen-Shannon distance (0 to 1) and the least words and characters for which they count.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, GUARD_WORDS, GUARD_CHARS = 0.3, 0.27, 50, 200
#: Documents of a language that make a reference, at least.
LEAST_DOCS = 2
#: Added to the word limit, divided by the root of the number of words: what chance alone puts between a sample and its source.
WORD_ALLOWANCE = 1.2

_index = {w.encode(): i for i, w in enumerate(WORDS)}


class Bins(dict):
    """The bin of a word as it stands in a text; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        out = self[word] = _index.get(word.strip(b".,;:!?").lower(), len(WORDS))
        return out


_bins = Bins()


def histograms(text: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by character class, and by common word with all other words last."""
    got = np.fromiter(map(_bins.__getitem__, words), dtype=np.int64, count=len(words))
    return class_counts(text), np.bincount(got, minlength=len(WORDS) + 1)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance (base 2, 0 to 1) of each row of counts ``p`` to the distribution ``q``, or to its own row of ``q``."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def references(docs: DataFrame, guard_words: int = GUARD_WORDS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language of LEAST_DOCS documents or more, the counts of character classes and of common words over all of them."""
    size = len(CLASSES) + len(WORDS) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in small(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if lang is not None and text and len(words := text.split()) >= guard_words:
                    sums[lang] = sums.get(lang, 0) + np.concatenate((*histograms(text, words), [1]))
        _bins.clear()  # a worker lives on after its task
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "counts"])

    short_batches(docs.sparkSession)
    cells = docs.select("lang" if "lang" in docs.columns else F.lit("").alias("lang"), "text").mapInArrow(run, "lang string, counts array<long>")
    total = cells.groupBy("lang").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(size)]).where(F.col(f"c{size - 1}") >= LEAST_DOCS)
    table = total.toArrow()  # one row of fixed size per language
    counts = np.array([c.to_numpy() for c in table.columns[1:]], dtype=np.float64).T
    return {lang: (x[: len(CLASSES)], x[len(CLASSES) : -1]) for lang, x in sorted(zip(table.column("lang").to_pylist(), counts, strict=True), key=lambda r: r[0])}


def nearest(counts: np.ndarray, own: list[str | None], refs: dict[str, np.ndarray]) -> np.ndarray:
    """Each row's smallest distance to the references; ``own`` is the language whose reference holds the row, whose counts are then left out there."""
    out = np.full(len(counts), np.inf)
    for lang, total in refs.items():
        far = jensen_shannon(counts, total / max(total.sum(), 1))
        if mine := [i for i, x in enumerate(own) if x == lang]:
            rest = total - counts[mine]
            far[mine] = jensen_shannon(counts[mine], rest / np.maximum(rest.sum(axis=1, keepdims=True), 1))
        out = np.minimum(out, far)
    return out


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


def judge(docs: DataFrame, id_col: str = "doc_id", refs: dict | None = None, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, guard_words: int = GUARD_WORDS, guard_chars: int = GUARD_CHARS, carry: list[str] | None = None) -> DataFrame:
    """The base counts, both distances (null where guarded) and the verdict of every document; ``carry`` adds columns."""
    carry = [id_col] if carry is None else carry
    refs = references(docs, guard_words) if refs is None else refs
    chars, commons = {k: c for k, (c, _) in refs.items()}, {k: w for k, (_, w) in refs.items()}
    added = T.StructType.fromDDL(BASE)
    schema = T.StructType([docs.schema[c] for c in carry] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, langs = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()
            n = len(texts)
            base = np.zeros((n, 5), dtype=np.int64)
            c, w = np.zeros((n, len(CLASSES))), np.zeros((n, len(WORDS) + 1))
            for i, text in enumerate(texts):
                if text:
                    words = text.split()
                    c[i], w[i] = histograms(text, words)
                    base[i] = len(words), c[i].sum() - sum(map(text.count, (SPACE[k : k + 1] for k in range(6)))), sum(map(text.count, (SYMBOLS[k : k + 1] for k in range(8)))), duplicate_lines(text), repeated_words(words)
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            own = [x if k >= guard_words else None for x, k in zip(langs, base[:, 0], strict=True)]
            far_c, far_w = nearest(c, own, chars), nearest(w, own, commons)
            on_c, on_w = (c.sum(axis=1) >= guard_chars) & bool(refs), (base[:, 0] >= guard_words) & bool(refs)
            kept = ~failed & ~(on_c & (far_c > max_char)) & ~(on_w & (far_w > max_word + WORD_ALLOWANCE / np.sqrt(np.maximum(base[:, 0], 1))))
            out = [pa.array(base[:, k]) for k in range(5)] + [pa.array(failed), pa.array(far_c, mask=~on_c), pa.array(far_w, mask=~on_w), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([batch.column(2 + k) for k in range(len(carry))] + out, names=schema.names)
        _bins.clear()

    short_batches(docs.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    body = docs.select(F.col("text").alias("_text"), lang.alias("_lang"), *carry)
    return body.mapInArrow(run, schema)


def keep(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, with their columns."""
    names = {c: f"_doc{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(c).alias(k) for c, k in names.items()], F.col("text"), F.col("lang") if "lang" in docs.columns else F.lit("").alias("lang"))
    judged = judge(renamed, carry=list(names.values()), **limits)
    return judged.where("kept").select(*[F.col(k).alias(c) for c, k in names.items()])
