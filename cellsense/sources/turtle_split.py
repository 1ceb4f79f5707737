"""Turtle files of any size, read by many tasks.

A file is read in Spark's splits, line by line. Whether a line begins inside a long literal depends on all lines before it, but a line maps each of
three states (outside, inside double or single long quotes) to the state behind it, and such maps compose: every split is scanned once for all
three, a row per split is composed per file, and then every split knows its own beginning. A statement ends with a line whose last token outside
literals is a full stop; lines are gathered by statement and parsed, each with the prefixes in force there."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import staged
from .turtle import Failure, state_after, statements

#: What a line holds outside long literals: the beginning of one, a short literal, an address, a comment, an escape.
_OUTSIDE = re.compile(r"""(?P<double>\"{3})|(?P<single>'{3})|(?P<skip>"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|<[^<>"{}|^`\\\x00-\x20]*+>|\\.)|(?P<comment>\#)""", re.VERBOSE)
_END = {1: re.compile(r'(?:[^"\\]|\\.|"(?!""))*+"{3}', re.DOTALL), 2: re.compile(r"(?:[^'\\]|\\.|'(?!''))*+'{3}", re.DOTALL)}
#: A piece that may declare a prefix or a base.
ORDERS = r"(?i)(^|\n)\s*@?(prefix|base)\b"


def scan(line: str, state: int) -> tuple[int, bool]:
    """The state behind a line (0 outside, 1 and 2 inside double and single long quotes), and whether a statement ends with it."""
    at, n = 0, len(line)
    if state == 0 and '"' not in line and "'" not in line and "#" not in line:
        return 0, line.rstrip().endswith(".")
    last = 0  # where the last literal or address ends
    while at < n:
        if state:
            m = _END[state].match(line, at)
            if not m:
                return state, False
            at = last = m.end()
            state = 0
            continue
        m = _OUTSIDE.search(line, at)
        if not m:
            break
        if m.lastgroup == "comment":
            n = m.start()
            break
        at = m.end()
        if m.lastgroup == "skip":
            last = at
        else:
            state = 1 if m.lastgroup == "double" else 2
    return state, state == 0 and line[last:n].rstrip().endswith(".")


def tagged(lines: DataFrame) -> DataFrame:
    """(file, block, i, value, ends, behind): place of each line in its split, and for each of the three states that the split may begin in, the statements that
    have ended before the line, and the state and the statements behind it. lines(file, block, value) in the order of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, i = None, 0
        states, ended = [0, 1, 2], [0, 0, 0]
        for batch in batches:
            for start in range(0, batch.num_rows, 5000):
                part = batch.slice(start, 5000)
                index, before, behind = [], [], []
                for file, block, value in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (file, block) != here:
                        here, i, states, ended = (file, block), 0, [0, 1, 2], [0, 0, 0]
                    index.append(i)
                    before.append(list(ended))
                    known = {}
                    for k, s in enumerate(states):
                        if s not in known:
                            known[s] = scan(value, s)
                        states[k], closes = known[s]
                        ended[k] += closes
                    behind.append([*states, *ended])
                    i += 1
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(index, pa.int64()), part.column(2), pa.array(before, pa.list_(pa.int64())), pa.array(behind, pa.list_(pa.int64()))], names=["file", "block", "i", "value", "ends", "behind"])

    return lines.mapInArrow(run, "file string, block long, i long, value string, ends array<long>, behind array<long>")


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    """(file, block, state, first): in which state each split of a file begins, and how many statements end before it."""
    state = first = 0
    out = []
    for r in rows.sort_values("block").itertuples():
        out.append((r.file, r.block, state, first))
        first += int(r.behind[3 + state])
        state = int(r.behind[state])
    return pd.DataFrame(out, columns=["file", "block", "state", "first"])


def _declared(rows: pd.DataFrame) -> pd.DataFrame:
    """(file, states): the prefixes and the base behind each piece of a file that changes them, in order."""
    states: list[dict] = []
    prefixes, base = {}, ""
    for r in rows.sort_values("statement").itertuples():
        after, new = state_after(r.text, prefixes, base)
        if (after, new) != (prefixes, base):
            prefixes, base = after, new
            states.append({"statement": r.statement, "prefixes": dict(prefixes), "base": base})
    return pd.DataFrame({"file": [rows.file.iloc[0]], "states": [states]})


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, statement, text): each statement of the files, with the comments and directives before it; what follows the last one is a piece too."""
    text = spark.read.option("lineSep", "\n").text(path)
    lines = staged(tagged(text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")))
    ends = lines.groupBy("file", "block").agg(F.max_by("behind", "i").alias("behind"))
    starts = ends.groupBy("file").applyInPandas(_composed, "file string, block long, state int, first long")
    placed = lines.join(starts, ["file", "block"]).withColumn("statement", F.col("first") + F.get("ends", F.col("state")))
    held = F.array_sort(F.collect_list(F.struct("block", "i", "value")))
    return placed.groupBy("file", "statement").agg(F.array_join(F.transform(held, lambda x: x.value), "\n").alias("text"))


def read_turtle_split(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Triples of Turtle files, each of which many tasks read; the triples that ``read_turtle`` gives, but for the names of nodes without one.

    A statement that isn't Turtle ends the query with its file and number, or (not ``strict``) gives its triples before that place, and the other statements
    theirs. Statements that end and begin within a line stay together; the prefixes of a file are handed to all its pieces, one set per change."""
    from .triples import TRIPLES

    every = staged(pieces(spark, path))
    orders = every.where(F.col("text").rlike(ORDERS)).groupBy("file").applyInPandas(_declared, "file string, states array<struct<statement:long,prefixes:map<string,string>,base:string>>")
    force = F.element_at(F.filter("states", lambda s: s.statement < F.col("statement")), -1)
    known = every.join(orders, "file", "left").withColumn("force", F.when(F.exists(F.coalesce("states", F.array()), lambda s: s.statement < F.col("statement")), force))
    asked = known.select("file", "statement", "text", F.coalesce(F.map_entries("force.prefixes"), F.array()).alias("prefixes"), F.coalesce("force.base", F.lit("")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]
        for batch in batches:
            out: list[tuple] = []
            for file, number, text, prefixes, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                scope = file.rsplit("/", 1)[-1]
                try:
                    statements(text, scope, out, {p["key"]: p["value"] for p in prefixes}, base, f"{number}.")
                except Failure as e:
                    if strict:
                        raise ValueError(f"statement {number}: {e}") from None
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(6)], names=names)

    return asked.mapInArrow(run, TRIPLES)
