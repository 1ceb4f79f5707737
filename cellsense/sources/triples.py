"""Knowledge graphs as a frame of triples(s, p, o, o_kind, o_datatype, o_lang)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLES = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"
#: A line of N-Triples. The literal's group repeats by possessive steps, so a text of any length costs no stack.
_NODE = r"(?:<([^>]*)>|(_:[^\s<>\x22]+))"
_LINE = rf'^\s*{_NODE}\s+<([^>]*)>\s+(?:{_NODE}|"((?:[^"\\]++|\\.)*+)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'


def _unescaped(c: Column) -> Column:
    """A literal's text: its escapes are those of JSON; a text that isn't valid there stays as it is."""
    text = F.from_json(F.concat(F.lit('{"t":"'), c, F.lit('"}')), "t string", {"allowUnquotedControlChars": "true"})["t"]
    return F.when(F.instr(c, "\\") == 0, c).otherwise(F.coalesce(text, c))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files, read line by line, so a file of any size is split; see ``unread_lines`` for what isn't one."""
    return parse_ntriples(spark.read.text(path))


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """Triples of lines(value) of N-Triples."""
    t = lines.where(F.col("value").rlike(_LINE))
    g = lambda i: F.regexp_extract("value", _LINE, i)
    none = lambda c: F.when(c != "", c)
    one = F.coalesce(none(g(4)), none(g(5)))
    kind = F.when(g(5) != "", "blank").when(g(4) != "", "uri").otherwise("literal")
    return t.select(F.coalesce(none(g(1)), g(2)).alias("s"), g(3).alias("p"), F.coalesce(one, _unescaped(g(6))).alias("o"), kind.alias("o_kind"), none(g(8)).alias("o_datatype"), none(g(7)).alias("o_lang"))


def unread_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of lines that hold something but no triple: a file of Turtle needs ``read_turtle``."""
    t = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    return t.where(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def read_turtle(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Triples of Turtle files: prefixes, bases, lists of predicates and objects, blank nodes, collections, long literals.

    A file is the unit of work, as its prefixes hold for all of it. A file that isn't Turtle ends the query with its name and the
    place, or (not ``strict``) gives the triples before that place. Blank nodes carry the name of their file."""
    return parse_turtle(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"), strict)


def parse_turtle(texts: DataFrame, strict: bool = True) -> DataFrame:
    """Triples of texts(file, value) of Turtle."""
    from .turtle import parse

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, text in zip(b.file, b.value, strict=True):
                yield pd.DataFrame(parse(text, name.rsplit("/", 1)[-1], strict), columns=["s", "p", "o", "o_kind", "o_datatype", "o_lang"], dtype=object)

    return texts.mapInPandas(run, TRIPLES)


def triples_of(df: DataFrame, subject: Column, uris: dict[str, Column] | None = None, literals: dict[str, Column] | None = None, lang: str | None = None) -> DataFrame:
    """Triples of a relational frame: one per row and predicate, in a single pass."""
    made = [F.struct(F.lit(p).alias("p"), c.cast("string").alias("o"), F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_lang")) for p, c in (uris or {}).items()]
    made += [F.struct(F.lit(p).alias("p"), c.cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(lang).cast("string").alias("o_lang")) for p, c in (literals or {}).items()]
    rows = df.select(subject.cast("string").alias("s"), F.inline(F.array(*made))).where("o is not null")
    return rows.select("s", "p", "o", "o_kind", F.lit(None).cast("string").alias("o_datatype"), "o_lang")


def merge(*graphs: DataFrame) -> DataFrame:
    """Union of graphs, each triple once."""
    return reduce(DataFrame.unionByName, graphs).distinct()


def frequent_resources(cells: DataFrame, more_than: int = 1) -> DataFrame:
    """(value, n) of the cell values that occur more than once: those whose graphs are worth keeping at hand."""
    return cells.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def prefix_lookup(triples: DataFrame, queries: DataFrame, label: str, type_: str, limit: int = 5, classes: str = "", drop: tuple[str, ...] = ("Agent", "Thing")) -> DataFrame:
    """(q, label, classes) of at most ``limit`` labels that start with each query (q), with the classes of their entities.

    A label is entered under its beginnings of the lengths that queries have, so the join is an equality of whole queries, and
    only labels that do start with one meet it."""
    from pyspark.sql import Window

    asked = queries.select("q", F.lower("q").alias("start")).where(F.length("q") > 0)
    lengths = sorted(asked.agg(F.collect_set(F.length("start"))).first()[0])  # one number per distinct length
    labels = triples.where(F.col("p") == label).select("s", F.col("o").alias("label"), F.lower("o").alias("low"))
    starts = F.array(*[F.when(F.length("low") >= n, F.substring("low", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    kinds = triples.where((F.col("p") == type_) & F.col("o").startswith(classes)).select("s", F.substring_index("o", "/", -1).alias("class")).where(~F.col("class").isin(*drop))
    hits = labels.select("s", "label", F.explode(F.array_compact(starts)).alias("start")).join(asked, "start")
    top = hits.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.length("label"), "label", "s"))).where(F.col("n") <= limit)
    return top.join(kinds, "s", "left").groupBy("q", "label").agg(F.array_sort(F.collect_set("class")).alias("classes"))
