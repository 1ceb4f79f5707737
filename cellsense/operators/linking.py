"""Entity linking: scoring of candidates, matching of row graphs, votes, and filling of cells.

Everything is keyed by (table_id, row_idx, col_idx), so a missing candidate never shifts a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.celltypes import is_float
from ..functions.similarity import candidate_score, edit_distance

ROW = ["table_id", "row_idx"]
CELL = ["table_id", "row_idx", "col_idx"]

#: Predicates of this length or less before the name are ontology ones; numbers this near are equal.
ONTOLOGY, NEAR = "http://dbpedia.org/ontology/", 0.2


def score_candidates(cands: DataFrame) -> DataFrame:
    """cands(cell key.., cell, name, alias, row_score, cell_score) with edit, both scores over the cell's largest (at least 1), and final."""
    w = Window.partitionBy(*CELL)
    edit = candidate_score(edit_distance(F.col("cell"), F.col("name")), F.when(F.col("alias").isNotNull(), edit_distance(F.col("cell"), F.col("alias"))))
    norm = lambda c: F.col(c) / F.greatest(F.max(c).over(w), F.lit(1))
    out = cands.withColumn("edit", edit).withColumn("row_norm", norm("row_score")).withColumn("cell_norm", norm("cell_score"))
    return out.withColumn("final", F.col("row_norm") + F.col("cell_norm") - 2 * F.col("edit"))


def winning_entity(scored: DataFrame, order: str = "entity") -> DataFrame:
    """The candidate with the highest final score of each cell; the first among equals."""
    w = Window.partitionBy(*CELL).orderBy(F.desc(F.round("final", 12)), order)
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cell_candidates(cells: DataFrame, index: DataFrame) -> DataFrame:
    """(cell key, entity) of cells(cell key, value) by index(value, entity)."""
    return cells.select(*CELL, "value").join(index.select("value", "entity").distinct(), "value").select(*CELL, "entity")


def match_entities(subjects: DataFrame, objects: DataFrame, triples: DataFrame, ontology: str | None = ONTOLOGY) -> DataFrame:
    """(table_id, row_idx, col_idx, s, p, o): triples between a row's subject candidates and its other columns' candidates.

    subjects(table_id, row_idx, s), objects(table_id, row_idx, col_idx, o). Candidates meet triples first and rows last,
    so no product of candidates is built."""
    graph = triples.where(F.col("p").startswith(ontology)) if ontology else triples
    left = subjects.join(graph.where("o_kind = 'uri'").select("s", "p", "o"), "s")
    return left.join(objects, [*ROW, "o"]).select(*CELL, "s", "p", "o").distinct()


def _number(c: Column) -> Column:
    return F.when(is_float(c), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))


def fuzzy_equal(cell: Column, literal: Column, clean_literal: Column) -> Column:
    """Numbers within NEAR of each other, or the literal's clean text equal to the cell."""
    a, b = _number(F.replace(cell, F.lit(","), F.lit(""))), _number(literal)
    return F.coalesce(F.abs(a - b) < NEAR, F.lit(False)) | (clean_literal == cell)


def match_literals(subjects: DataFrame, literals: DataFrame, triples: DataFrame) -> DataFrame:
    """(table_id, row_idx, col_idx, s, p, o, exact): literal cells matched exactly, else (no exact match) fuzzily.

    subjects(table_id, row_idx, s), literals(table_id, row_idx, col_idx, value). The join is on the row; each row has
    few literal columns and each subject few literals."""
    graph = triples.where("o_kind = 'literal'").select("s", "p", "o")
    near = subjects.join(graph, "s").join(literals, ROW)
    hit = near.withColumn("exact", F.col("o") == F.col("value")).where(F.col("exact") | fuzzy_equal(F.col("value"), F.col("o"), F.lower(F.trim("o"))))
    best = F.max(F.col("exact").cast("int")).over(Window.partitionBy(*CELL))
    return hit.withColumn("_b", best).where("exact or _b = 0").select(*CELL, "s", "p", "o", "exact").distinct()


def vote_subject(matches: DataFrame, subject_cells: DataFrame) -> DataFrame:
    """(table_id, row_idx, s, votes): the subject seen in most columns, plus its likeness to the cell; ties by code point.

    matches(cell key, s, ..), subject_cells(table_id, row_idx, cell, s, name)."""
    seen = matches.groupBy(*ROW, "s").agg(F.count_distinct("col_idx").alias("cols"))
    votes = seen.join(subject_cells, [*ROW, "s"]).withColumn("votes", F.col("cols") + 1 - edit_distance(F.col("cell"), F.col("name")))
    w = Window.partitionBy(*ROW).orderBy(F.desc(F.round("votes", 12)), "s")
    return votes.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*ROW, "s", "votes")


def keep_winning(matches: DataFrame, winners: DataFrame) -> DataFrame:
    return matches.join(winners.select(*ROW, "s"), [*ROW, "s"], "left_semi")


def vote_predicate(matches: DataFrame, ontology: str | None = ONTOLOGY) -> DataFrame:
    """(table_id, col_idx, p, n): the most frequent predicate of each column, the first seen among equals."""
    rows = matches.where(F.col("p").startswith(ontology)) if ontology else matches
    counts = rows.groupBy("table_id", "col_idx", "p").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"))
    w = Window.partitionBy("table_id", "col_idx").orderBy(F.desc("n"), "first", "p")
    return counts.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("table_id", "col_idx", "p", "n")


def fill_entities(matches: DataFrame, winners: DataFrame) -> DataFrame:
    """(cell key, entity): objects by the column's winning predicate (the last one counts), and each row's subject, taken from the
    first column that has one."""
    hits = matches.join(winners.select("table_id", "col_idx", "p"), ["table_id", "col_idx", "p"])
    objects = hits.groupBy(*CELL).agg(F.max("o").alias("entity"))
    subject = hits.groupBy(*ROW).agg(F.min_by("s", F.struct("col_idx", "s")).alias("entity"))
    return objects.unionByName(subject.withColumn("col_idx", F.lit(-1)).select(*CELL, "entity"))


def linkable(triples: DataFrame, cands: DataFrame) -> DataFrame:
    """Candidates that have outgoing triples."""
    return cands.join(triples.select(F.col("s").alias("entity")).distinct(), "entity", "left_semi")


def row_context(cells: DataFrame) -> DataFrame:
    """(cell key, context): words of the other cells of the row, in order of the columns. One window per row, no self-join."""
    w = Window.partitionBy(*ROW)
    rows = cells.withColumn("_all", F.collect_list(F.struct("col_idx", "value")).over(w))
    other = F.filter(F.array_sort("_all"), lambda x: x.col_idx != F.col("col_idx"))
    return rows.select(*CELL, F.split(F.trim(F.array_join(F.transform(other, lambda x: x.value), " ")), r"\s+").alias("context"))


def header_context(headers: DataFrame) -> DataFrame:
    """(table_id, context): words of a table's headers."""
    return headers.groupBy("table_id").agg(F.array_sort(F.flatten(F.collect_list(F.split(F.lower("header"), r"\W+")))).alias("context"))


def unlinked(cells: DataFrame, exported: DataFrame) -> DataFrame:
    """Cells that an earlier export doesn't have yet: the rest of a resumed run, with their own row numbers."""
    return cells.join(exported.select(*CELL), CELL, "left_anti")


def repeated_cells(cells: DataFrame) -> DataFrame:
    """(value, n) over the corpus."""
    return cells.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def distinct_cells(cells: DataFrame) -> DataFrame:
    """(value_raw, value, value_for_query, n): what has to be looked up once."""
    return cells.groupBy("value_raw", "value", "value_for_query").agg(F.count(F.lit(1)).alias("n"))
