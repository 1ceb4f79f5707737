"""The phases over all tables at once. ``analyse`` gives frames that run when they are asked for; ``annotate`` runs its phases as it is called, since each
writes a table that several later ones read."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates as Q
from ..operators import columns as C
from ..operators import concepts, linking
from ..operators.prepare import prepare
from ..sources.stage import staged


def analyse(cells: DataFrame, abbreviations: DataFrame | None = None, today: datetime.date | None = None) -> dict[str, DataFrame]:
    """Raw cells to prepared cells, classified columns and subject columns."""
    cells = prepare(cells, abbreviations, today=today)
    columns = C.classify(C.values(cells, "value", "cell_type"))
    return {"cells": cells, "columns": columns, "subjects": C.subject_columns(columns)}


def annotate(
    cells: DataFrame, triples: DataFrame, label: str, redirect: str, type_: str, ontology: str = linking.ONTOLOGY,
    abbreviations: DataFrame | None = None, paths: DataFrame | None = None, order: DataFrame | None = None, kept: bool = False,
) -> dict[str, DataFrame]:
    """From raw cells and a graph to the three annotations, besides what ``analyse`` gives:

    cea(table_id, row_idx, col_idx, entity), cpa(table_id, subject_col, col_idx, p), cta(table_id, col_idx, class).

    Values of entity columns get candidates by text; a row's subject candidates are matched with its other columns over the graph,
    literal columns exactly or else nearly; the subject that most columns speak for wins (then the likeness of its name, then code
    point); the most frequent ontology predicate of each column wins; cells get the objects of the winning predicate and
    the winning subject. A column's class is that of the ontology's branch (``paths``, ``order``: see ``choose_branch``), or without an ontology the
    most frequent type of its entities, the first by code point among equals. Rows without a match stay without annotation.

    Each phase's result is a table that the next ones read, as several of them need it. ``kept`` tells that the triples are a table already, such as
    ``TripleStore.by_subject``, whose buckets the joins then use; else they are written first.
    """
    prepared = staged(prepare(cells, abbreviations))
    columns = staged(C.classify(C.values(prepared, "value", "cell_type")))
    out = {"cells": prepared, "columns": columns, "subjects": staged(C.subject_columns(columns))}
    triples = triples if kept else staged(triples)
    subjects = out["subjects"].where("subject_col is not null").select("table_id", "subject_col")
    kinds = out["columns"].select("table_id", "col_idx", "col_class")
    placed = staged(out["cells"].join(subjects, "table_id").join(kinds, ["table_id", "col_idx"]).select(*linking.CELL, "subject_col", "col_class", "value", "value_original"))
    named = placed.where("col_class = 'NE' and value <> ''")

    labels = triples.where(F.col("p") == label).select("s", F.col("o").alias("label"))
    redirects = triples.where(F.col("p") == redirect).select(F.col("s").alias("s2"), F.col("o").alias("s"))
    found = Q.candidates(named.select(F.col("value").alias("q")).distinct(), labels, redirects)
    cand = staged(linking.cell_candidates(named, found.select(F.col("q").alias("value"), F.col("s").alias("entity"))).join(subjects, "table_id"))
    subject = cand.where("col_idx = subject_col").select("table_id", "row_idx", F.col("entity").alias("s"))
    objects = cand.where("col_idx <> subject_col").select(*linking.CELL, F.col("entity").alias("o"))
    literals = placed.where("col_class = 'LIT' and value_original <> ''").select(*linking.CELL, F.col("value_original").alias("value"))
    by_entity = linking.match_entities(subject, objects, triples, ontology=None)
    by_literal = linking.match_literals(subject, literals, triples).drop("exact")
    matches = staged(by_entity.withColumn("uri", F.lit(True)).unionByName(by_literal.withColumn("uri", F.lit(False))))

    names = labels.groupBy("s").agg(F.min(F.lower("label")).alias("name"))
    own = named.where("col_idx = subject_col").select("table_id", "row_idx", F.col("value").alias("cell"))
    winners = staged(linking.vote_subject(matches, subject.join(own, linking.ROW).join(names, "s")))
    kept = staged(linking.keep_winning(matches, winners))
    predicates = staged(linking.vote_predicate(kept, ontology))
    cells_of = kept.where("uri").join(predicates.select("table_id", "col_idx", "p"), ["table_id", "col_idx", "p"]).groupBy(*linking.CELL).agg(F.max("o").alias("entity"))
    subject_of = winners.join(subjects, "table_id").select("table_id", "row_idx", F.col("subject_col").alias("col_idx"), F.col("s").alias("entity"))
    out["cea"] = staged(cells_of.unionByName(subject_of))
    out["cpa"] = predicates.join(subjects, "table_id").select("table_id", "subject_col", "col_idx", "p")

    types = concepts.types_of(triples, type_, out["cea"].select("entity")).select("entity", concepts.class_names(F.col("type")).alias("class"))
    freq = concepts.concept_frequencies(out["cea"].join(types, "entity").select("table_id", "col_idx", "entity", "class"))
    if paths is not None:
        out["cta"] = concepts.choose_branch(freq, paths, order).select("table_id", "col_idx", F.col("annotation").alias("class"))
    else:
        best = F.min(F.struct((-F.col("freq")).alias("n"), F.col("class")))
        out["cta"] = freq.where(~F.col("class").isin(*concepts.DROPPED)).groupBy("table_id", "col_idx").agg(best["class"].alias("class"))
    return out
