"""The phases between column analysis and export, each over all tables at once: disambiguation of cells, concepts of columns, predicates of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import edit_distance
from ..operators import concepts, disambiguation, linking, relations
from ..sources import triples as T
from ..sources.stage import staged
from ..sources.versions import Versions

#: A label that a value looks up counts for its classes up to this edit distance.
NEAR = 0.2


def disambiguation_phase(cells: DataFrame, columns: DataFrame, triples: DataFrame, label: str, redirect: str, type_: str, person: str) -> DataFrame:
    """Every candidate of every cell of the entity columns with its scores; ``winning`` marks one per cell (see ``disambiguate``).

    cells(cell key, header, value, value_original) hold all columns, as all of them are context; columns(table_id, col_idx) are the entity columns."""
    cells, triples = staged(cells.select(*linking.CELL, "header", "value", "value_original")), staged(triples)
    named = cells.join(columns.select("table_id", "col_idx").distinct(), ["table_id", "col_idx"], "left_semi").where("value <> ''")
    found = staged(disambiguation.found_by_text(named.select("value", "value_original"), triples, label, redirect, type_, person))
    scored = disambiguation.disambiguate(cells, found, triples)
    return scored.join(columns.select("table_id", "col_idx").distinct(), ["table_id", "col_idx"], "left_semi")


def looked_up_classes(cells: DataFrame, triples: DataFrame, label: str, type_: str, ontology: str) -> DataFrame:
    """(table_id, col_idx, class) of labels that begin with a cell's value and are nearly it."""
    values = cells.select(F.col("value").alias("q")).distinct()
    near = T.prefix_lookup(triples, values, label, type_, classes=ontology).where(edit_distance(F.col("q"), F.lower("label")) < NEAR)
    classes = near.select(F.col("q").alias("value"), F.explode("classes").alias("class")).distinct()
    return cells.select("table_id", "col_idx", "value").distinct().join(classes, "value").select("table_id", "col_idx", "class").distinct()


def concept_phase(cells: DataFrame, winners: DataFrame, triples: DataFrame, label: str, type_: str, edges: DataFrame, order: DataFrame, ontology: str = linking.ONTOLOGY) -> DataFrame:
    """(table_id, col_idx, class, path, freq, unsure): the class of each column by the types of its entities.

    cells(cell key, header, value) of the entity columns, winners(cell key, entity, edit), an ontology of edges(parent, child) with order(root, rank).
    Types count per cell; classes that a value looks up and those that the header names count more; those below LEAST of the largest go; the
    rest choose a branch of the ontology. ``unsure`` tells columns whose entities are mostly far from their cells."""
    closure = staged(concepts.ontology_paths(edges, order))
    classes = edges.select(F.col("parent").alias("class")).union(edges.select("child")).union(order.select("root")).distinct()
    kinds = concepts.types_of(triples.where(F.col("o").startswith(ontology)), type_, winners).select("entity", concepts.class_names(F.col("type")).alias("class"))
    typed = winners.join(kinds, "entity").join(classes, "class", "left_semi")
    freq = concepts.concept_frequencies(typed.select("table_id", "col_idx", "entity", "class"))
    rows = cells.groupBy("table_id").agg(F.count_distinct("row_idx").alias("num_rows"))
    header = concepts.header_concepts(cells.select("table_id", "col_idx", "header").distinct(), classes)
    strong = staged(concepts.boosted(freq, rows, looked_up_classes(cells, triples, label, type_, ontology), header))
    chosen = concepts.choose_branch(strong.select("table_id", "col_idx", "class", F.col("entities").alias("freq")), closure, order)
    sure = concepts.no_annotation_share(winners.groupBy("table_id", "col_idx", "entity").agg(F.min("edit").alias("edit")))
    top = strong.select("table_id", "col_idx", F.col("class").alias("annotation"), "freq")
    out = chosen.join(top, ["table_id", "col_idx", "annotation"], "left").join(sure, ["table_id", "col_idx"])
    return out.select("table_id", "col_idx", F.col("annotation").alias("class"), "path", "freq", "unsure")


def predicate_phase(cells: DataFrame, columns: DataFrame, subjects: DataFrame, winners: DataFrame, triples: DataFrame, label: str, ontology: str = linking.ONTOLOGY) -> DataFrame:
    """(table_id, subject_col, col_idx, p, score): the predicate of each column besides the subject's.

    cells(cell key, value), columns(table_id, col_idx, col_class), subjects(table_id, subject_col), winners(cell key, entity). Entity columns are
    compared with the names of the entities that the graph joins with the subjects', literal columns with the subjects' literals."""
    placed = columns.join(subjects, "table_id").where(F.col("col_idx") != F.col("subject_col"))
    known = winners.join(subjects, "table_id")
    own = staged(known.where(F.col("col_idx") == F.col("subject_col")).select("table_id", F.col("entity").alias("s")).distinct())
    objects = known.join(placed.where("col_class = 'NE'").select("table_id", "col_idx"), ["table_id", "col_idx"]).select("table_id", "col_idx", F.col("entity").alias("o"))
    values = relations.entity_values(own, objects, triples, label, ontology).unionByName(relations.literal_values(own, placed.where("col_class = 'LIT'"), triples, ontology))
    scored = relations.typed_similarity(cells.select("table_id", "col_idx", "value"), staged(values))
    return relations.winning_predicate(scored).join(subjects, "table_id").select("table_id", "subject_col", "col_idx", "p", "score")


#: What the memo of linking knows a value by.
VALUE = ["table_id", "col_idx", "value"]


def linking_phase(cells: DataFrame, columns: DataFrame, triples: DataFrame, label: str, redirect: str, type_: str, person: str, memo: Versions | None = None) -> tuple[DataFrame, int]:
    """((cell key, value, entity) of every linked cell, number of values that were looked up).

    cells(cell key, header, value, value_original) hold all columns; columns(table_id, col_idx, type) the entity columns with the address of their class, or
    null. A value of a column is linked once, where it stands first, to the best candidate of the column's class; its other cells follow. A value
    without a candidate is remembered as such. With ``memo``, values that an earlier run has linked (or failed to link) are taken from it, and what is new is
    appended to it as one version."""
    cells = staged(cells.select(*linking.CELL, "header", "value", "value_original"))
    named = cells.join(columns.select("table_id", "col_idx").distinct(), ["table_id", "col_idx"], "left_semi").where("value <> ''")
    first = named.groupBy(*VALUE).agg(F.min("row_idx").alias("row_idx"))
    known = memo.history() if memo is not None else None
    new = staged(first if known is None else first.join(known.select(*VALUE), VALUE, "left_anti"))
    n = new.count()
    if n:
        asked = named.join(new.select(*linking.CELL), linking.CELL, "left_semi")
        found = disambiguation.found_by_text(asked.select("value", "value_original"), triples, label, redirect, type_, person)
        kinds = triples.where(F.col("p") == type_).select(F.col("s").alias("entity"), F.col("o").alias("type")).distinct()
        wanted = asked.select("table_id", "col_idx", "value").distinct().join(columns.select("table_id", "col_idx", "type").distinct(), ["table_id", "col_idx"])
        fit = staged(found.join(wanted, "value").join(kinds, ["entity", "type"], "left_semi").unionByName(found.join(wanted.where("type is null"), "value").select("entity", "type", "value", "alias", "table_id", "col_idx")))
        # context comes from whole rows, so rows of the asked cells are scored, and then only the asked cells stay
        rows = cells.join(asked.select(*linking.ROW).distinct(), linking.ROW, "left_semi")
        scored = disambiguation.disambiguate(rows, fit.select(*VALUE, "entity", "alias").distinct(), triples).join(new.select(*linking.CELL), linking.CELL, "left_semi")
        fresh = new.select(*VALUE).join(_best(scored), VALUE, "left")
        if memo is not None:
            memo.publish(fresh)
            known = memo.history()
        else:
            known = staged(fresh)
    linked = named.join(known.select(*VALUE, "entity"), VALUE) if known is not None else named.withColumn("entity", F.lit(None).cast("string"))
    return linked.where("entity is not null").select(*linking.CELL, "value", "entity"), n


def _best(scored: DataFrame) -> DataFrame:
    """(VALUE, entity): the highest final score, the first by code point among equals."""
    w = Window.partitionBy(*VALUE).orderBy(F.desc(F.round("final", 12)), "entity")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*VALUE, "entity")
