"""Disambiguation of cells: candidates found by text are scored by the words around the cell and those the graph has on the candidate.

The words of the tables (values and headers) make one dictionary. Everything that is compared is an array of its numbers: a cell's words, the
row's other words, the header's words, and of an entity only those words of its objects and neighbours that the dictionary knows in
some form. So an entity's bag is at most as large as the tables' vocabulary, is worked out once however many cells it stands for, and no
text is compared twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.celltypes import is_person
from ..functions.lexicon import STOPWORDS
from ..sources.stage import staged
from . import candidates as Q
from . import linking

#: Words that read as numbers though they are letters.
NO_WORDS = ("nan", "inf", "infinity")


def found_by_text(values: DataFrame, triples: DataFrame, label: str, redirect: str, type_: str, person: str) -> DataFrame:
    """(value, entity, alias) of values(value, value_original): persons by initial and surname; others by all words of the text, and
    where that finds nothing and there are several words, by any of them. ``alias`` is the address that redirects to the entity."""
    values = values.select("value", is_person(F.col("value_original")).alias("person")).groupBy("value").agg(F.max("person").alias("person"))
    tokens = F.split("value", r"\s+")
    people = values.where(F.col("person") & (F.size(tokens) > 1)).select(F.col("value").alias("q"), tokens[0].alias("prefix"), F.element_at(tokens, -1).alias("surname"))
    others = values.where(~F.col("person")).select(F.col("value").alias("q"))
    labels = triples.where(F.col("p") == label).select("s", F.col("o").alias("label"))
    redirects = triples.where(F.col("p") == redirect).select(F.col("s").alias("s2"), F.col("o").alias("s"))
    exact = staged(Q.candidates(others, labels, redirects))
    missed = staged(others.where(F.size(F.split("q", r"\s+")) > 1).join(exact.select("q").distinct(), "q", "left_anti"))
    every = exact
    # the labels' words are dealt out only for texts that ask for them
    if not missed.isEmpty():
        every = every.unionByName(Q.candidates(missed, labels, redirects, any_word=True))
    if not people.isEmpty():
        every = every.unionByName(Q.persons(people, triples, label, type_, person))
    return every.select(F.col("q").alias("value"), F.col("s").alias("entity"), F.when(F.col("alias") != "None", F.col("alias")).alias("alias")).distinct()


def dictionary(texts: DataFrame) -> DataFrame:
    """(word, id) of texts(text): numbers are places in a written table."""
    words = texts.select(F.explode(X.long_words(F.lower("text"))).alias("word")).distinct()
    return staged(staged(words).withColumn("id", F.monotonically_increasing_id()))


def numbered(texts: DataFrame, words: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, ids, told): the numbers of each distinct key's words in order, and those of its words that aren't stopwords."""
    each = texts.select(F.col(key), F.explode(F.array_distinct(X.long_words(F.lower(text)))).alias("word")).distinct()
    told = F.when(~F.col("word").isin(*STOPWORDS), F.col("id"))
    return each.join(words, "word").groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("ids"), F.array_sort(F.collect_list(told)).alias("told"))


def entity_words(entities: DataFrame, triples: DataFrame, words: DataFrame) -> DataFrame:
    """(entity, name, same, near): the numbers of the words in the entity's name; of the words of its objects and of what points at it (letters only); and
    for each of these words the numbers of its forms (singular, plural)."""
    text = F.when(F.col("o_kind") == "uri", X.entity_name(F.col("o"))).when(F.coalesce("o_lang", F.lit("en")) == "en", F.lower("o"))
    out = Q.allowed(triples.where("o_kind <> 'blank'")).select(F.col("s").alias("entity"), text.alias("text"))
    back = Q.allowed(triples.where("o_kind = 'uri'"), o="s").select(F.col("o").alias("entity"), X.entity_name(F.col("s")).alias("text"))
    own = entities.select("entity").distinct()
    letters = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*NO_WORDS))
    said = out.unionByName(back).join(own, "entity", "left_semi").select("entity", F.explode(F.array_distinct(letters)).alias("w")).distinct()
    one = X.singular(F.col("w"))
    forms = said.select("entity", "w", one.alias("one")).select("entity", "w", "one", X.plural(F.col("one")).alias("many"))
    forms = forms.select("entity", "w", "one", "many", F.explode(F.array_distinct(F.array("w", "one", "many"))).alias("word")).join(words, "word")
    is_form = (F.col("word") == F.col("one")) | (F.col("word") == F.col("many"))
    by_word = forms.groupBy("entity", "w").agg(F.collect_list(F.when(is_form, F.col("id"))).alias("near"), F.max(F.when(F.col("word") == F.col("w"), F.col("id"))).alias("same"))
    bags = by_word.groupBy("entity").agg(F.array_sort(F.collect_list("same")).alias("same"), F.filter(F.collect_list("near"), lambda f: F.size(f) > 0).alias("near"))
    name = numbered(own, words, "entity", X.entity_name(F.col("entity"))).select("entity", F.col("ids").alias("name"))
    none = F.array().cast("array<bigint>")
    return own.join(bags, "entity", "left").join(name, "entity", "left").select("entity", F.coalesce("name", none).alias("name"), F.coalesce("same", none).alias("same"), F.coalesce("near", F.array().cast("array<array<bigint>>")).alias("near"))


def disambiguate(cells: DataFrame, found: DataFrame, triples: DataFrame) -> DataFrame:
    """(cell key, value, entity, alias, edit, row_score, cell_score, final, winning): every candidate of every cell with its scores.

    cells(cell key, header, value, value_original) hold all columns of the tables; found(value, entity, alias), where they
    hold for some columns only with table_id and col_idx. The row's score counts the entity's words of
    which a form stands in the headers, and those of which one stands in the row's other cells; the cell's score counts the words that the
    cell shares with the entity's name and with its words. Both are over the largest among the cell's candidates (at least 1); ``final`` is their sum
    less twice the edit distance to the name or alias, whichever is nearer. The highest wins, the first by code point among equals."""
    texts = cells.select(F.col("value").alias("text")).union(cells.select(F.col("header").alias("text"))).distinct()
    words = dictionary(texts)
    of_value = staged(numbered(cells.select("value").distinct(), words, "value", F.col("value")))
    heads = cells.select("table_id", "header").distinct()
    of_table = numbered(heads.groupBy("table_id").agg(F.array_join(F.collect_list("header"), " ").alias("text")), words, "table_id", F.col("text")).select("table_id", F.col("told").alias("head"))
    none = F.array().cast("array<bigint>")
    placed = cells.select(*linking.CELL, "value", "value_original").join(of_value, "value", "left")
    row = F.collect_list(F.struct("col_idx", F.coalesce("told", none).alias("told"))).over(Window.partitionBy(*linking.ROW))
    other = F.array_distinct(F.flatten(F.transform(F.filter("_row", lambda x: x.col_idx != F.col("col_idx")), lambda x: x.told)))
    placed = placed.withColumn("_row", row).withColumn("row", other).drop("_row", "told").join(of_table, "table_id", "left")
    bags = staged(entity_words(found, triples, words))
    both = placed.join(found, [c for c in ("table_id", "col_idx", "value") if c in found.columns]).join(bags, "entity")
    hits = lambda told: F.size(F.filter("near", lambda f: F.arrays_overlap(f, F.coalesce(F.col(told), none))))
    own = F.coalesce("ids", none)
    name = F.trim(F.when(is_person(F.col("value_original")), X.initial_name(X.entity_name(F.col("entity")))).otherwise(X.entity_name(F.col("entity"))))
    scored = both.select(
        *linking.CELL, "value", "entity", "alias", (hits("head") + hits("row")).alias("row_score"),
        (F.size(F.array_intersect(own, "name")) + F.size(F.array_intersect(own, "same"))).alias("cell_score"), name.alias("name"), F.trim(X.entity_name(F.col("alias"))).alias("alias_name"),
    )
    # an entity found directly and over aliases has one row each: the nearer counts
    ready = scored.select(*linking.CELL, "value", F.col("value").alias("cell"), "entity", F.col("alias").alias("_alias"), "name", F.col("alias_name").alias("alias"), "row_score", "cell_score")
    out = linking.score_candidates(ready).drop("cell", "name", "alias").withColumnRenamed("_alias", "alias")
    best = Window.partitionBy(*linking.CELL).orderBy(F.desc(F.round("final", 12)), "entity", F.col("alias").asc_nulls_first())
    return out.withColumn("winning", F.row_number().over(best) == 1).select(*linking.CELL, "value", "entity", "alias", "edit", "row_score", "cell_score", "final", "winning")
