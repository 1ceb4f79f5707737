"""Candidate retrieval over triples: an inverted token index in place of full-text search, then joins on the subject.

Each branch keeps its top candidates before their triples are joined, so the fan-out is bounded per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import long_words
from ..sources.stage import staged
from .prepare import small

#: Candidates kept per query and branch (the feature's own limit), and rows of a person search.
TOP, TOP_PERSONS = 50, 30_000

#: Predicates and objects that carry no meaning for matching, by their prefix.
BLOCKED_P = ("http://www.w3.org/2002/07/owl#", "http://purl.org/", "http://xmlns.com/foaf/0.1/depiction")
BLOCKED_O = ("http://www.wikidata.org/", "http://commons.wikimedia.org/")


def token_index(labels: DataFrame) -> DataFrame:
    """(token, s, label, words) of labels(s, label)."""
    words = F.array_distinct(long_words(F.lower("label")))
    return labels.select("s", "label", words.alias("words")).select("s", "label", "words", F.explode("words").alias("token"))


def text_match(queries: DataFrame, labels: DataFrame, any_word: bool = False) -> DataFrame:
    """(q, s, label) of labels that hold all words of the query, or any of them.

    For all words, a query meets the index in its rarest word only, and the labels met there are tested for the others: a word
    that stands in most labels joins nothing unless it is a query's only one."""
    asked = queries.select("q", F.array_distinct(long_words(F.lower("q"))).alias("asked")).where(F.size("asked") > 0)
    need = small(staged(asked.select("q", "asked", F.explode("asked").alias("token")).distinct()))
    index = token_index(labels).hint("merge")  # its size is known by a guess only
    if any_word:
        # each label once for a query: under the first of the query's words that it holds
        once = token_index(labels.select("s", "label").distinct()).hint("merge").join(need, "token")
        return once.where(F.array_intersect("asked", "words")[0] == F.col("token")).select("q", "s", "label")
    counts = index.join(small(need.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    known = need.join(counts, "token").groupBy("q", "asked").agg(F.min(F.struct("df", "token")).alias("best"), F.count(F.lit(1)).alias("n"))
    rarest = small(staged(known.where(F.col("n") == F.size("asked")).select("q", "asked", F.col("best.token").alias("token"))))
    hits = index.join(rarest, "token").where(F.size(F.array_except("asked", "words")) == 0)
    return hits.select("q", "s", "label").distinct()


def met(few: DataFrame, triples: DataFrame, on: str) -> DataFrame:
    """few(on, ..) joined with the triples: ``few`` is sent to all tasks when a count proves it small, else both are dealt. The triples never
    go through the driver, whatever their size is guessed to be."""
    return triples.hint("merge").join(small(staged(few)), on)


def top_by_length(matches: DataFrame, k: int = TOP, keys: tuple[str, ...] = ("q",)) -> DataFrame:
    """The k subjects with the shortest address per query; among equals by code point."""
    order = Window.partitionBy(*keys).orderBy(F.length("s"), "s")
    return matches.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def candidates(queries: DataFrame, labels: DataFrame, redirects: DataFrame, any_word: bool = False, k: int = TOP) -> DataFrame:
    """(q, s, alias): direct hits (alias ``None``) and hits over redirects(s2, s), each branch with its own top k."""
    found = staged(text_match(queries, labels, any_word))
    direct = top_by_length(found.select("q", "s").distinct()).withColumn("alias", F.lit("None")) if k == TOP else top_by_length(found.select("q", "s").distinct(), k).withColumn("alias", F.lit("None"))
    over = found.withColumnRenamed("s", "s2").join(redirects.hint("merge"), "s2").select("q", "s", F.col("s2").alias("alias")).distinct()
    over = over.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.length("s"), "s", "alias"))).where(F.col("_n") <= k).drop("_n")
    return direct.unionByName(over).distinct()


def allowed(triples: DataFrame, p: str = "p", o: str = "o") -> DataFrame:
    """Triples without blocked predicates and objects."""
    starts = lambda c, xs: F.lit(False) if not xs else F.expr(" or ".join(f"startswith({c}, '{x}')" for x in xs))
    return triples.where(~starts(p, BLOCKED_P) & ~starts(o, BLOCKED_O))


def outgoing(cands: DataFrame, triples: DataFrame) -> DataFrame:
    """(q, s, alias, p, o): triples of each candidate."""
    return met(cands, allowed(triples).select("s", "p", "o"), "s").select("q", "s", "alias", "p", "o").distinct()


def incoming(cands: DataFrame, triples: DataFrame) -> DataFrame:
    """(q, s, alias, p, o): triples that point at each candidate, o being their subject."""
    back = allowed(triples, o="s").select(F.col("o").alias("s"), "p", F.col("s").alias("_o"))
    return met(cands, back, "s").select("q", "s", "alias", "p", F.col("_o").alias("o")).distinct()


def entities(queries: DataFrame, triples: DataFrame, label: str, redirect: str, any_word: bool = False, symmetric: bool = False) -> DataFrame:
    """Candidates by text with their outgoing (or incoming) triples."""
    labels = triples.where(F.col("p") == label).select("s", F.col("o").alias("label"))
    redirects = triples.where(F.col("p") == redirect).select(F.col("s").alias("s2"), F.col("o").alias("s"))
    found = candidates(queries, labels, redirects, any_word)
    return incoming(found, triples) if symmetric else outgoing(found, triples)


def persons(people: DataFrame, triples: DataFrame, label: str, type_: str, person: str, k: int = TOP_PERSONS) -> DataFrame:
    """(q, s, alias) by people(q, prefix, surname): persons whose label holds the surname and starts with the prefix."""
    labels = triples.where(F.col("p") == label).select("s", F.col("o").alias("label"))
    kinds = triples.where((F.col("p") == type_) & (F.col("o") == person)).select("s")
    hits = text_match(people.select(F.col("surname").alias("q")).distinct(), labels).withColumnRenamed("q", "surname").join(people, "surname")
    hits = hits.where(F.startswith(F.lower("label"), F.lower("prefix"))).select("q", "s").distinct().join(kinds.hint("merge"), "s", "left_semi").withColumn("alias", F.lit("None"))
    return top_by_length(hits, k)


def person_entities(people: DataFrame, triples: DataFrame, label: str, type_: str, person: str, symmetric: bool = False, k: int = TOP_PERSONS) -> DataFrame:
    """Persons by people(q, prefix, surname): labels that hold the surname and start with the prefix."""
    found = persons(people, triples, label, type_, person, k)
    return incoming(found, triples) if symmetric else outgoing(found, triples)


def relations(triples: DataFrame, pairs: DataFrame, label: str | None = None) -> DataFrame:
    """(s, o, p[, label]): predicates between the subjects and objects of pairs(s, o); semi-join on both before the match."""
    near = triples.join(pairs.select("s").distinct(), "s", "left_semi").join(pairs.select("o").distinct(), "o", "left_semi")
    got = near.join(pairs.select("s", "o").distinct(), ["s", "o"]).select("s", "o", "p").distinct()
    if label is None:
        return got
    names = triples.where((F.col("p") == label) & (F.coalesce("o_lang", F.lit("en")) == "en")).select(F.col("s").alias("p"), F.col("o").alias("label"))
    return got.join(names, "p", "left")


def literal_relations(triples: DataFrame, subjects: DataFrame, ontology: str, dropped: tuple[str, ...] = ("wikiPageID", "wikiPageRevisionID")) -> DataFrame:
    """(s, p, o): ontology predicates of subjects(s) with addresses or English or unmarked literals."""
    name = F.substring_index("p", "/", -1)
    good = F.col("p").startswith(ontology) | F.col("p").contains("georss")
    rows = triples.where(good & ~name.isin(*dropped) & ((F.col("o_kind") == "uri") | (F.coalesce("o_lang", F.lit("en")) == "en")))
    return rows.join(subjects.select("s").distinct(), "s", "left_semi").select("s", "p", "o").distinct()


def subgraph(cands: DataFrame, triples: DataFrame) -> DataFrame:
    """Triples around candidates in both directions, each once."""
    cands = staged(cands)
    out = met(cands, triples.select("s", "p", "o"), "s").select("q", "s", "p", "o")
    back = met(cands.select("q", F.col("s").alias("o")), triples.select("s", "p", "o"), "o").select("q", "s", "p", "o")
    return allowed(out.unionByName(back)).distinct()


#: What a raw subgraph leaves out: subjects, predicates and objects by their beginning (fixed values).
RAW_SUBJECTS = ("http://dbpedia.org/resource/Category:", "http://dbpedia.org/property/", "http://dbpedia.org/ontology/")
RAW_PREDICATES = (
    "http://dbpedia.org/ontology/wikiPageID", "http://dbpedia.org/ontology/wikiPageRevisionID", "http://www.w3.org/2002/07/owl#sameAs",
    "http://dbpedia.org/ontology/wikiPageRedirects", "http://www.w3.org/ns/prov#wasDerivedFrom", "http://xmlns.com/foaf/0.1/isPrimaryTopicOf",
    "http://www.w3.org/2000/01/rdf-schema#comment", "http://dbpedia.org/ontology/abstract",
)
RAW_OBJECTS = ("http://dbpedia.org/class/yago/",)


def _without(rows: DataFrame) -> DataFrame:
    for c, starts in (("s", RAW_SUBJECTS), ("p", RAW_PREDICATES), ("o", RAW_OBJECTS)):
        for x in starts:
            rows = rows.where(~F.col(c).startswith(x))
    return rows


def raw_subgraph(queries: DataFrame, triples: DataFrame, names: tuple[str, ...], any_word: bool = False) -> DataFrame:
    """(q, s, p, o): the triples of all subjects that the text finds under any of the predicates ``names`` (label, name), each once."""
    labels = triples.where(F.col("p").isin(*names)).select("s", F.col("o").alias("label"))
    found = text_match(queries, labels, any_word).select("q", "s").distinct()
    return _without(met(found, triples.select("s", "p", "o"), "s").select("q", "s", "p", "o")).distinct()


def person_subgraph(people: DataFrame, triples: DataFrame, label: str, redirect: str) -> DataFrame:
    """(q, s, p, o) by people(q, prefix, surname): triples of subjects whose label holds the surname and starts with the prefix, of
    what such labels redirect to, and triples that point at such subjects."""
    labels = triples.where(F.col("p") == label).select("s", F.col("o").alias("label"))
    hits = text_match(people.select(F.col("surname").alias("q")).distinct(), labels).withColumnRenamed("q", "surname").join(people, "surname")
    hits = staged(hits.where(F.startswith(F.lower("label"), F.lower("prefix"))).select("q", "s").distinct())
    graph = triples.select("s", "p", "o")
    target = triples.where(F.col("p") == redirect).select("s", F.col("o").alias("to"))
    subjects = hits.unionByName(met(hits, target, "s").select("q", F.col("to").alias("s"))).distinct()
    out = met(subjects, graph, "s").select("q", "s", "p", "o")
    back = met(hits.select("q", F.col("s").alias("o")), graph, "o").select("q", "s", "p", "o")
    return _without(out.unionByName(back)).distinct()


def describe(triples: DataFrame, uri: str, without: tuple[str, ...] = ()) -> DataFrame:
    """The triples of one resource, without some predicates."""
    return triples.where((F.col("s") == uri) & ~F.col("p").isin(*without)) if without else triples.where(F.col("s") == uri)


def abstracts(cands: DataFrame, triples: DataFrame, abstract: str) -> DataFrame:
    """(q, s, alias, abstract) of candidates; null where there is none."""
    text = triples.where((F.col("p") == abstract) & (F.coalesce("o_lang", F.lit("en")) == "en")).select("s", F.col("o").alias("abstract"))
    return cands.join(text, "s", "left").select("q", "s", "alias", "abstract")


def healthy(triples: DataFrame) -> bool:
    """Whether the graph answers with anything."""
    return not triples.isEmpty()


def bind(spark, sql: str, args: dict, **frames: DataFrame) -> DataFrame:
    """A query text with named parameters, bound as values (never by pasting) and run over the frames."""
    return spark.sql(sql, args=args, **frames)


def suggestions(labels: DataFrame, prefix: str, k: int = 7) -> DataFrame:
    """The k shortest labels that start with a prefix."""
    return labels.where(F.startswith(F.lower("label"), F.lower(F.lit(prefix)))).orderBy(F.length("label"), "label").limit(k)


def sources_in(triples: DataFrame) -> DataFrame:
    """Subjects that have outgoing triples; nodes without are no subjects of a match."""
    return triples.select("s").distinct()
