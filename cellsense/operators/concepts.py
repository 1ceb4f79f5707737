"""Class annotation of columns: sampled rows, concept frequencies, boosts, and the branch of the ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged

#: Share of the weight that a class found by lookup adds; least share of the most frequent class.
BOOST, LEAST, SAMPLE = 0.30, 0.30, 30
DROPPED = ("Agent", "Thing")


def sample_rows(rows: DataFrame, keys: list[str], index: str = "row_idx", size: int = SAMPLE) -> DataFrame:
    """The first third, a middle third and the last third of a sample; all rows of shorter tables."""
    part = size // 3
    n = rows.groupBy(*keys).agg(F.count_distinct(index).alias("_n"))
    at = F.col(index)
    middle = F.floor(F.col("_n") / 3) + 1
    return rows.join(n, keys).where((F.col("_n") <= size) | (at < part) | at.between(middle, middle + part - 1) | (at >= F.col("_n") - part)).drop("_n")


def header_concepts(headers: DataFrame, classes: DataFrame) -> DataFrame:
    """(table_id, col_idx, class): words of a header that name a class."""
    tokens = headers.select("table_id", "col_idx", F.explode(F.split(F.lower("header"), r"\W+")).alias("token")).distinct()
    return tokens.join(classes.select("class", F.lower("class").alias("token")), "token").select("table_id", "col_idx", "class").distinct()


def concept_frequencies(typed: DataFrame) -> DataFrame:
    """(table_id, col_idx, class, freq, entities) of typed(table_id, col_idx, entity, class): each entity counts once in ``entities``."""
    return typed.groupBy("table_id", "col_idx", "class", "entity").agg(F.count(F.lit(1)).alias("n")).groupBy("table_id", "col_idx", "class").agg(F.sum("n").alias("freq"), F.count(F.lit(1)).alias("entities"))


def boosted(freq: DataFrame, rows: DataFrame, lookup: DataFrame, header: DataFrame) -> DataFrame:
    """Frequencies raised by classes found by lookup and in the header, cut at LEAST of the column's top.

    rows(table_id, num_rows); lookup and header(table_id, col_idx, class)."""
    mark = lambda df, name: df.select("table_id", "col_idx", "class").distinct().withColumn(name, F.lit(1))
    on = ["table_id", "col_idx", "class"]
    w = F.least("num_rows", F.lit(SAMPLE))
    both = freq.join(rows, "table_id").join(mark(lookup, "l"), on, "left").join(mark(header, "h"), on, "left")
    both = both.withColumn("freq", F.col("freq") + F.when(F.col("l").isNotNull(), F.floor(w * BOOST)).otherwise(0) + F.when(F.col("h").isNotNull(), w).otherwise(0))
    both = both.withColumn("entities", F.when(F.col("h").isNotNull(), w).otherwise(F.col("entities")))
    top = F.max("freq").over(Window.partitionBy("table_id", "col_idx"))
    return both.withColumn("_top", top).where(F.col("freq") / F.col("_top") > LEAST).drop("_top", "l", "h", "num_rows")


def ontology_closure(edges: DataFrame) -> DataFrame:
    """(above, class, path): the shortest way from every class to each class below it over edges(parent, child), itself included; the first by code
    point among equally short ones. Cycles do no harm.

    By doubling: a way of more than 2 ** k steps and up to 2 ** (k + 1) is one of exactly 2 ** k steps and one of up to 2 ** k after it, so each is met
    at one place only, and the rounds are the logarithm of the depth, whatever that is. Each round is a table; the last one has no way of exactly 2 ** k
    steps. A part of a shortest, first way is one itself, so nothing is lost by keeping one way for each pair."""
    links = edges.select("parent", "child").where("parent is not null and child is not null and parent <> child").distinct()
    names = links.select(F.col("parent").alias("class")).union(links.select("child")).distinct()
    own = names.select(F.col("class").alias("above"), "class", F.array("class").alias("path"))
    first = F.min(F.struct(F.size("path").alias("n"), F.col("path")))
    ways = staged(own.unionByName(links.select(F.col("parent").alias("above"), F.col("child").alias("class"), F.array("parent", "child").alias("path"))))
    steps = 1
    while not (whole := ways.where(F.size("path") == steps + 1)).isEmpty():
        on = ways.where(F.size("path") > 1).select(F.col("above").alias("class"), F.col("class").alias("below"), F.slice("path", F.lit(2), F.size("path")).alias("rest"))
        longer = whole.join(on, "class").select("above", F.col("below").alias("class"), F.concat("path", "rest").alias("path"))
        ways = staged(ways.unionByName(longer).groupBy("above", "class").agg(first.alias("x")).select("above", "class", "x.path"))
        steps *= 2
    return ways


def ontology_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, class, path): the shortest way from each of roots(root) down to the classes below it, itself included."""
    below = ontology_closure(edges).withColumnRenamed("above", "root").join(roots.select("root").distinct(), "root", "left_semi")
    alone = roots.select("root", F.col("root").alias("class"), F.array("root").alias("path")).distinct()
    return below.unionByName(alone.join(below.select("root").distinct(), "root", "left_anti"))


def choose_branch(freq: DataFrame, paths: DataFrame, order: DataFrame) -> DataFrame:
    """(table_id, col_idx, root, path, annotation) of each column.

    freq(table_id, col_idx, class, freq); paths(root, class, path); order(root, rank): a class below two roots belongs to the
    one of lower rank. The root with the largest sum of frequencies wins, then the path with the largest sum, a class
    without frequency counting 1; Agent and Thing are left out; the path's end is the annotation."""
    ranked = paths.join(F.broadcast(order), "root")  # the roots of the ontology: a fixed two dozen rows
    first = ranked.groupBy("class").agg(F.min(F.struct("rank", "root", "path")).alias("x")).select("class", "x.root", "x.path", "x.rank")
    known = freq.join(first, "class")
    key = ["table_id", "col_idx"]
    by_root = known.groupBy(*key, "root", "rank").agg(F.sum("freq").alias("sum"))
    root = by_root.groupBy(*key).agg(F.max_by("root", F.struct("sum", (-F.col("rank")).alias("r"))).alias("root"))
    inside = known.join(root, [*key, "root"])
    steps = inside.select(*key, "root", "path", F.explode("path").alias("step"))
    scored = steps.join(freq.select(*key, F.col("class").alias("step"), "freq"), [*key, "step"], "left").groupBy(*key, "root", "path").agg(F.sum(F.coalesce("freq", F.lit(1))).alias("sum"))
    path = scored.groupBy(*key, "root").agg(F.max_by("path", F.struct("sum", F.size("path").alias("n"), F.array_join("path", "/").alias("t"))).alias("path"))
    kept = F.filter("path", lambda c: ~c.isin(*DROPPED))
    return path.withColumn("path", kept).withColumn("annotation", F.element_at(kept, -1))


def no_annotation_share(distances: DataFrame, limit: float = 0.4, share: float = 0.5) -> DataFrame:
    """(table_id, col_idx, unsure): fewer than ``share`` of the column's distinct entities are within ``limit`` of their cell."""
    near = F.count_if(F.col("edit") < limit) / F.count(F.lit(1))
    return distances.groupBy("table_id", "col_idx").agg((near < share).alias("unsure"))


def winning_concepts(freq: DataFrame) -> DataFrame:
    """(table_id, col_idx, winning_concepts): map from class to frequency, the most frequent first."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col("freq"), F.col("class"))), asc=False)
    return freq.groupBy("table_id", "col_idx").agg(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["class"], x.freq))).alias("winning_concepts"))


def types_of(triples: DataFrame, type_: str, entities: DataFrame, dropped: str = "yago/Wikicat") -> DataFrame:
    """(entity, type): types of entities(entity), without generated categories."""
    rows = triples.where((F.col("p") == type_) & ~F.col("o").contains(dropped)).select(F.col("s").alias("entity"), F.col("o").alias("type"))
    return rows.join(entities.select("entity").distinct(), "entity", "left_semi").distinct()


def class_names(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)
