"""Predicates of columns by similarity between cells and candidate values.

A predicate's value is as like a column as the mean of its likenesses to the column's cells of its own kind: numbers meet numbers, dates dates, other
texts texts. Numbers and dates are never paired: with c of the larger size |c|, the likeness 1 - |c - v| / max(|c|, |v|, 1) is v / c, else c / v, so a
value needs only the sum of 1 / c over the cells beyond it and the sum of c over those before it, which running sums over bands give.

Texts are paired only where that can change a result. Of a predicate's values only the likest counts, and no likeness of two texts passes the number of
characters that they share over the longer length. The mean of that bound over a column's cells comes from counts of the column's characters, so a value
needs no cell for it. Values are compared with the cells in the order of their bounds, until none that is left can pass the predicate's best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.celltypes import is_description, is_float
from ..functions.text import initial_name
from ..sources.stage import dealt, staged
from .prepare import BROADCAST_ROWS, small

LEAST = 0.25
#: Bands of a doubling of size, and of one below 1, in which numbers are summed.
BANDS = 64
#: Values of a column's predicate that are compared with its texts first, how many times more in each later round, texts of a task.
FIRST, MORE, TEXTS = 16, 16, 20_000
#: A bound this much below the best may still be equal to it: both are sums of floats.
ALIKE = 1e-9
COLUMN = ["table_id", "col_idx"]


def cell_similarity(kind, cell, value):
    """Likeness of a cell and a value by the column's type: numbers, dates, descriptions, persons, else edit distance."""
    number = S.numeric(cell.try_cast("double"), value.try_cast("double"))
    day = S.date(F.try_to_date(cell, "yyyy-MM-dd"), F.try_to_date(value, "yyyy-MM-dd"))
    text = F.when(S.is_person(cell), 1 - S.person(F.lower(cell), F.lower(value))).otherwise(1 - S.edit_distance(cell, value))
    return F.coalesce(F.when(kind == "numeric", number).when(kind == "date", day).when(kind == "description", S.containment(cell, value)).otherwise(text), F.lit(0.0))


def predicate_similarity(cells: DataFrame, values: DataFrame) -> DataFrame:
    """(table_id, col_idx, p, score) of candidate predicates, kept where score / freq > LEAST.

    cells(table_id, col_idx, kind, value) are first counted per distinct value; values(table_id, col_idx, p, value, freq)
    are few per column. Mean likeness per (p, value) times the predicate's frequency; the best value counts."""
    own = cells.groupBy(*COLUMN, "kind", F.col("value").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    both = own.join(values, COLUMN).withColumn("sim", cell_similarity(F.col("kind"), F.col("cell"), F.col("value")) * F.col("n"))
    mean = both.groupBy(*COLUMN, "p", "value", "freq").agg((F.sum("sim") / F.sum("n")).alias("mean"))
    return mean.groupBy(*COLUMN, "p", "freq").agg((F.max("mean") * F.col("freq")).alias("score")).where(F.col("score") / F.col("freq") > LEAST)


def winning_predicate(scored: DataFrame) -> DataFrame:
    """(table_id, col_idx, p, score): the best, the first by code point among equals."""
    w = Window.partitionBy(*COLUMN).orderBy(F.desc(F.round("score", 12)), "p")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*COLUMN, "p", "score")


def predicate_counts(pairs: DataFrame) -> DataFrame:
    """(table_id, col_idx, p, freq, values) of pairs(table_id, col_idx, p, value), each pair once."""
    return pairs.select(*COLUMN, "p", "value").distinct().groupBy(*COLUMN, "p").agg(F.count(F.lit(1)).alias("freq"), F.array_sort(F.collect_list("value")).alias("values"))


def winning_by_sum(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """(table_id, col_idx, p, score): the predicate whose distinct values have the largest sum of scores(value, score)."""
    once = pairs.select(*COLUMN, "p", "value").distinct().join(scores, "value")
    return winning_predicate(once.groupBy(*COLUMN, "p").agg(F.sum("score").alias("score")))


def _kinds(df: DataFrame, value: str) -> DataFrame:
    """df with ``kind`` (number, date or text) and ``x``, the number or the date's day."""
    number = F.when(is_float(F.col(value)), F.replace(F.col(value), F.lit(","), F.lit("")).try_cast("double"))
    day = F.when(F.col(value).rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), S.day_number(F.try_to_date(F.col(value), "yyyy-MM-dd"))).cast("double")
    kind = F.when(number.isNotNull(), "number").when(day.isNotNull(), "date").otherwise("text")
    return df.withColumn("kind", kind).withColumn("x", F.coalesce(number, day))


def _number_means(cells: DataFrame, values: DataFrame) -> DataFrame:
    """(table, column, kind, x, mean) of the distinct values(table, column, kind, x) to cells(table, column, kind, x, n).

    Both are sorted by size in one frame and dealt into bands; a row's sums are those of the bands before its own and of the rows before it in its band."""
    keys = [*COLUMN, "kind"]
    cell = cells.select(*keys, "x", F.col("n").cast("double").alias("n"), F.lit(0).alias("ask"))
    value = values.select(*keys, "x").distinct().select(*keys, "x", F.lit(0.0).alias("n"), F.lit(1).alias("ask"))
    size = F.abs("x")
    rows = cell.unionByName(value)
    small = size < 1
    # numbers below 1 in size are ordered by value, in a part of their own
    rows = rows.withColumn("part", F.when(small, 0).otherwise(1)).withColumn("at", F.when(small, F.col("x")).otherwise(size))
    rows = rows.withColumn("band", F.floor(F.when(small, F.col("x") * BANDS).otherwise(F.log2(size) * BANDS)))
    sums = [F.sum("n").alias("k"), F.sum(F.col("n") * F.col("x")).alias("t"), F.sum(F.when(size >= 1, F.col("n") / F.col("x")).otherwise(0.0)).alias("i")]
    bands = rows.groupBy(*keys, "part", "band").agg(*sums)
    before = Window.partitionBy(*keys, "part").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = bands.select(*keys, "part", "band", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}0") for c in "kti"], *[F.sum(F.when(F.col("part") == p, F.col(c)).otherwise(0.0)).over(whole).alias(f"{c}{name}") for p, name in ((0, "s"), (1, "l")) for c in "kti"])
    inside = Window.partitionBy(*keys, "part", "band").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mine = rows.select(*keys, "part", "band", "x", "ask", F.sum("n").over(inside).alias("k"), F.sum(F.col("n") * F.col("x")).over(inside).alias("t"), F.sum(F.when(size >= 1, F.col("n") / F.col("x")).otherwise(0.0)).over(inside).alias("i"))
    got = mine.where("ask = 1").join(starts, [*keys, "part", "band"])
    k, t, i = (F.col(c) + F.col(f"{c}0") for c in "kti")  # of the cells up to the value, in its part
    # below 1: small cells by distance, large ones by v / c; else: all smaller cells by c / v, those of the same size and beyond by v / c.
    # Cells of the same size count once, by c / v, which is the same
    low = F.col("ks") - (F.col("x") * k - t) - ((F.col("ts") - t) - F.col("x") * (F.col("ks") - k)) + F.col("x") * F.col("il")
    high = (F.col("ts") + t) / F.col("x") + F.col("x") * (F.col("il") - i)
    total = F.col("ks") + F.col("kl")
    mean = F.when(F.col("part") == 0, low).otherwise(high) / total
    return got.where(total > 0).select(*keys, "x", mean.alias("mean")).distinct()


def text_similarity(cell, value):
    """Likeness of two texts: persons by the initial, descriptions by what one holds of the other, others by edit distance."""
    other = F.when(S.is_person(cell), 1 - S.person(F.lower(cell), F.lower(value))).otherwise(1 - S.edit_distance(F.lower(cell), F.lower(value)))
    return F.when(is_description(cell), S.containment(F.lower(cell), F.lower(value))).otherwise(other)


def _characters(texts: DataFrame, text: str) -> DataFrame:
    """texts with a row per distinct character of ``text``: the character, the times it stands there (``k``), the text's length (``l``)."""
    each = texts.withColumn("l", F.length(text)).withColumn("ch", F.explode(F.array_distinct(F.filter(F.split(text, ""), lambda x: x != ""))))
    return each.withColumn("k", F.col("l") - F.length(F.replace(F.col(text), F.col("ch"), F.lit(""))))


def text_bounds(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(table, column, value, bound) of the distinct values(table, column, value): no value's mean likeness to texts(table, column, cell, n) is higher.

    Two texts of which one is made from the other, or holds it, share all characters but those that are put in or changed; so their likeness is at most
    what they share of each character, summed, over the longer length. A column's cells are counted by character, its times and the length; persons
    apart, as they are compared with the value's first name cut to its initial."""
    person = F.coalesce(~is_description(F.col("cell")) & S.is_person(F.col("cell")), F.lit(False))
    cells = _characters(texts.withColumn("person", person).withColumn("cell", F.lower("cell")), "cell")
    seen = cells.groupBy(*COLUMN, "person", "ch", "k", "l").agg(F.sum("n").alias("n")).select(*COLUMN, "person", "ch", F.col("k").alias("k2"), F.col("l").alias("l2"), "n")
    low = F.lower("value")
    sides = F.array(F.struct(F.lit(False).alias("person"), low.alias("x")), F.struct(F.lit(True).alias("person"), initial_name(low).alias("x")))
    held = _characters(asked.select(*COLUMN, "value", F.inline(sides)), "x").select(*COLUMN, "value", "person", "ch", "k", "l")
    shared = F.least("k", "k2") / F.greatest("l", "l2")
    # what a character adds depends on its times and the length only
    part = held.select(*COLUMN, "person", "ch", "k", "l").distinct().join(seen, [*COLUMN, "person", "ch"]).groupBy(*COLUMN, "person", "ch", "k", "l").agg(F.sum(shared * F.col("n")).alias("part"))
    total = texts.groupBy(*COLUMN).agg(F.sum("n").alias("total"))
    sums = held.join(part, [*COLUMN, "person", "ch", "k", "l"]).groupBy(*COLUMN, "value").agg(F.sum("part").alias("part"))
    return asked.join(small(total), COLUMN).join(sums, [*COLUMN, "value"], "left").select(*COLUMN, "value", (F.coalesce("part", F.lit(0.0)) / F.col("total")).alias("bound"))


def _text_means(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(table, column, value, mean) of the distinct values(table, column, value) to texts(table, column, cell, n), pair by pair."""
    like = dealt(texts, *COLUMN, "cell", rows=TEXTS).join(small(asked), COLUMN).select(*COLUMN, "value", "n", (text_similarity(F.col("cell"), F.col("value")) * F.col("n")).alias("sim"))
    return like.groupBy(*COLUMN, "value").agg((F.sum("sim") / F.sum("n")).alias("mean"))


def _best_texts(texts: DataFrame, asked: DataFrame, best: DataFrame, least: float) -> DataFrame:
    """best(table, column, p, freq, mean) with the predicates' texts asked(table, column, p, freq, value) compared too.

    Each round takes the open values with the highest bounds of every predicate; those whose bound doesn't pass ``least`` or the best so far are done with, as
    they can't change it. So the result is that of all pairs; where bounds tell nothing, all pairs are compared."""
    keys = [*COLUMN, "p", "freq"]
    open_ = staged(asked.join(text_bounds(texts, asked.select(*COLUMN, "value").distinct()), [*COLUMN, "value"]))
    # the values of a round are few enough to be sent to the texts
    size, most = FIRST, max(FIRST, BROADCAST_ROWS // max(1, open_.select(*keys).distinct().count()))
    while True:
        floor = F.greatest(F.coalesce("mean", F.lit(least)), F.lit(least))
        open_ = staged(open_.join(small(best), keys, "left").where(F.col("bound") > floor - ALIKE).select(*keys, "value", "bound"))
        if open_.isEmpty():
            return best
        now = staged(open_.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("bound"), "value"))).where(F.col("_n") <= size).drop("_n"))
        means = now.join(_text_means(texts, staged(now.select(*COLUMN, "value").distinct())), [*COLUMN, "value"]).select(*keys, "mean")
        best = staged(best.unionByName(means).groupBy(*keys).agg(F.max("mean").alias("mean")))
        open_ = open_.join(now, [open_[k].eqNullSafe(now[k]) for k in (*keys, "value")], "left_anti")
        size = min(size * MORE, most)


def typed_similarity(cells: DataFrame, values: DataFrame, least: float = LEAST) -> DataFrame:
    """(table_id, col_idx, p, score) of the predicates whose best value has a mean likeness above ``least``; score is that mean times ``freq``.

    cells(table_id, col_idx, value), empty ones left out, count as often as they stand in the column; values(table_id, col_idx, p, value, freq)
    hold each value of a predicate. A value meets the cells of its own kind only; without such cells it counts for nothing. Texts are paired
    per distinct text, and only with values that can be a predicate's best."""
    own = _kinds(cells.where("value <> ''").groupBy(*COLUMN, "value").agg(F.count(F.lit(1)).alias("n")), "value")
    asked = _kinds(values.where("value <> ''"), "value")
    told = own.where("kind <> 'text'").groupBy(*COLUMN, "kind", "x").agg(F.sum("n").alias("n"))
    number = asked.where("kind <> 'text'")
    counted = number.join(_number_means(told, number), [*COLUMN, "kind", "x"]).groupBy(*COLUMN, "p", "freq").agg(F.max("mean").alias("mean"))
    texts = staged(own.where("kind = 'text'").select(*COLUMN, F.col("value").alias("cell"), "n"))
    spelt = asked.where("kind = 'text'").select(*COLUMN, "p", "freq", "value").distinct()
    best = _best_texts(texts, spelt, staged(counted), least)
    return best.where(F.col("mean") > least).select(*COLUMN, "p", (F.col("mean") * F.col("freq")).alias("score"))


def entity_values(subjects: DataFrame, objects: DataFrame, triples: DataFrame, label: str, ontology: str) -> DataFrame:
    """(table_id, col_idx, p, value, freq): names of what the graph has between a table's subject entities and a column's entities.

    subjects(table_id, s), objects(table_id, col_idx, o); freq counts the predicate's triples, each value stands once."""
    graph = triples.where(F.col("p").startswith(ontology) & (F.col("o_kind") == "uri")).select("s", "p", "o").distinct()
    met = graph.join(subjects.distinct(), "s").join(objects.distinct(), ["table_id", "o"])
    names = triples.where((F.col("p") == label) & (F.coalesce("o_lang", F.lit("en")) == "en")).groupBy(F.col("s").alias("o")).agg(F.min("o").alias("value"))
    return _with_frequency(met.join(names, "o"))


def literal_values(subjects: DataFrame, columns: DataFrame, triples: DataFrame, ontology: str) -> DataFrame:
    """(table_id, col_idx, p, value, freq): what the graph says in literals on a table's subject entities, for each of columns(table_id, col_idx)."""
    graph = triples.where(F.col("p").startswith(ontology) & (F.col("o_kind") == "literal") & (F.coalesce("o_lang", F.lit("en")) == "en")).select("s", "p", F.col("o").alias("value"), F.col("o").alias("o")).distinct()
    met = graph.join(subjects.distinct(), "s").join(columns.select(*COLUMN).distinct(), "table_id")
    return _with_frequency(met)


def _with_frequency(met: DataFrame) -> DataFrame:
    each = met.groupBy(*COLUMN, "p", "value").agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("freq", F.sum("n").over(Window.partitionBy(*COLUMN, "p"))).drop("n")
