"""Column analysis of all tables at once: type frequencies, metrics, classes, subject columns.

Cells are first counted per (table, column, value), which combines before the shuffle; types, word counts and distinct
counts are then worked out once per distinct value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.celltypes import with_type
from ..functions.text import collapse_spaces, remove_stopwords, strip_punctuation

#: Thresholds: share of typed cells (more than), share of empty cells, words per cell of a description (more than).
TYPED, EMPTY, WORDY = 0.60, 0.70, 6

COLUMN = ["table_id", "col_idx", "header"]


def values(cells: DataFrame, value: str = "value", type_col: str | None = None) -> DataFrame:
    """(table, column, value, n, first, cell_type): distinct values with their count and first row."""
    counted = cells.groupBy(*COLUMN, F.col(value).alias("value"), *([type_col] if type_col else [])).agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"))
    return counted if type_col else with_type(counted, "value")


def type_frequencies(vals: DataFrame) -> DataFrame:
    """(table, column, cell_type, n, first_seen)."""
    return vals.groupBy(*COLUMN, "cell_type").agg(F.sum("n").alias("n"), F.min("first").alias("first_seen"))


def cell_words(value: Column) -> Column:
    """Words of a cell that count for the average: without punctuation and stopwords."""
    return F.size(F.filter(remove_stopwords(F.split(collapse_spaces(strip_punctuation(value)), " ")), lambda w: w != ""))


#: Metrics of a column from its sums (rows, n_empty, distinct values, words); further ones may be added.
METRICS: dict[str, Callable[[], Column]] = {
    "emc": lambda: F.lit(10) * F.col("n_empty") / F.col("rows"),
    "uc": lambda: F.col("n_distinct") / F.col("rows"),
    "aw": lambda: F.greatest("n_words", F.lit(1)) / F.col("rows"),
}


def _folded(vals: DataFrame) -> DataFrame:
    """One row per column: its sums and its types. Distinct values are summed by type first, so only a few rows per column meet."""
    words = F.sum(F.col("n") * cell_words(F.col("value")))
    by_type = vals.groupBy(*COLUMN, "cell_type").agg(F.sum("n").alias("n"), F.min("first").alias("first_seen"), F.count(F.lit(1)).alias("d"), words.alias("w"))
    own = F.when(~F.col("cell_type").isin("", "empty"), F.col("n")).otherwise(0)
    return by_type.groupBy(*COLUMN).agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("cell_type") == "empty", F.col("n")).otherwise(0)).alias("n_empty"),
        F.sum("d").alias("n_distinct"), F.sum("w").alias("n_words"), F.sum(own).alias("n_typed"),
        F.max_by("cell_type", F.struct("n", (-F.col("first_seen")).alias("f"))).alias("top"),
        F.array_sort(F.collect_list(F.struct("first_seen", "cell_type", "n"))).alias("freq"),
    )


def metrics(vals: DataFrame) -> DataFrame:
    """(table, column, rows, n_empty, emc, uc, aw)."""
    return _folded(vals).select(*COLUMN, "rows", "n_empty", *[f().alias(k) for k, f in METRICS.items()])


def classify(vals: DataFrame) -> DataFrame:
    """(table, column, rows, n_empty, emc, uc, aw, value_type, col_class, type_freq): LIT, NE or NO_ANN."""
    m = _folded(vals).withColumns({k: f() for k, f in METRICS.items()})
    wordy = F.col("aw") > WORDY
    typed = (F.col("n_typed") > F.lit(TYPED) * (F.col("rows") - F.col("n_empty"))) & (F.col("n_empty") <= F.lit(EMPTY) * F.col("rows"))
    kind = F.when(typed | wordy, F.when(wordy, F.lit("description")).otherwise(F.col("top")))
    m = m.withColumn("value_type", kind)
    none = (F.col("n_empty") >= F.lit(EMPTY) * F.col("rows")) | F.coalesce(F.col("value_type").isin("no_annotation", "id"), F.lit(False))
    m = m.withColumn("col_class", F.when(none, "NO_ANN").when(F.col("value_type").isNotNull(), "LIT").otherwise("NE"))
    rate = F.transform("freq", lambda x: F.struct(x.cell_type.alias("name"), x.n.alias("occurrences"), (x.n / F.col("rows")).alias("rate")))
    return m.withColumn("type_freq", rate).select(*COLUMN, "rows", "n_empty", *METRICS, "value_type", "col_class", "type_freq")


def _scored(columns: DataFrame) -> DataFrame:
    """All columns; the NE ones (``_ne``) with df, normalised metrics, the final score and the four scores that leave one metric out."""
    table = Window.partitionBy("table_id")
    is_ne = F.col("col_class") == "NE"
    of_ne = lambda f, c: f(F.when(is_ne, F.col(c))).over(table)
    ne = columns.withColumn("_ne", is_ne).withColumn("df", F.col("col_idx") - of_ne(F.min, "col_idx"))
    ne = ne.withColumn("emc_norm", F.when(F.col("emc") == 0, F.lit(0.0)).when(is_ne, F.col("emc") / of_ne(F.max, "emc"))).withColumn("uc_norm", F.when(is_ne, F.col("uc") / of_ne(F.max, "uc"))).withColumn("aw_norm", F.when(is_ne, F.col("aw") / of_ne(F.max, "aw")))
    ne = ne.withColumn("df_norm", F.col("df") + 1)
    e, u, a, d = (F.col(f"{x}_norm") for x in ("emc", "uc", "aw", "df"))
    return ne.select(
        "*", *[F.when(is_ne, c).alias(k) for k, c in {
            "score": (2 * u + a - e) / F.sqrt(d), "score_no_emc": (2 * u + a) / F.sqrt(d), "score_no_uc": (a - e) / F.sqrt(d),
            "score_no_df": 2 * u + a - e, "score_no_aw": (2 * u - e) / F.sqrt(d),
        }.items()],
    )


def subject_scores(columns: DataFrame) -> DataFrame:
    """NE columns with df, normalised metrics, the final score and the four scores that leave one metric out."""
    return _scored(columns).where("_ne").drop("_ne")


ABLATIONS = ["score_no_emc", "score_no_uc", "score_no_df", "score_no_aw"]


def subject_columns(columns: DataFrame) -> DataFrame:
    """(table_id, subject_col, subject_cols_paper) of every table; null where no column is an NE column. Ties: the first column."""
    best = lambda s: F.max_by("col_idx", F.when(F.col("_ne"), F.struct(F.round(s, 12).alias("s"), (-F.col("col_idx")).alias("c"))))
    return _scored(columns).groupBy("table_id").agg(best("score").alias("subject_col"), F.array(*[best(s) for s in ABLATIONS]).alias("subject_cols_paper"))


def column_groups(columns: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Columns with ``use``: NE for entity columns and targeted NO_ANN ones, LIT for the rest."""
    if targets is None:
        return columns.withColumn("use", F.when(F.col("col_class") == "NE", "NE").otherwise("LIT"))
    marked = columns.join(targets.select("table_id", "col_idx").distinct().withColumn("wanted", F.lit(True)), ["table_id", "col_idx"], "left")
    return marked.withColumn("use", F.when((F.col("col_class") == "NE") | ((F.col("col_class") == "NO_ANN") & F.col("wanted").isNotNull()), "NE").otherwise("LIT")).drop("wanted")


def dominant_type(columns: DataFrame) -> DataFrame:
    """(table, column, dominant): the type with the highest rate among a column's types, the first among equals."""
    return columns.select(*COLUMN, F.element_at(F.sort_array(F.transform("type_freq", lambda x, i: F.struct(x.rate.alias("r"), (-i).alias("i"), x["name"].alias("name"))), asc=False), 1)["name"].alias("dominant"))
