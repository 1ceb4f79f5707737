"""The catalogue of tables: search, pages, views, edits, run state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 25
PHASES = ("data_preparation", "column_analysis", "concept_annotation", "predicate_annotation", "entity_linking")


def search(tables: DataFrame, name: str | None = None, gs_type: str | None = None, status: str | None = None, page: int = 0, page_size: int = PAGE) -> DataFrame:
    """A page by date of publication; filtered lists come as one page."""
    rows = tables
    if name:
        rows = rows.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if gs_type:
        rows = rows.where(F.col("gs_type") == gs_type)
    if status:
        rows = rows.where(F.col("global_status") == status)
    rows = rows.orderBy("pub_date", "table_id")
    return rows if name or gs_type or status else rows.offset(page * page_size).limit(page_size)


def grams(c: Column, n: int = 3) -> Column:
    """The distinct runs of ``n`` characters of a lower-cased text; none of a shorter one."""
    low = F.lower(c)
    return F.when(F.length(low) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substr(low, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def name_index(tables: DataFrame) -> DataFrame:
    """(gram, table_id): every table under the three-character runs of its name; to be written once and read by ``search_names``."""
    return tables.select(F.explode(grams(F.col("name"))).alias("gram"), "table_id")


def search_names(tables: DataFrame, index: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, table_id, name) of tables whose name holds a query of queries(q), in any case: those that the index has under the query's rarest run are tested.
    Queries of fewer than three characters have no run and are tested on every name."""
    asked = queries.select("q", F.lower("q").alias("low")).where("q <> ''").distinct()
    each = asked.select("q", F.explode(grams(F.col("q"))).alias("gram"))
    counts = index.join(each.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = each.join(counts, "gram", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0").select("q", F.col("x.gram").alias("gram"))
    met = index.join(rare, "gram").select("q", "table_id").join(tables.select("table_id", "name"), "table_id").withColumn("low", F.lower("q"))
    short = asked.where(F.length("low") < 3)
    few = tables.select("table_id", "name").join(short, F.contains(F.lower("name"), F.col("low"))) if not short.isEmpty() else None
    out = met.where(F.contains(F.lower("name"), F.col("low"))).select("q", "table_id", "name")
    return out if few is None else out.unionByName(few.select("q", "table_id", "name"))


def in_page_order(tables: DataFrame, files: int) -> DataFrame:
    """The catalogue dealt by ranges of its page order and sorted, to be written so: a page then lies in one file or two."""
    return tables.repartitionByRange(files, "pub_date", "table_id").sortWithinPartitions("pub_date", "table_id")


def page_after(tables: DataFrame, after: tuple | None = None, page_size: int = PAGE) -> DataFrame:
    """The page behind the row (pub_date, table_id) that was shown last, however far that is: files and row groups before it aren't read."""
    if after is not None:
        day, last = F.lit(after[0]), F.lit(after[1])
        tables = tables.where((F.col("pub_date") >= day) & ((F.col("pub_date") > day) | (F.col("table_id") > last)))
    return tables.orderBy("pub_date", "table_id").limit(page_size)


def status_counts(tables: DataFrame) -> DataFrame:
    return tables.groupBy("global_status").agg(F.count(F.lit(1)).alias("n"))


def phase_time(phases: DataFrame) -> DataFrame:
    """(table_id, total, done): sum of MM:SS times as MM:SS without hours; whether every phase is done."""
    part = F.split("execution_time", ":")
    seconds = part[0].cast("long") * 60 + part[1].cast("long")
    total = phases.groupBy("table_id").agg(F.sum(seconds).alias("s"), F.every(F.col("status") == "DONE").alias("done"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return total.select("table_id", F.concat(two(F.floor(F.col("s") % 3600 / 60)), F.lit(":"), two(F.col("s") % 60)).alias("total"), "done")


def next_phase(phases: DataFrame) -> DataFrame:
    """(table_id, name): the first phase by order that isn't done; null when all are."""
    return phases.groupBy("table_id").agg(F.min_by("name", F.when(F.col("status") != "DONE", F.col("ord"))).alias("name"))


def rows_view(cells: DataFrame, value: str = "value_raw") -> DataFrame:
    from ..sources.tables import to_rows

    return to_rows(cells, value)


def raw_download(cells: DataFrame, table_id: str, value: str = "value_raw") -> DataFrame:
    """(row_idx, line) of a table as CSV text in the order of its rows, the header first (row -1); all fields quoted."""
    one = cells.where(F.col("table_id") == table_id)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", F.col(c).alias("v")))), lambda x: quoted(x.v)), ",")
    head = one.select("col_idx", "header").distinct().groupBy(F.lit(-1).cast("long").alias("row_idx")).agg(line("header").alias("line"))
    rows = one.groupBy(F.col("row_idx").cast("long").alias("row_idx")).agg(line(value).alias("line"))
    return head.unionByName(rows).orderBy("row_idx")


def preparation_view(cells: DataFrame) -> DataFrame:
    """(table_id, row_idx, cells): value, type, and the original where it was changed."""
    one = F.struct("col_idx", "value", "cell_type", F.when(F.col("comment") != "", F.col("comment")).alias("comment"))
    return cells.groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_list(one)).alias("cells"))


def analysis_view(columns: DataFrame) -> DataFrame:
    """(table_id, columns): map from column to class, scores and type frequencies."""
    entry = F.struct("col_idx", F.struct("header", "col_class", "emc", "uc", "aw", "type_freq").alias("v"))
    return columns.groupBy("table_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("columns"))


def annotation_view(columns: DataFrame) -> DataFrame:
    """What can be edited of each column."""
    return columns.select("table_id", "col_idx", "header", "col_class", *[c for c in ("type", "rel", "data_type") if c in columns.columns])


def update(columns: DataFrame, table_id: str, col_idx: int, **changes) -> DataFrame:
    """The columns with some values of one column overwritten."""
    hit = (F.col("table_id") == table_id) & (F.col("col_idx") == col_idx)
    return columns.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in changes.items()})


def delete(tables: DataFrame, gs_type: str | None = None) -> DataFrame:
    """What stays after a corpus, or everything, is deleted."""
    return tables.where(F.lit(False)) if gs_type is None else tables.where(~F.col("gs_type").eqNullSafe(gs_type))


def reset(phases: DataFrame, table_id: str, name: str) -> DataFrame:
    """The phase of a table and those after it set back to TODO."""
    w = Window.partitionBy("table_id")
    at = F.max(F.when(F.col("name") == name, F.col("ord"))).over(w)
    return phases.withColumn("_at", at).withColumn("status", F.when((F.col("table_id") == table_id) & (F.col("ord") >= F.col("_at")), "TODO").otherwise(F.col("status"))).drop("_at")


def first_healthy(endpoints: DataFrame) -> DataFrame:
    """The endpoint of the highest priority that has no error."""
    return endpoints.where(~F.col("error")).orderBy("priority", "name").limit(1)


def concept_view(winners: DataFrame) -> DataFrame:
    """Concepts of a column, most frequent first."""
    return winners.groupBy("table_id", "col_idx").agg(F.sort_array(F.collect_list(F.struct("freq", "class")), asc=False).alias("concepts"))


def linking_view(links: DataFrame) -> DataFrame:
    return links.select("table_id", "col_idx", "row_idx", "entity")


def changed(value: Column, original: Column) -> Column:
    return F.when(value != original, original).otherwise(F.lit(""))
