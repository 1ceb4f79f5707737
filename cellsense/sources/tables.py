"""Sources of tables: JSON records and CSV files become one long frame of cells.

cells(table_id, row_idx, col_idx, header, value_raw): one row per cell of every table. Row numbers come from a key or
from the order in a file, never from the partitioning.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prepare import small
from .stage import staged

CELLS = "table_id string, row_idx long, col_idx int, header string, value_raw string"


def to_cells(df: DataFrame, table_id: str, key: str) -> DataFrame:
    """Cells of a wide frame; ``key`` gives the row number and isn't a column of the table. Narrow: no shuffle."""
    names = [c for c in df.columns if c != key]
    cells = F.array(*[F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("header"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value_raw")) for i, c in enumerate(names)])
    return df.select(F.lit(table_id).alias("table_id"), F.col(key).cast("long").alias("row_idx"), F.inline(cells))


def _table_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


#: Cells of a JSON table that are handed on at once.
CHUNK = 50_000


def _records(text: str) -> Iterator:
    """The elements of a JSON array one by one, so that a large table is its text and one record, not all of them."""
    space = re.compile(r"[ \t\n\r]*")
    skip = lambda i: space.match(text, i).end()
    decode = json.JSONDecoder().raw_decode
    at = skip(0)
    if text[at : at + 1] != "[":
        yield from json.loads(text)
        return
    at = skip(at + 1)
    ended = text[at : at + 1] == "]"
    while not ended:
        record, at = decode(text, at)
        yield record
        at = skip(at)
        ended = text[at : at + 1] == "]"
        if not ended:
            if text[at : at + 1] != ",":
                raise ValueError(f"no comma at {at}")
            at = skip(at + 1)
    if skip(at + 1) != len(text):
        raise ValueError("text after the array")


def _json_cells(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["table_id", "row_idx", "col_idx", "header", "value_raw"]
    for batch in texts:
        for name, text in zip(batch.table_id, batch.value, strict=True):
            try:
                for _ in _records(text):  # a text that isn't JSON gives no rows at all
                    pass
            except ValueError:
                continue
            header, rows = None, []
            for r, rec in enumerate(_records(text)):
                header = list(rec) if header is None else header
                rows += [(name, r, c, h, "" if rec.get(h) is None else str(rec.get(h, ""))) for c, h in enumerate(header)]
                if len(rows) >= CHUNK:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)


def read_json_tables(spark: SparkSession, path: str) -> DataFrame:
    """Tables stored as one JSON array of objects per file; the first object names the columns, missing keys are empty,
    other keys are dropped. One file is one table, so files are the unit of work."""
    texts = spark.read.text(path, wholetext=True).select(_table_name(F.input_file_name()).alias("table_id"), "value")
    return json_cells(texts)


def json_cells(texts: DataFrame) -> DataFrame:
    """Cells of texts(table_id, value), each a JSON array of objects, at hand."""
    return texts.mapInPandas(_json_cells, CELLS)


def unread_json_tables(spark: SparkSession, path: str) -> DataFrame:
    """(table_id) of the files that ``read_json_tables`` leaves out, as they hold no list of objects."""
    texts = spark.read.text(path, wholetext=True).select(_table_name(F.input_file_name()).alias("table_id"), "value")
    return texts.where(F.from_json("value", "array<map<string,string>>").isNull()).select("table_id")


def read_corpus(spark: SparkSession, root: str, tag: str) -> DataFrame:
    """The tables of a gold-standard corpus, with its tag."""
    return read_json_tables(spark, f"{root}/{tag}/converted/*.json").withColumn("gs_type", F.lit(tag))


def read_json_records(spark: SparkSession, records: list[dict], table_id: str) -> DataFrame:
    """An uploaded table: records already parsed."""
    text = spark.createDataFrame([(table_id, json.dumps(records))], "table_id string, value string")
    return text.mapInPandas(_json_cells, CELLS)


def read_csv_strict(spark: SparkSession, path: str, sep: str = ",", quote: str = '"') -> DataFrame:
    """(table_id, row_idx, fields): escaped quotes read as apostrophes; empty rows dropped."""
    return _csv(spark, path, sep, quote, "utf-8", lambda t: t.replace('\\"', "'"))


#: Encoding and mending of files that aren't clean.
TOLERANT = ("iso-8859-1", lambda t: t.replace("\0", ""))


def read_csv_tolerant(spark: SparkSession, path: str, sep: str = ",", quote: str = '"') -> DataFrame:
    """(table_id, row_idx, fields): Latin-1, NUL bytes removed, empty rows dropped."""
    return _csv(spark, path, sep, quote, *TOLERANT)


def _csv(spark: SparkSession, path: str, sep: str, quote: str, encoding: str, mend) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select(_table_name(F.col("path")).alias("table_id"), "content")
    return csv_rows(files, sep, quote, encoding, mend)


def csv_rows(files: DataFrame, sep: str = ",", quote: str = '"', encoding: str = "utf-8", mend=lambda t: t.replace('\\"', "'")) -> DataFrame:
    """(table_id, row_idx, fields) of files(table_id, content) at hand, by default as ``read_csv_strict``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for b in batches:
            for name, content in zip(b.table_id, b.content, strict=True):
                rows = [r for r in csv.reader(io.StringIO(mend(content.decode(encoding, "replace")), newline=""), delimiter=sep, quotechar=quote) if r]
                if rows:
                    yield pd.DataFrame({"table_id": name, "row_idx": range(len(rows)), "fields": rows})

    return files.mapInPandas(run, "table_id string, row_idx long, fields array<string>")


def modal_length(rows: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """(keys, width): the most frequent row length of each table, among equals the larger."""
    counts = rows.groupBy(*keys, size.alias("width")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("width", F.struct("n", "width")).alias("width"))


def mend_csv(rows: DataFrame, bad: list[str] = ()) -> DataFrame:
    """Cells of ragged CSV rows (table_id, row_idx, fields).

    The width is the modal row length. The header is the first row; a header of one field is taken from the second
    row; a header shorter than the width is padded and the first row stays data; blank names become ``NO-HEADERi``
    and repeated ones get their number. Short rows are padded. Rows of one field are dropped in tables named in ``bad``.
    """
    rows = rows.where(~F.col("table_id").isin(*bad) | (F.size("fields") > 1)) if bad else rows
    width = modal_length(rows, ["table_id"], F.size("fields"))
    first = small(staged(rows.groupBy("table_id").agg(F.min_by("fields", "row_idx").alias("h0"), F.min("row_idx").alias("r0"))))
    second = rows.join(first, "table_id").where("row_idx > r0").groupBy("table_id").agg(F.min_by("fields", "row_idx").alias("h1"), F.min("row_idx").alias("r1"))
    head = first.join(width, "table_id").join(second, "table_id", "left")
    single = (F.size("h0") == 1) & F.col("h1").isNotNull()
    raw = F.when(single, F.col("h1")).otherwise(F.col("h0"))
    full = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get(raw, i), F.lit("")))
    named = F.transform(full, lambda h, i: F.when(F.trim(h) == "", F.concat(F.lit("NO-HEADER"), i.cast("string"))).otherwise(F.trim(h)))
    unique = F.transform(named, lambda h, i: F.when(F.exists(F.slice(named, F.lit(1), i), lambda x: x == h), F.concat_ws(" ", h, i.cast("string"))).otherwise(h))
    short = ~single & (F.size("h0") < F.col("width"))
    head = head.select("table_id", "width", unique.alias("header"), F.when(single, F.col("r1") + 1).when(short, F.col("r0")).otherwise(F.col("r0") + 1).alias("start"))
    # few tables: their rows stay where they are, as a shuffle would bring all of a table's to one task
    data = rows.join(small(staged(head)), "table_id").where("row_idx >= start")
    cells = F.transform("header", lambda h, i: F.struct(i.cast("int").alias("col_idx"), h.alias("header"), F.coalesce(F.get("fields", i), F.lit("")).alias("value_raw")))
    return data.select("table_id", (F.col("row_idx") - F.col("start")).alias("row_idx"), F.inline(cells))


def convert_directory(spark: SparkSession, path: str, out: str, bad: list[str] = ()) -> DataFrame:
    """Convert all CSV files below ``path`` to JSON tables, one folder of records per table; a report by name (see ``conversion_report``)."""
    files = spark.read.format("binaryFile").load(path).select(_table_name(F.col("path")).alias("table_id"), "content")
    return conversion_report(files, out, bad)


def conversion_report(files: DataFrame, out: str, bad: list[str] = ()) -> DataFrame:
    """(table_id, rows, ok, reason) of files(table_id, content) of CSV, whose records are written below ``out`` as JSON, one folder per table.

    ``rows`` counts the records that were written, in the pass that writes them; ``ok`` tells whether there are any. ``reason`` tells what was wrong: bytes that
    aren't UTF-8 (read with marks in their place), no rows, or rows of another width than most (filled up or cut)."""
    from ..functions.text import sanitize

    spark = files.sparkSession
    rows = staged(csv_rows(files))
    cells = mend_csv(rows, bad).withColumn("header", sanitize("header")).withColumn("value_raw", sanitize("value_raw"))
    records = cells.groupBy("table_id", "row_idx").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "header", "value_raw"))), lambda x: F.struct(x.header, x.value_raw))).alias("record"))
    records.select("table_id", "row_idx", F.to_json("record").alias("value")).repartition("table_id").sortWithinPartitions("table_id", "row_idx").select("table_id", "value").write.mode("overwrite").partitionBy("table_id").text(out)
    written = spark.read.schema("value string, table_id string").text(out).groupBy("table_id").agg(F.count(F.lit(1)).alias("rows"))
    width = modal_length(rows, ["table_id"], F.size("fields"))
    other = rows.join(width, "table_id").where(F.size("fields") != F.col("width")).groupBy("table_id").agg(F.count(F.lit(1)).alias("other"))
    valid = files.groupBy("table_id").agg(F.every(F.is_valid_utf8(F.col("content").cast("string"))).alias("valid"))
    known = valid.join(written, "table_id", "left").join(other, "table_id", "left")
    n = F.coalesce("rows", F.lit(0).cast("long"))
    reason = F.when(~F.col("valid"), "not UTF-8").when(n == 0, "no rows").when(F.col("other").isNotNull(), F.concat(F.col("other").cast("string"), F.lit(" rows of another width")))
    return known.select("table_id", n.alias("rows"), (n > 0).alias("ok"), reason.alias("reason")).orderBy("table_id")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of a text asset, carriage returns removed."""
    return spark.read.text(path).select(F.replace("value", F.lit("\r"), F.lit("")).alias("value"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(name) of the files of a folder, in order."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).orderBy("name")


#: A column catalogue: entity columns with scores, type and winning concepts, literal columns with patterns, schema types and
#: frequencies, columns without annotation.
INFO_TABLE = (
    "table_name string, subject_col int, subject_cols_paper array<int>, "
    "ne_cols array<struct<index:int,header:string,score:struct<emc:double,uc:double,aw:double,df:double,emcNorm:double,ucNorm:double,awNorm:double,dfNorm:double,finalScore:double,finalScore_paper:array<double>>,type:string,winning_concepts:map<string,double>>>, "
    "lit_cols array<struct<index:int,header:string,regex_type:array<string>,data_type:array<struct<label:string,uri:string>>,"
    "type_freq_table:array<struct<name:string,occurrences:long,rate:double>>>>, "
    "no_ann_cols array<struct<index:int,header:string,type:string>>"
)


def read_info_tables(spark: SparkSession, path: str) -> DataFrame:
    """Column catalogues exported as JSON lines."""
    return spark.read.schema(INFO_TABLE).json(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(table_id, col_idx, row_idx, annotation) of an earlier cell export."""
    return spark.read.csv(path, schema="table_id string, col_idx int, row_idx long, annotation string", ignoreLeadingWhiteSpace=True)


def read_targets(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Challenge targets: ``cta`` (table, col), ``cpa`` (table, subject, col), ``cea`` (table, col, row)."""
    names = {"cta": "table_id string, col_idx int", "cpa": "table_id string, subject_col int, col_idx int", "cea": "table_id string, col_idx int, row_idx long"}[kind]
    return spark.read.csv(path, schema=names, ignoreLeadingWhiteSpace=True)


def group_targets(targets: DataFrame, kind: str) -> DataFrame:
    """Targets per table: columns, or rows per column."""
    if kind == "cea":
        return targets.groupBy("table_id", "col_idx").agg(F.array_sort(F.collect_list("row_idx")).alias("rows"))
    return targets.groupBy("table_id").agg(F.array_sort(F.collect_list("col_idx")).alias("cols"))


def table_shape(cells: DataFrame) -> DataFrame:
    """(table_id, header, num_cols, num_rows)."""
    heads = cells.groupBy("table_id", "col_idx", "header").agg(F.count_distinct("row_idx").alias("n"))
    return heads.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "header"))), lambda x: x.header).alias("header"), F.count(F.lit(1)).alias("num_cols"), F.max("n").alias("num_rows"))


def to_rows(cells: DataFrame, value: str = "value_raw", order: Column | None = None) -> DataFrame:
    """(table_id, row_idx, row): the values of each row in the order of the columns, or of ``order``."""
    at = F.col("col_idx").cast("int") if order is None else order
    return cells.groupBy("table_id", "row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(value).alias("v")))), lambda x: x.v).alias("row"))


def row_numbers(df: DataFrame, table: str, key: str, tasks: int | None = None) -> DataFrame:
    """Row numbers from 0 by a key, for tables whose key isn't a number.

    Rows are dealt by ranges of (table, key) and written with their range's number, so they are dealt once however often they are read; they are
    numbered within each range, and moved on by the rows of the table's ranges before. So a table of any size is numbered by many tasks.
    ``tasks`` is the number of ranges and of the tasks that number them, by default the session's shuffle partitions.
    Rows with equal keys are numbered by the hash of all their columns, rows that are alike in any order."""
    ranges = df.repartitionByRange(F.col(table), F.col(key)) if tasks is None else df.repartitionByRange(tasks, F.col(table), F.col(key))
    dealt = staged(ranges.withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(table, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(table).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(table).alias("_table"), F.col("_part").alias("_at"), F.coalesce(before, F.lit(0)).alias("_start"))
    tie = F.xxhash64(F.lit(0), *[F.col(c) for c, kind in df.dtypes if c not in (table, key) and "map" not in kind])
    local = (dealt if tasks is None else dealt.repartition(tasks, table, "_part")).withColumn("_local", F.row_number().over(Window.partitionBy(table, "_part").orderBy(F.col(key), tie)) - 1)
    out = local.join(starts, F.col(table).eqNullSafe(F.col("_table")) & (F.col("_part") == F.col("_at")))
    return out.withColumn("row_idx", (F.col("_start") + F.col("_local")).cast("long")).drop("_part", "_at", "_table", "_start", "_local")
