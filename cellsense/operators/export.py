"""Exports: annotations as CSV rows, linked rows as RDF."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.celltypes import XSD_BASE
from ..sources.tables import to_rows

ONTOLOGY = "http://dbpedia.org/ontology/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
BASE = "http://example.org/table/"


def class_rows(columns: DataFrame) -> DataFrame:
    """(table, col, classes) of every NE column by table name: addresses of winning_concepts(map), blank where there are none."""
    uris = F.array_join(F.transform(F.map_keys(F.coalesce("winning_concepts", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")))), lambda c: F.concat(F.lit(ONTOLOGY), c)), " ")
    return columns.where("col_class = 'NE'").select(F.col("table_id").alias("table"), F.col("col_idx").alias("col"), uris.alias("classes")).orderBy("table", "col")


def predicate_rows(columns: DataFrame, subjects: DataFrame) -> DataFrame:
    """(table, subject, col, rel): relations of NE columns other than the subject and of LIT columns; tables with an NE column only."""
    has_ne = columns.where("col_class = 'NE'").select("table_id").distinct()
    rows = columns.join(has_ne, "table_id", "left_semi").join(subjects, "table_id", "left").withColumn("subject", F.greatest(F.coalesce("subject_col", F.lit(0)), F.lit(0)))
    rows = rows.where((F.coalesce("rel", F.lit("")) != "") & ((F.col("col_class") == "LIT") | ((F.col("col_class") == "NE") & (F.col("col_idx") != F.col("subject")))))
    return rows.select(F.col("table_id").alias("table"), "subject", F.col("col_idx").alias("col"), "rel").orderBy("table", "col")


def entity_rows(links: DataFrame, base: int = 1) -> DataFrame:
    """(table, col, row, entity) of linked cells; rows count from ``base``."""
    return links.where(F.coalesce("entity", F.lit("")) != "").select(F.col("table_id").alias("table"), F.col("col_idx").alias("col"), (F.col("row_idx") + base).alias("row"), "entity").orderBy("table", "col", "row")


def targeted_entity_rows(links: DataFrame, target: DataFrame) -> DataFrame:
    """Entity rows of a target file, rows counted from 0."""
    return entity_rows(links.join(target.select("table_id", "col_idx").distinct(), ["table_id", "col_idx"], "left_semi"), base=0)


def targeted_predicate_rows(predicates: DataFrame, target: DataFrame) -> DataFrame:
    """Predicates of targeted columns, without those that have a further ``/`` in their name."""
    rows = predicates.join(target.select("table_id", "col_idx").distinct(), ["table_id", "col_idx"], "left_semi")
    return rows.where(F.instr(F.substr("p", F.lit(len(ONTOLOGY) + 1)), "/") == 0).select(F.col("table_id").alias("table"), F.col("col_idx").alias("col"), F.col("p").alias("rel")).orderBy("table", "col")


def literal_type(v: Column) -> Column:
    """integer, float, boolean or string: the first that the text parses as (commas are ignored for integers only)."""
    whole = F.replace(v, F.lit(","), F.lit("")).rlike(r"^\s*[+-]?\d+\s*$")
    return F.when(whole, "integer").when(v.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), "float").when(F.lower(v).isin("true", "false"), "boolean").otherwise("string")


def rdf_triples(cells: DataFrame, columns: DataFrame, links: DataFrame, subjects: DataFrame, class_: DataFrame | None = None) -> DataFrame:
    """Triples of each linked subject row: its class, column and row, its objects and typed attributes.

    cells(key, value), columns(table_id, col_idx, col_class, rel), links(key, entity), subjects(table_id, subject_col);
    keyed by table and row, so tables never meet."""
    subj = links.join(subjects, "table_id").where(F.col("col_idx") == F.col("subject_col")).select("table_id", "row_idx", "subject_col", F.col("entity").alias("s"))
    rel = columns.where(F.coalesce("rel", F.lit("")) != "").select("table_id", "col_idx", "col_class", "rel")
    row = lambda o, kind, p: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(XSD_BASE + kind).alias("o_datatype"))
    ids = subj.select("s", F.inline(F.array(row(F.col("subject_col"), "integer", BASE + "columnId"), row(F.col("row_idx"), "integer", BASE + "rowId"))))
    objects = subj.join(links.select("table_id", "row_idx", "col_idx", F.col("entity").alias("o")), ["table_id", "row_idx"]).where("col_idx <> subject_col").join(rel, ["table_id", "col_idx"])
    objects = objects.select("s", F.col("rel").alias("p"), "o", F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))
    attrs = subj.join(cells.select("table_id", "row_idx", "col_idx", "value"), ["table_id", "row_idx"]).join(rel.where("col_class = 'LIT'"), ["table_id", "col_idx"])
    attrs = attrs.select("s", F.col("rel").alias("p"), F.when(literal_type(F.col("value")) == "integer", F.replace("value", F.lit(","), F.lit(""))).otherwise(F.col("value")).alias("o"), F.lit("literal").alias("o_kind"), F.concat(F.lit(XSD_BASE), literal_type(F.col("value"))).alias("o_datatype"))
    out = ids.unionByName(objects).unionByName(attrs)
    if class_ is not None:
        named = subj.join(class_, "table_id").select("s", F.lit(TYPE).alias("p"), F.concat(F.lit(ONTOLOGY), "class").alias("o"), F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))
        out = out.unionByName(named)
    return out.distinct()


def _escaped(c: Column) -> Column:
    for plain, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def ntriples(triples: DataFrame) -> DataFrame:
    """(value): one N-Triples line per triple; valid Turtle and N3 as well."""
    literal = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), "o_datatype", F.lit(">")), F.lit("")))
    node = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit("_:"), _node_id(F.col(c)))).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    return triples.select(F.concat(node("s"), F.lit(" <"), "p", F.lit("> "), F.when(F.col("o_kind") == "literal", literal).otherwise(node("o")), F.lit(" .")).alias("value"))


def turtle(triples: DataFrame) -> DataFrame:
    """(value): one Turtle block per subject."""
    line = F.regexp_extract("value", r"^\S+ ((?s:.*)) \.$", 1)
    rows = ntriples(triples).select(F.substring_index("value", " ", 1).alias("s"), line.alias("po"))
    return rows.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list("po")), " ;\n    ").alias("po")).select(F.concat("s", F.lit(" "), "po", F.lit(" .")).alias("value"))


def json_ld(triples: DataFrame) -> DataFrame:
    """(value): one JSON-LD object per subject."""
    node = F.when(F.col("o_kind") != "literal", F.to_json(F.struct(F.col("o").alias("@id")))).otherwise(F.to_json(F.struct(F.col("o").alias("@value"), F.col("o_datatype").alias("@type"))))
    by_p = triples.groupBy("s", "p").agg(F.array_sort(F.collect_list(node)).alias("o"))
    pair = F.concat(F.to_json(F.struct(F.col("p").alias("k"))), F.lit(""))
    key = F.regexp_extract(pair, r'^\{"k":(.*)\}$', 1)
    rows = by_p.groupBy("s").agg(F.array_sort(F.collect_list(F.concat(key, F.lit(":["), F.array_join("o", ","), F.lit("]")))).alias("ps"))
    return rows.select(F.concat(F.lit('{"@id":"'), "s", F.lit('",'), F.array_join("ps", ","), F.lit("}")).alias("value"))


def rdf_xml(triples: DataFrame) -> DataFrame:
    """(value): one rdf:Description per subject; ``write_rdf`` puts the root element around those of a file.

    The name of an element is the predicate's longest end that is a name; a predicate without such an end can't be written as XML and
    raises an error. Characters that XML can't hold are replaced."""
    bad = "".join(chr(i) for i in range(32) if i not in (9, 10, 13))
    marks = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"))

    def esc(c: Column) -> Column:
        c = F.translate(c, bad, "\ufffd" * len(bad))
        for plain, mark in marks:
            c = F.replace(c, F.lit(plain), F.lit(mark))
        return c

    name = F.regexp_extract("p", r"([A-Za-z_][A-Za-z0-9_.-]*+)$", 1)
    space = F.substr("p", F.lit(1), F.length("p") - F.length(name))
    told = F.when(name == "", F.raise_error(F.concat(F.lit("no XML name in "), "p"))).otherwise(name)
    start = F.concat(F.lit("  <n:"), told, F.lit(' xmlns:n="'), esc(space), F.lit('"'))
    node = F.when(F.col("o").startswith("_:"), F.concat(F.lit(' rdf:nodeID="'), _node_id(F.col("o")), F.lit('"/>'))).otherwise(F.concat(F.lit(' rdf:resource="'), esc(F.col("o")), F.lit('"/>')))
    text = F.concat(start, F.coalesce(F.concat(F.lit(' rdf:datatype="'), esc(F.col("o_datatype")), F.lit('"')), F.lit("")), F.lit(">"), esc(F.col("o")), F.lit("</n:"), told, F.lit(">"))
    body = F.when(F.col("o_kind") == "literal", text).otherwise(F.concat(start, node))
    about = F.when(F.col("s").startswith("_:"), F.concat(F.lit('rdf:nodeID="'), _node_id(F.col("s")))).otherwise(F.concat(F.lit('rdf:about="'), esc(F.col("s"))))
    rows = triples.select(about.alias("s"), body.alias("b")).groupBy("s").agg(F.array_join(F.array_sort(F.collect_list("b")), "\n").alias("b"))
    return rows.select(F.concat(F.lit("<rdf:Description "), "s", F.lit('">\n'), "b", F.lit("\n</rdf:Description>")).alias("value"))


def _node_id(c: Column) -> Column:
    return F.concat(F.lit("b"), F.regexp_replace(c, "[^A-Za-z0-9]", "_"))


FORMATS = {"nt": ntriples, "n3": ntriples, "turtle": turtle, "json-ld": json_ld, "xml": rdf_xml}
#: What stands before, between and after the rows of a file, so that each file is a document of its format.
FRAMES = {"xml": ('<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">', "", "</rdf:RDF>"), "json-ld": ("[", ",", "]")}


def _framed(rows: DataFrame, head: str, between: str, foot: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [head]})
        first = True
        for b in batches:
            lead = [("" if first and i == 0 else between) + v for i, v in enumerate(b.value)]
            first = first and not lead
            yield pd.DataFrame({"value": lead})
        yield pd.DataFrame({"value": [foot]})

    return rows.mapInPandas(run, "value string")


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    """All fields quoted, lines end in CRLF."""
    rows.write.mode("append" if append else "overwrite").option("quoteAll", True).option("lineSep", "\r\n").csv(path)


def write_rdf(triples: DataFrame, path: str, fmt: str = "nt") -> None:
    """One document per partition: every file of the folder can be read on its own."""
    rows = FORMATS[fmt](triples)
    (_framed(rows, *FRAMES[fmt]) if fmt in FRAMES else rows).write.mode("overwrite").text(path)


def export_name(kind: str, ext: str, day: datetime.date | None = None) -> str:
    """The name of an export of a day."""
    return f"annotations_{kind}_{(day or datetime.date.today()):%d_%m_%Y}.{ext}"


def export(kind: str, fmt: str, path: str, frames: dict[str, DataFrame], tag: str | None = None) -> str:
    """Write one of CTA, CPA, CEA, RDF for all tables, or those of a corpus tag; the folder written."""
    if tag is not None:
        names = frames["tables"].where(F.col("gs_type") == tag).select("table_id")
        frames = {k: v.join(names, "table_id", "left_semi") if "table_id" in v.columns else v for k, v in frames.items()}
    to = f"{path}/{export_name(kind, 'csv' if kind != 'RDF' else fmt)}"
    if kind == "RDF":
        write_rdf(rdf_triples(frames["cells"], frames["columns"], frames["links"], frames["subjects"]), to, fmt)
    else:
        write_csv({"CTA": lambda: class_rows(frames["columns"]), "CPA": lambda: predicate_rows(frames["columns"], frames["subjects"]), "CEA": lambda: entity_rows(frames["links"])}[kind](), to)
    return to


def subject_first(cells: DataFrame, subjects: DataFrame) -> DataFrame:
    """(table_id, row_idx, row): each row's values with the subject column in front."""
    marked = cells.join(subjects.select("table_id", "subject_col"), "table_id", "left")
    return to_rows(marked, "value", F.when(F.col("col_idx") == F.col("subject_col"), -1).otherwise(F.col("col_idx")).cast("int"))


LOG = "task_id string, group string, type string, body string, table_id string, table_name string"


def log_record(kind: str, body: Column, table: Column, name: Column | None = None, group: str = "errors", task: str = "") -> Column:
    """A log entry of a run (``task``), for a frame of messages. An empty kind is refused."""
    if not kind:
        raise ValueError("a log entry needs a type")
    none = F.lit(None).cast("string")
    return F.struct(F.lit(task).alias("task_id"), F.lit(group).alias("group"), F.lit(kind).alias("type"), body.alias("body"), table.cast("string").alias("table_id"), (none if name is None else name).alias("table_name"))


def query_log(query: Column, error: Column, table: Column, task: str = "") -> Column:
    """The entry of a graph query that failed."""
    return log_record("sparql", F.concat(F.lit("Error: "), error, F.lit("\nQuery:\n"), query), table, task=task)


def lookup_log(text: Column, error: Column, table: Column, task: str = "") -> Column:
    """The entry of a keyword lookup that failed."""
    return log_record("lookup", F.concat(F.lit("Error: "), error, F.lit("\nText: "), text), table, task=task)


def write_log(entries: DataFrame, path: str) -> None:
    """Append entries (column ``log``) to the log, a folder of JSON lines per run; entries without a body and warnings are not kept."""
    rows = entries.select("log.*").where((F.length("body") > 0) & (F.col("group") == "errors"))
    rows.write.mode("append").partitionBy("task_id").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, errors): the entries of each run."""
    rows = spark.read.schema(LOG).json(path)
    entry = F.struct("type", "body", "table_id", "table_name")
    return rows.groupBy("task_id").agg(F.array_sort(F.collect_list(entry)).alias("errors"))
