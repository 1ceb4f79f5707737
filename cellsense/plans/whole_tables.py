"""Queries of the text, predicate and source operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import celltypes as T
from ..functions import similarity as S
from ..functions import text as X
from ..operators import catalog, concepts, linking
from ..sources import tables
from ..sources.stage import folder
from .phase_queries import _plural, _singular
from .queries import GRAPH, cells, graph, query, read, sql_cells

# ---- text ------------------------------------------------------------------------------------------------------------


@query("""SELECT 'part' AS source, p_partkey AS k, 'WORD:' || split_part(p_name, ' ', 1) || ' WORD:' || split_part(p_name, ' ', 2) || ' WORD:ca WORD:n''t WORD:Brand SYMBOL:# NUMBER:' || split_part(p_brand, '#', 2) || ' WORD:' || lower(p_type) || ' WORD:''s' AS tokens FROM part
 UNION ALL SELECT 'customer', c_custkey, 'WORD:Customer SYMBOL:# NUMBER:' || split_part(c_name, '#', 2) || ' PUNCTUATION:( CURRENCY:$ NUMBER:' || c_custkey || ' PUNCTUATION:) EMAIL:c' || c_custkey || '@x.com' FROM customer""")
def tokens_of_texts(spark, d):
    """Words, contractions, possessives, symbols, numbers, currencies and addresses of mails, in their order."""
    p, c = read(spark, d, "part"), read(spark, d, "customer")
    text = F.concat_ws(" ", "p_name", F.lit("can't"), "p_brand", F.concat(F.lower("p_type"), F.lit("'s")))
    mail = F.concat(F.col("c_name"), F.lit(" ($"), F.col("c_custkey").cast("string"), F.lit(") c"), F.col("c_custkey").cast("string"), F.lit("@x.com"))
    both = p.select(F.lit("part").alias("source"), F.col("p_partkey").alias("k"), text.alias("t")).unionByName(c.select(F.lit("customer").alias("source"), F.col("c_custkey").alias("k"), mail.alias("t")))
    shown = F.array_join(F.transform("tok", lambda x: F.concat_ws(":", x.tag, x.value)), " ")
    return both.withColumn("tok", X.tokenize(F.col("t"))).select("source", "k", shown.alias("tokens"))


@query("SELECT p_partkey, p_name || '''s \"cafe\" & ' || p_type || '...A' AS text FROM part")
def sanitized_texts(spark, d):
    """Typographic marks, letters with marks, entities of web pages, control characters and escapes."""
    dirty = F.concat(F.col("p_name"), F.lit("’s “caf\x07é” &amp; "), F.col("p_type"), F.lit("…\\u0041"))
    return read(spark, d, "part").select("p_partkey", X.sanitize(dirty).alias("text"))


def _sql_bag(words: str) -> str:
    return f"array_to_string(list_transform(list_sort(list_distinct({words})), lambda w: w || '=' || len(list_filter({words}, lambda x: x = w))), ',')"


@query(f"""SELECT p_partkey, {_sql_bag("string_split(p_name || ' ' || split_part(p_name, ' ', 1), ' ')")} AS cell, {_sql_bag("string_split(lower(p_type) || ' ' || p_name, ' ')")} AS entity, {_sql_bag("string_split(p_name || ' ' || p_name || ' of', ' ')")} AS abstract FROM part""")
def candidate_bags(spark, d):
    """The three bags that candidates are scored by, with words that stand twice."""
    p = read(spark, d, "part")
    b = X.bags(F.concat_ws(" ", "p_name", F.split("p_name", " ")[0]), F.concat_ws(" ", F.lower("p_type"), "p_name"), F.concat_ws(" ", "p_name", "p_name", F.lit("of")))
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",")
    return p.select("p_partkey", b.alias("b")).select("p_partkey", shown(F.col("b.cell")).alias("cell"), shown(F.col("b.entity")).alias("entity"), shown(F.col("b.abstract")).alias("abstract"))


@query("SELECT p_partkey, p_name || ' ' || lower(p_type) AS bag FROM part")
def uri_bags(spark, d):
    """Words of a row of addresses and literals: names of resources stay, other addresses go."""
    texts = F.array(F.concat(F.lit("http://dbpedia.org/resource/"), F.translate("p_name", " ", "_")), F.concat(F.lit("http://other.org/"), "p_brand"), F.col("p_type"))
    return read(spark, d, "part").select("p_partkey", F.array_join(X.context_bag(texts), " ").alias("bag"))


_FORMS = "SELECT DISTINCT unnest(string_split(p_name, ' ') || [lower(p_type), lower(p_type) || 's', 'ladies', split_part(p_name, ' ', 2) || 'es', split_part(p_name, ' ', 2) || 's']) AS w FROM part"


@query(f"SELECT w, {_singular('w')} AS one, {_plural('w')} AS many FROM ({_FORMS})")
def word_forms(spark, d):
    """Singular and plural of every word of the parts, and of their plurals."""
    second, kind = F.split("p_name", " ")[1], F.lower("p_type")
    ws = F.concat(F.split("p_name", " "), F.array(kind, F.concat(kind, F.lit("s")), F.lit("ladies"), F.concat(second, F.lit("es")), F.concat(second, F.lit("s"))))
    return read(spark, d, "part").select(F.explode(ws).alias("w")).distinct().select("w", X.singular(F.col("w")).alias("one"), X.plural(F.col("w")).alias("many"))


@query(GRAPH + " SELECT s, p, o, regexp_extract(s, '[^/]*$') || ' ' || regexp_extract(p, '[^/]*$') AS names, CASE WHEN contains(p, 'XMLSchema#') THEN 'xsd:' || split_part(p, '#', 2) ELSE regexp_extract(p, '[^/]*$') END AS label FROM g WHERE o_kind = 'uri'")
def graph_names(spark, d):
    """Last segments of addresses, and short labels, over the whole graph."""
    g = graph(spark, d).where("o_kind = 'uri'")
    return g.select("s", "p", "o", F.array_join(X.local_names(F.array("s", "p")), " ").alias("names"), X.short_label(F.col("p")).alias("label"))


def _headers(spark, d):
    return cells(spark, d).select("table_id", F.col("col_idx").cast("int").alias("col_idx"), "header").distinct()


@query(f"WITH h AS (SELECT DISTINCT table_id, col_idx, header FROM ({sql_cells()})) SELECT table_id, array_to_string(list_sort(flatten(list(regexp_extract_all(lower(header), '[0-9a-z_]+')))), ' ') AS context FROM h GROUP BY table_id")
def header_contexts(spark, d):
    return linking.header_context(_headers(spark, d)).select("table_id", F.array_join(F.filter("context", lambda w: w != ""), " ").alias("context"))


@query(f"""WITH h AS (SELECT DISTINCT table_id, col_idx, header FROM ({sql_cells()})), k AS (SELECT DISTINCT upper(header) AS class FROM h WHERE contains(header, 'name') OR contains(header, 'key'))
 SELECT DISTINCT table_id, col_idx, class FROM h JOIN k ON lower(class) = lower(header)""")
def headers_that_name_classes(spark, d):
    heads = _headers(spark, d)
    classes = heads.where(F.col("header").contains("name") | F.col("header").contains("key")).select(F.upper("header").alias("class")).distinct()
    return concepts.header_concepts(heads, classes)


# ---- predicates and scores -------------------------------------------------------------------------------------------


@query(f"""SELECT table_id, row_idx, col_idx, regexp_full_match(value_raw, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') AS is_float, regexp_full_match(value_raw, '\\s*[+-]?[0-9]+\\s*') AS is_integer FROM ({sql_cells()})""")
def number_predicates(spark, d):
    return cells(spark, d).select("table_id", "row_idx", "col_idx", T.is_float(F.col("value_raw")).alias("is_float"), T.is_integer(F.col("value_raw")).alias("is_integer"))


@query("SELECT o_orderkey, true AS day, true AS words, false AS month, false AS other FROM orders")
def exact_dates(spark, d):
    """Dates that the general parser reads, and texts that it doesn't."""
    day = F.col("o_orderdate")
    texts = {"day": F.date_format(day, "yyyy-MM-dd"), "words": F.date_format(day, "MMM d yyyy"), "month": F.date_format(day, "yyyy-13-dd"), "other": F.concat(F.lit("order "), F.col("o_orderpriority"))}
    return read(spark, d, "orders").select("o_orderkey", *[T.is_date_exact(c).alias(k) for k, c in texts.items()])


@query("""WITH a AS (SELECT DISTINCT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code FROM nation WHERE n_regionkey <> 2)
 SELECT c_custkey, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) AS one, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) AS two, false AS long FROM customer""")
def airport_codes(spark, d):
    """Codes of airports, from a table: alone, in lower case beside another, and in a longer text."""
    known = sorted(r.code for r in read(spark, d, "nation").where("n_regionkey <> 2").select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code")).collect())  # a fixed 25 rows at most
    code = F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    codes = F.array(*[F.lit(x) for x in known])
    texts = {"one": code, "two": F.concat(F.lower(code), F.lit(" xyz")), "long": F.concat(code, F.lit(" to some place"))}
    return read(spark, d, "customer").select("c_custkey", *[T.is_airport(v, codes).alias(k) for k, v in texts.items()])


@query("""SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 9) AS jaccard,
 round(least(levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand))), 9) AS score,
 round(levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 9) AS alone FROM (SELECT *, string_split(p_name, ' ') AS a, [split_part(p_name, ' ', 1), lower(p_type)] AS b FROM part)""")
def token_and_candidate_scores(spark, d):
    """Jaccard of word sets; the nearer of two names, and the only one."""
    words, other = F.split("p_name", " "), F.array(F.split("p_name", " ")[0], F.lower("p_type"))
    edit = lambda c: S.edit_distance(F.col("p_name"), F.col(c))
    return read(spark, d, "part").select(
        "p_partkey", F.round(S.jaccard(words, other), 9).alias("jaccard"), F.round(S.candidate_score(edit("p_type"), edit("p_brand")), 9).alias("score"), F.round(S.candidate_score(edit("p_type"), F.lit(None).cast("double")), 9).alias("alone"),
    )


@query("SELECT s_name AS name, CAST(s_nationkey AS INTEGER) AS priority, false AS error FROM supplier WHERE s_acctbal >= 0 ORDER BY s_nationkey, s_name LIMIT 1")
def endpoint_by_priority(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("int").alias("priority"), (F.col("s_acctbal") < 0).alias("error"))
    return catalog.first_healthy(s)


# ---- sources: what a query has written is read -----------------------------------------------------------------------


@query("SELECT 'customers' AS table_id, 0::INTEGER AS col_idx, c_custkey AS row_idx, 'http://kg.example/customer/' || c_custkey AS annotation FROM customer")
def export_read(spark, d):
    """An export of cells in CSV."""
    out = read(spark, d, "customer").select(F.lit("customers").alias("table_id"), F.lit(0).alias("col_idx"), F.col("c_custkey").alias("row_idx"), F.concat(F.lit("http://kg.example/customer/"), F.col("c_custkey").cast("string")).alias("annotation"))
    path = folder(spark)
    out.write.mode("overwrite").csv(path)
    return tables.read_export(spark, path)


@query("SELECT c_custkey AS row_idx, CAST(unnest([0, 1]) AS INTEGER) AS col_idx, unnest(['name', 'balance']) AS header, unnest([c_name, CAST(c_acctbal AS VARCHAR)]) AS value_raw, 'T2Dv2' AS gs_type FROM customer")
def corpus_read(spark, d):
    """A corpus with its tag: one file of records, in order of a key."""
    root = folder(spark)
    one = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").cast("string").alias("balance")))
    rows = read(spark, d, "customer").groupBy().agg(F.array_sort(F.collect_list(F.struct("c_custkey", one.alias("j")))).alias("xs"))
    text = rows.select(F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x.j), ","), F.lit("]")).alias("value"))
    text.write.mode("overwrite").text(f"{root}/T2Dv2/converted")
    got = tables.json_cells(spark.read.text(f"{root}/T2Dv2/converted", wholetext=True).select(F.lit("customers").alias("table_id"), "value")).withColumn("gs_type", F.lit("T2Dv2"))
    return got.select("row_idx", "col_idx", "header", "value_raw", "gs_type")


@query("SELECT n_name AS table_name, CAST(n_regionkey AS INTEGER) AS subject_col, CAST(n_nationkey AS DOUBLE) AS emc, 'Place' || n_regionkey AS type, 2::INTEGER AS entity_cols FROM nation")
def info_tables_read(spark, d):
    """Column catalogues written as JSON lines, with nested scores and concepts."""
    n = read(spark, d, "nation")
    col = lambda i: F.struct(F.lit(i).alias("index"), F.lit("h").alias("header"), F.struct(F.col("n_nationkey").cast("double").alias("emc")).alias("score"), F.concat(F.lit("Place"), F.col("n_regionkey").cast("string")).alias("type"), F.create_map(F.lit("Place"), F.lit(1.5)).alias("winning_concepts"))
    path = folder(spark)
    n.select(F.col("n_name").alias("table_name"), F.col("n_regionkey").cast("int").alias("subject_col"), F.array(col(0), col(1)).alias("ne_cols")).write.mode("overwrite").json(path)
    got = tables.read_info_tables(spark, path)
    return got.select("table_name", "subject_col", F.col("ne_cols")[0].score.emc.alias("emc"), F.col("ne_cols")[1].type.alias("type"), F.size("ne_cols").alias("entity_cols"))
