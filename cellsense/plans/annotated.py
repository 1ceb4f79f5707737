"""Queries over whole phases, and of operators that need a graph or files at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import candidates as Q
from ..operators import catalog, concepts, export, linking
from ..sources import lexicons, tables, triples, turtle_split
from ..sources.stage import folder
from ..sources.store import TripleStore
from .pipeline import annotate
from .queries import (
    GRAPH, KG, LABEL, METRIC_SQL, ONTO, REDIRECT, TYPE, cells, classified, graph, query, ragged_rows, read, sql_cells,
)

# ---- one call from cells to annotations ------------------------------------------------------------------------------
#
# Customers as a web table: name, nation and balance. Every tenth name is unknown to the graph (a miss); every seventh balance is off by 0.1
# (nearly equal); every fifth customer has a double of the same name without a nation (fewer columns speak for it), every eleventh a
# twin with all the same triples (a tie, which the smaller address wins); every third customer has a second, rarer predicate to its nation.


def _land(key: str):
    """A nation's name as the table and the graph have it."""
    return F.concat(F.lit("Land "), (F.col(key) + 100).cast("string"))


def _web_table(spark, d):
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    name = F.when(k % 10 == 0, F.concat(F.lit("Nobody "), k.cast("string"), F.lit(" unknown"))).otherwise(F.col("c_name"))
    balance = F.when(k % 7 == 0, F.round(F.col("c_acctbal") + 0.1, 2)).otherwise(F.col("c_acctbal"))
    return tables.to_cells(c.select(k, name.alias("name"), _land("c_nationkey").alias("nation"), balance.alias("balance")), "customers", "c_custkey")


def _web_graph(spark, d):
    c = read(spark, d, "customer")
    u = lambda kind, x: F.concat(F.lit(f"{KG}{kind}/"), F.col(x).cast("string"))
    home, lits = u("nation", "c_nationkey"), {LABEL: F.col("c_name"), ONTO + "balance": F.col("c_acctbal")}
    lands = triples.triples_of(read(spark, d, "nation"), u("nation", "n_nationkey"), {}, {LABEL: _land("n_nationkey")})
    third = triples.triples_of(c.where("c_custkey % 3 = 0"), u("customer", "c_custkey"), {ONTO + "homeCountry": home})
    double = triples.triples_of(c.where("c_custkey % 5 = 0"), u("double", "c_custkey"), {TYPE: F.lit(ONTO + "Double")}, {LABEL: F.col("c_name")})
    twin = triples.triples_of(c.where("c_custkey % 11 = 0"), u("twin", "c_custkey"), {ONTO + "nation": home, TYPE: F.lit(ONTO + "Twin")}, lits)
    return graph(spark, d).unionByName(lands).unionByName(third).unionByName(double).unionByName(twin)


def _annotations(spark, d):
    return annotate(_web_table(spark, d), _web_graph(spark, d), LABEL, REDIRECT, TYPE, ONTO)


@query(f"""SELECT 'customers' AS table_id, c_custkey AS row_idx, CAST(unnest([0, 1]) AS INTEGER) AS col_idx, unnest(['{KG}customer/' || c_custkey, '{KG}nation/' || c_nationkey]) AS entity FROM customer WHERE c_custkey % 10 <> 0""")
def annotate_cea(spark, d):
    return _annotations(spark, d)["cea"].select("table_id", "row_idx", F.col("col_idx").cast("int").alias("col_idx"), "entity")


@query(f"SELECT * FROM (VALUES ('customers', 0::INTEGER, 1::INTEGER, '{ONTO}nation'), ('customers', 0, 2, '{ONTO}balance')) t(table_id, subject_col, col_idx, p)")
def annotate_cpa(spark, d):
    return _annotations(spark, d)["cpa"]


@query("SELECT * FROM (VALUES ('customers', 0::INTEGER, 'Customer'), ('customers', 1, 'Nation')) t(table_id, col_idx, class)")
def annotate_cta(spark, d):
    return _annotations(spark, d)["cta"]


@query("SELECT * FROM (VALUES ('customers', 0::INTEGER, 'Customer'), ('customers', 1, 'Nation')) t(table_id, col_idx, class)")
def annotate_cta_by_branch(spark, d):
    """Classes by the branch of an ontology, over triples kept by subject."""
    edges = spark.createDataFrame([("Agent", "Customer"), ("Agent", "Supplier"), ("Customer", "Twin"), ("Customer", "Double"), ("Place", "Nation"), ("Place", "Region")], "parent string, child string")
    order = spark.createDataFrame([("Agent", 0), ("Place", 1)], "root string, rank int")
    store = TripleStore.write(_web_graph(spark, d), folder(spark))
    return annotate(_web_table(spark, d), store.by_subject, LABEL, REDIRECT, TYPE, ONTO, paths=concepts.ontology_paths(edges, order), order=order, kept=True)["cta"]


@query(f"""WITH c AS (SELECT c_custkey AS k, c_acctbal AS b, CASE WHEN c_custkey % 7 = 0 THEN round(c_acctbal + 0.1, 2) ELSE c_acctbal END AS cell FROM customer)
 SELECT k AS row_idx, '{KG}customer/' || k AS s, '{ONTO}balance' AS p, b = cell AS exact FROM c WHERE abs(b - cell) < 0.2""")
def literal_match_near(spark, d):
    """Literals that match exactly, and those that only nearly do."""
    subject = read(spark, d, "customer").select(F.lit("customers").alias("table_id"), F.col("c_custkey").alias("row_idx"), F.concat(F.lit(f"{KG}customer/"), F.col("c_custkey").cast("string")).alias("s"))
    literal = _web_table(spark, d).where("col_idx = 2").select("table_id", "row_idx", "col_idx", F.col("value_raw").alias("value"))
    return linking.match_literals(subject, literal, graph(spark, d)).select("row_idx", "s", "p", "exact")


# ---- candidates ------------------------------------------------------------------------------------------------------

NATIONS = "WITH g AS (SELECT * FROM t), q AS (SELECT lower(n_name) AS q, n_nationkey AS k FROM nation)".replace("(SELECT * FROM t)", GRAPH[len("WITH g AS "):])


def _nation_queries(spark, d):
    return read(spark, d, "nation").select(F.lower("n_name").alias("q"))


@query(NATIONS + f" SELECT DISTINCT q, g.s, 'None' AS alias, g.p, g.o FROM q JOIN g ON g.s = '{KG}nation/' || q.k")
def entities_outgoing(spark, d):
    return Q.entities(_nation_queries(spark, d), graph(spark, d), LABEL, REDIRECT)


@query(NATIONS + f" SELECT DISTINCT q, '{KG}nation/' || q.k AS s, 'None' AS alias, g.p, g.s AS o FROM q JOIN g ON g.o = '{KG}nation/' || q.k")
def entities_incoming(spark, d):
    return Q.entities(_nation_queries(spark, d), graph(spark, d), LABEL, REDIRECT, symmetric=True)


@query(NATIONS + f""", w AS (SELECT q, unnest(string_split(q, ' ')) AS w FROM q), h AS (SELECT DISTINCT w.q, '{KG}nation/' || x.k AS s FROM w JOIN (SELECT k, unnest(string_split(q, ' ')) AS w FROM q) x USING (w))
 SELECT DISTINCT q, s, 'None' AS alias, p, o FROM h JOIN g USING (s)""")
def entities_any_word(spark, d):
    return Q.entities(_nation_queries(spark, d), graph(spark, d), LABEL, REDIRECT, any_word=True)


@query(NATIONS + f" SELECT DISTINCT q, '{KG}nation/' || q.k AS s, 'None' AS alias, g.p, g.s AS o FROM q JOIN g ON g.o = '{KG}nation/' || q.k")
def person_incoming(spark, d):
    people = read(spark, d, "nation").select(F.lower("n_name").alias("q"), F.lower("n_name").alias("prefix"), F.lower("n_name").alias("surname"))
    return Q.person_entities(people, graph(spark, d), LABEL, TYPE, ONTO + "Nation", symmetric=True)


@query(NATIONS + f" SELECT DISTINCT q, g.s, g.p, g.o FROM q JOIN g ON g.s = '{KG}nation/' || q.k OR g.o = '{KG}nation/' || q.k")
def subgraph_both_ways(spark, d):
    cand = read(spark, d, "nation").select(F.lower("n_name").alias("q"), F.concat(F.lit(f"{KG}nation/"), F.col("n_nationkey").cast("string")).alias("s"))
    return Q.subgraph(cand, graph(spark, d))


@query(NATIONS + f" SELECT DISTINCT q, g.s, g.p, g.o FROM q JOIN g ON g.s = '{KG}nation/' || q.k")
def raw_subgraph(spark, d):
    return Q.raw_subgraph(_nation_queries(spark, d), graph(spark, d), (LABEL, "http://xmlns.com/foaf/0.1/name"))


@query(NATIONS + f" SELECT DISTINCT q, g.s, g.p, g.o FROM q JOIN g ON g.s = '{KG}nation/' || q.k OR g.o = '{KG}nation/' || q.k")
def person_subgraph(spark, d):
    people = read(spark, d, "nation").select(F.lower("n_name").alias("q"), F.lower("n_name").alias("prefix"), F.lower("n_name").alias("surname"))
    return Q.person_subgraph(people, graph(spark, d), LABEL, REDIRECT)


@query(f"SELECT '{KG}supplier/' || s_suppkey AS s, CASE WHEN s_suppkey % 2 = 0 THEN 'about ' || s_name END AS abstract FROM supplier")
def abstracts_optional(spark, d):
    s = read(spark, d, "supplier")
    u = F.concat(F.lit(f"{KG}supplier/"), F.col("s_suppkey").cast("string"))
    text = triples.triples_of(s.where("s_suppkey % 2 = 0"), u, {}, {ONTO + "abstract": F.concat(F.lit("about "), "s_name")}, "en")
    german = triples.triples_of(s, u, {}, {ONTO + "abstract": F.concat(F.lit("von "), "s_name")}, "de")
    cand = s.select(F.col("s_name").alias("q"), u.alias("s"), F.lit("None").alias("alias"))
    return Q.abstracts(cand, text.unionByName(german), ONTO + "abstract").select("s", "abstract")


@query("SELECT DISTINCT p_name AS label FROM part WHERE starts_with(lower(p_name), 's') ORDER BY length(p_name), p_name LIMIT 7")
def label_suggestions(spark, d):
    return Q.suggestions(read(spark, d, "part").select(F.col("p_name").alias("label")).distinct(), "S")


@query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def bound_query(spark, d):
    """A query text with values bound, not pasted."""
    return Q.bind(spark, "SELECT n_name FROM {t} WHERE n_regionkey = :r AND n_name <> :n", {"r": 2, "n": "x' OR 1=1 --"}, t=read(spark, d, "nation"))


@query(GRAPH + " SELECT DISTINCT s FROM g")
def graph_subjects(spark, d):
    return Q.sources_in(graph(spark, d))


@query(GRAPH + " SELECT count(*) > 0 AS healthy, false AS empty FROM g")
def graph_health(spark, d):
    g = graph(spark, d)
    return spark.createDataFrame([(Q.healthy(g), Q.healthy(g.where("false")))], "healthy boolean, empty boolean")


@query(f"""WITH q AS (SELECT DISTINCT lower(substr(n_name, 1, k)) AS q FROM nation, (SELECT unnest([1, 2, 5]) AS k)), h AS (SELECT q, n_name AS label, row_number() OVER (PARTITION BY q ORDER BY length(n_name), n_name) AS i FROM q JOIN nation ON starts_with(lower(n_name), q))
 SELECT q, label, 'Nation' AS classes FROM h WHERE i <= 5""")
def prefix_lookup_short(spark, d):
    """Lookups by one, two and five letters."""
    q = read(spark, d, "nation").select(F.explode(F.array(*[F.lower(F.substring("n_name", 1, k)) for k in (1, 2, 5)])).alias("q")).distinct()
    g = graph(spark, d).where(F.col("s").contains("/nation/"))
    return triples.prefix_lookup(g, q, LABEL, TYPE, classes=ONTO).select("q", "label", F.array_join("classes", ",").alias("classes"))


# ---- sources ---------------------------------------------------------------------------------------------------------


@query(sql_cells(["nation"]).replace("CAST(n_nationkey AS BIGINT)", "row_number() OVER (ORDER BY n_nationkey) - 1").replace("'n_name' AS header", "'name' AS header").replace("'n_regionkey' AS header", "'region' AS header"))
def json_tables(spark, d):
    """A table stored as one JSON array of objects."""
    one = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))), lambda r: F.struct(r.n_name.alias("name"), r.n_regionkey.alias("region"))))
    return tables.json_cells(read(spark, d, "nation").agg(F.lit("nation").alias("table_id"), one.alias("value")))


@query(sql_cells(["region"]).replace("'r_name' AS header", "'name' AS header").replace("CAST(r_regionkey AS BIGINT)", "row_number() OVER (ORDER BY r_regionkey) - 1"))
def json_upload(spark, d):
    records = [{"name": r.r_name} for r in read(spark, d, "region").orderBy("r_regionkey").collect()]  # the five regions
    return tables.read_json_records(spark, records, "region")


def _csv_file(spark, d, line):
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x.l), "\n")
    return read(spark, d, "nation").agg(F.lit("nation").alias("table_id"), F.concat(F.lit("key,name\n\n"), rows, F.lit("\n")).alias("text"))


@query("""SELECT 'nation' AS table_id, CAST(0 AS BIGINT) AS row_idx, 'key|name' AS fields UNION ALL SELECT 'nation', row_number() OVER (ORDER BY n_nationkey), n_nationkey || '|a ''' || n_name || ''', b' FROM nation""")
def csv_strict(spark, d):
    """Escaped quotes are apostrophes, quoted commas stay, empty rows go."""
    f = _csv_file(spark, d, F.concat(F.col("n_nationkey").cast("string"), F.lit(',"a \\"'), "n_name", F.lit('\\", b"')))
    return tables.csv_rows(f.select("table_id", F.encode("text", "UTF-8").alias("content"))).select("table_id", "row_idx", F.array_join("fields", "|").alias("fields"))


@query("""SELECT 'nation' AS table_id, CAST(0 AS BIGINT) AS row_idx, 'key|name' AS fields UNION ALL SELECT 'nation', row_number() OVER (ORDER BY n_nationkey), n_nationkey || '|é' || n_name FROM nation""")
def csv_tolerant(spark, d):
    """Latin-1 bytes and NULs."""
    f = _csv_file(spark, d, F.concat(F.col("n_nationkey").cast("string"), F.lit(",é\0"), "n_name"))
    encoding, mend = tables.TOLERANT
    return tables.csv_rows(f.select("table_id", F.encode("text", "ISO-8859-1").alias("content")), encoding=encoding, mend=mend).select("table_id", "row_idx", F.array_join("fields", "|").alias("fields"))


@query(f"""WITH r AS (SELECT role AS t, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS i, string_split(text, ' ') AS f FROM conversations), w AS (SELECT t, first(k ORDER BY n DESC, k DESC) AS w FROM (SELECT t, len(f) AS k, count(*) AS n FROM r GROUP BY ALL) GROUP BY t),
 h AS (SELECT t, w, list_transform(range(1, w + 1), lambda i: CASE WHEN trim(coalesce(f[i], '')) = '' THEN 'NO-HEADER' || (i - 1) ELSE trim(f[i]) END) AS h, CASE WHEN len(f) < w THEN 0 ELSE 1 END AS s FROM r JOIN w USING (t) WHERE i = 0),
 u AS (SELECT t, w, s, list_transform(range(1, w + 1), lambda i: CASE WHEN list_contains(h[1:i - 1], h[i]) THEN h[i] || ' ' || (i - 1) ELSE h[i] END) AS h FROM h)
 SELECT t AS table_id, i - s AS row_idx, CAST(c AS INTEGER) AS col_idx, h[c + 1] AS header, coalesce(f[c + 1], '') AS value_raw FROM r JOIN u USING (t), unnest(range(0, w)) x(c) WHERE i >= s""")
def csv_mended_cells(spark, d):
    """Every cell and header of ragged rows."""
    return tables.mend_csv(ragged_rows(spark, d))


NT_SQL = GRAPH + " SELECT s, p, o, o_kind FROM g"


@query(NT_SQL)
def ntriples_read(spark, d):
    """The graph written as N-Triples and read again by lines."""
    lines = export.ntriples(graph(spark, d))
    return triples.parse_ntriples(lines).select("s", "p", "o", "o_kind")


@query(NT_SQL + f" WHERE contains(s, '/nation/') OR contains(s, '/region/')")
def turtle_read(spark, d):
    """A part of the graph written as Turtle, with a prefix, and read again as one file."""
    small = graph(spark, d).where(F.col("s").contains("/nation/") | F.col("s").contains("/region/"))
    text = export.turtle(small).agg(F.concat(F.lit(f"@prefix o: <{ONTO}> .\n"), F.replace(F.array_join(F.array_sort(F.collect_list("value")), "\n"), F.lit(f"<{ONTO}region>"), F.lit("o:region"))).alias("value"))
    return triples.parse_turtle(text.select(F.lit("part").alias("file"), "value")).select("s", "p", "o", "o_kind")


@query(NT_SQL)
def turtle_split_read(spark, d):
    """The whole graph written as Turtle and read again in splits."""
    path = folder(spark)
    export.turtle(graph(spark, d)).write.mode("overwrite").text(path)
    return turtle_split.read_turtle_split(spark, path).select("s", "p", "o", "o_kind")


@query("""SELECT 'r' || n_regionkey AS table_id, count(*) AS rows, true AS ok, NULL::VARCHAR AS reason FROM nation GROUP BY n_regionkey
 UNION ALL SELECT 'empty', 0, false, 'no rows' UNION ALL SELECT 'latin', 1, true, 'not UTF-8' UNION ALL SELECT 'ragged', 2, true, '1 rows of another width'""")
def directory_report(spark, d):
    """Tables at hand as CSV files, converted, with the files that don't parse, or not quite, and why."""
    n = read(spark, d, "nation").groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("table_id")).agg(F.concat(F.lit("name,key\n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "n_name", "n_nationkey"))), "\n")).alias("text"))
    files = n.select("table_id", F.encode("text", "UTF-8").alias("content"))
    odd = spark.createDataFrame([("empty", b""), ("latin", "name,key\ncaf\xe9,1".encode("latin-1")), ("ragged", b"name,key\na,1\nb")], "table_id string, content binary")
    return tables.conversion_report(files.unionByName(odd), folder(spark))


@query("SELECT * FROM (VALUES ('st.', 'street'), ('ca', 'circa')) t(key, expansion)")
def abbreviation_lines(spark, d):
    lines = spark.createDataFrame([("st.*street",), ("nothing",), ("ca*circa",)], "value string")
    return lexicons.abbreviations(lines)


@query("SELECT * FROM (VALUES ('length', 'inch', 'in|inches', 0.0254::DOUBLE, 0.0::DOUBLE), ('length', 'metre', 'm', 1.0, 0.0), ('temperature', 'celsius', 'C', 1.0, 273.15)) t(quantity, unit, abbrs, mul, add)")
def unit_lines(spark, d):
    lines = spark.createDataFrame([('"length"|"inch"|"in, inches"|"0.0254"',), ('"length"|"metre"|"m"',), ('"temperature"|"celsius"|"C"|"1.0"|"273.15"',), ("bad",)], "value string")
    return lexicons.units(lines).withColumn("abbrs", F.array_join("abbrs", "|"))


# ---- catalogue and views ---------------------------------------------------------------------------------------------


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 2 AS BIGINT) AS row_idx, line FROM (SELECT -1 AS n_nationkey, '\"n_name\",\"n_regionkey\"' AS line UNION ALL SELECT n_nationkey, '\"' || n_name || '\",\"' || n_regionkey || '\"' FROM nation)")
def raw_download(spark, d):
    return catalog.raw_download(cells(spark, d, ["nation"]), "nation")


@query("SELECT p_partkey AS row_idx, lower(p_name) || '::' || p_name AS cell FROM part WHERE lower(p_name) <> p_name UNION ALL SELECT p_partkey, lower(p_name) || '::' FROM part WHERE lower(p_name) = p_name")
def preparation_view(spark, d):
    from ..operators import prepare

    view = catalog.preparation_view(prepare.prepare(cells(spark, d, ["part"]).where("col_idx = 0")))
    return view.select("row_idx", F.concat_ws(":", F.col("cells")[0].value, F.col("cells")[0].cell_type, F.coalesce(F.col("cells")[0].comment, F.lit(""))).alias("cell"))


@query(METRIC_SQL + " SELECT table_id, string_agg(header || ':' || col_class, ',' ORDER BY col_idx) AS columns FROM z GROUP BY table_id")
def analysis_view(spark, d):
    view = catalog.analysis_view(classified(spark, d))
    shown = F.transform(F.array_sort(F.map_entries("columns")), lambda e: F.concat_ws(":", e.value.header, e.value.col_class))
    return view.select("table_id", F.array_join(shown, ",").alias("columns"))


@query(METRIC_SQL + " SELECT table_id, col_idx, header, col_class FROM z")
def annotation_view(spark, d):
    return catalog.annotation_view(classified(spark, d))


@query("SELECT user_id AS table_id, event_id AS ord, CASE WHEN user_id = 7 AND event_id >= 500 THEN 'TODO' WHEN event_type = 'click' THEN 'DONE' ELSE 'TODO' END AS status FROM events")
def phase_reset(spark, d):
    from pyspark.sql import Window

    e, user = read(spark, d, "events"), Window.partitionBy("user_id")
    # the phase to go back to is the first of user 7 from number 500 on
    name = F.when((F.col("user_id") == 7) & (F.col("event_id") == F.min(F.when((F.col("user_id") == 7) & (F.col("event_id") >= 500), F.col("event_id"))).over(user)), "from here").otherwise(F.col("event_type"))
    rows = e.where("user_id = 7").select(F.col("user_id").alias("table_id"), name.alias("name"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "click", "DONE").otherwise("TODO").alias("status"))
    rest = e.where("user_id <> 7").select(F.col("user_id").alias("table_id"), F.col("event_type").alias("name"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "click", "DONE").otherwise("TODO").alias("status"))
    return catalog.reset(rows.unionByName(rest), 7, "from here").select("table_id", "ord", "status")


@query("SELECT 'orders' AS table_id, CAST(0 AS INTEGER) AS col_idx, string_agg(o_orderstatus || '=' || n, ',' ORDER BY n DESC, o_orderstatus DESC) AS concepts FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)")
def concept_view(spark, d):
    freq = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("class")).agg(F.count(F.lit(1)).alias("freq"))
    view = catalog.concept_view(freq.select(F.lit("orders").alias("table_id"), F.lit(0).alias("col_idx"), "class", "freq"))
    return view.select("table_id", "col_idx", F.array_join(F.transform("concepts", lambda c: F.concat_ws("=", c["class"], c.freq)), ",").alias("concepts"))


@query("SELECT 'orders' AS table_id, CAST(0 AS INTEGER) AS col_idx, string_agg(o_orderstatus || '=' || n, ',' ORDER BY n DESC, o_orderstatus DESC) AS concepts FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)")
def winning_concepts(spark, d):
    freq = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("class")).agg(F.count(F.lit(1)).alias("freq"))
    won = concepts.winning_concepts(freq.select(F.lit("orders").alias("table_id"), F.lit(0).alias("col_idx"), "class", "freq"))
    return won.select("table_id", "col_idx", F.array_join(F.transform(F.map_entries("winning_concepts"), lambda e: F.concat_ws("=", e.key, e.value)), ",").alias("concepts"))


@query("SELECT 'a' AS name")
def endpoint_choice(spark, d):
    rows = spark.createDataFrame([("b", 2, False), ("a", 1, False), ("c", 0, True)], "name string, priority int, error boolean")
    return catalog.first_healthy(rows).select("name")


@query("SELECT p_brand AS table_id, CAST(0 AS INTEGER) AS col_idx, count(*) FILTER (WHERE p_size < 20) / count(*) < 0.5 AS unsure FROM part GROUP BY p_brand")
def no_annotation_share(spark, d):
    rows = read(spark, d, "part").select(F.col("p_brand").alias("table_id"), F.lit(0).alias("col_idx"), (F.col("p_size") / 50).alias("edit"))
    return concepts.no_annotation_share(rows)


@query("SELECT 'orders' AS table_id, array_to_string(list_sort(list_concat(['o', 'orderkey'], ['custkey', 'o'])), ' ') AS context")
def header_context(spark, d):
    heads = spark.createDataFrame([("orders", "O-OrderKey"), ("orders", "CustKey O")], "table_id string, header string")
    return linking.header_context(heads).withColumn("context", F.array_join("context", " "))


@query("SELECT c_custkey AS row_idx FROM customer WHERE c_custkey % 3 <> 0")
def resume_cells(spark, d):
    c = read(spark, d, "customer").select(F.lit("t").alias("table_id"), F.col("c_custkey").alias("row_idx"), F.lit(0).alias("col_idx"))
    return linking.unlinked(c, c.where("row_idx % 3 = 0")).select("row_idx")


@query("SELECT o_orderstatus AS table_id, CAST(o_custkey % 2 AS INTEGER) AS col_idx, array_to_string(list_sort(list(o_orderkey)), ',') AS rows FROM orders GROUP BY ALL")
def cea_targets(spark, d):
    t = read(spark, d, "orders").select(F.col("o_orderstatus").alias("table_id"), (F.col("o_custkey") % 2).cast("int").alias("col_idx"), F.col("o_orderkey").alias("row_idx"))
    return tables.group_targets(t, "cea").withColumn("rows", F.array_join("rows", ","))


@query(f"SELECT 'customer' AS \"table\", CAST(1 AS INTEGER) AS col, c_custkey AS row, '{KG}nation/' || c_nationkey AS entity FROM customer")
def cea_export_targeted(spark, d):
    rows = read(spark, d, "customer").select(F.lit("customer").alias("table_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("col_idx"), F.col("c_custkey").alias("row_idx"), F.concat(F.lit(f"{KG}nation/"), F.col("c_nationkey").cast("string")).alias("entity"))
    return export.targeted_entity_rows(rows, spark.createDataFrame([("customer", 1)], "table_id string, col_idx int"))


@query(f"SELECT 't' AS \"table\", CAST(1 AS INTEGER) AS col, '{ONTO}nation' AS rel")
def cpa_export_targeted(spark, d):
    rows = spark.createDataFrame([("t", 1, ONTO + "nation"), ("t", 2, ONTO + "a/b"), ("t", 3, ONTO + "x")], "table_id string, col_idx int, p string")
    return export.targeted_predicate_rows(rows, spark.createDataFrame([("t", 1), ("t", 2)], "table_id string, col_idx int"))


@query(f"""WITH r AS (SELECT '<{KG}nation/' || n_nationkey || '>' AS s, * FROM nation) SELECT s || ' <{TYPE}> <{ONTO}Nation> .' AS value FROM r UNION ALL SELECT s || ' <{ONTO}region> <{KG}region/' || n_regionkey || '> .' FROM r
 UNION ALL SELECT s || ' <{export.BASE}columnId> "0"^^<http://www.w3.org/2001/XMLSchema#integer> .' FROM r UNION ALL SELECT s || ' <{export.BASE}rowId> "' || n_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#integer> .' FROM r""")
def rdf_objects_and_classes(spark, d):
    """Linked objects and the row's class, beside column and row."""
    n = read(spark, d, "nation")
    key = F.col("n_nationkey").cast("long").alias("row_idx")
    u = lambda kind, c: F.concat(F.lit(f"{KG}{kind}/"), F.col(c).cast("string")).alias("entity")
    links = n.select(F.lit("nation").alias("table_id"), key, F.lit(0).alias("col_idx"), u("nation", "n_nationkey")).unionByName(n.select(F.lit("nation").alias("table_id"), key, F.lit(1).alias("col_idx"), u("region", "n_regionkey")))
    cols = spark.createDataFrame([("nation", 1, "NE", ONTO + "region")], "table_id string, col_idx int, col_class string, rel string")
    subj = spark.createDataFrame([("nation", 0)], "table_id string, subject_col int")
    c = cells(spark, d, ["nation"]).withColumnRenamed("value_raw", "value")
    return export.ntriples(export.rdf_triples(c, cols, links, subj, spark.createDataFrame([("nation", "Nation")], "table_id string, class string")))


@query("SELECT 'run' AS task_id, 'sparql|Error: timeout\nQuery:\nSELECT ' || n_name || '|nation' AS entry FROM nation WHERE n_regionkey = 1")
def log_entries(spark, d):
    rows = read(spark, d, "nation").where("n_regionkey = 1").select(export.query_log(F.concat(F.lit("SELECT "), "n_name"), F.lit("timeout"), F.lit("nation"), "run").alias("log"))
    return rows.select(F.col("log.task_id").alias("task_id"), F.concat_ws("|", "log.type", "log.body", "log.table_id").alias("entry"))


@query("SELECT 'part' AS table_id, CAST(0 AS INTEGER) AS col_idx, p_brand AS p, CAST(count(DISTINCT p_size) AS DOUBLE) AS score FROM part GROUP BY p_brand ORDER BY score DESC, p LIMIT 1")
def predicate_by_sum(spark, d):
    from ..operators import relations

    rows = read(spark, d, "part").select(F.lit("part").alias("table_id"), F.lit(0).alias("col_idx"), F.col("p_brand").alias("p"), F.col("p_size").cast("string").alias("value"))
    return relations.winning_by_sum(rows, rows.select("value").distinct().withColumn("score", F.lit(1.0)))


@query("SELECT doc_id, CAST(list_sum(list_transform(string_split_regex(trim(text), '\\s+'), lambda w: 1)) AS BIGINT) AS n FROM documents WHERE trim(text) <> ''")
def bag_sizes(spark, d):
    """The bag of whitespace words of whole texts: its counts add up to the words."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    return read(spark, d, "documents").where("trim(text) <> ''").select("doc_id", F.aggregate(F.map_values(X.bag(words)), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))

