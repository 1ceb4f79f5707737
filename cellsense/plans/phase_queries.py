"""Queries over the phases of annotation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicon import STOPWORDS
from ..operators import catalog, concepts, relations
from ..sources import triples
from ..sources.stage import folder, staged
from ..sources.store import LabelIndex, TripleStore
from ..sources.versions import Versions
from . import phases
from .queries import LABEL, ONTO, ORACLES, REDIRECT, TYPE, graph, query, read, spread

DBR = "http://dbpedia.org/resource/"
_STOPS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS) + "]"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '\\w+'), lambda w: length(w) > 1))"


def _singular(w: str) -> str:
    return (
        f"CASE {w} WHEN 'men' THEN 'man' WHEN 'people' THEN 'person' WHEN 'children' THEN 'child' WHEN 'feet' THEN 'foot' WHEN 'teeth' THEN 'tooth' WHEN 'mice' THEN 'mouse' ELSE CASE WHEN regexp_matches({w}, '[^aeiou]ies$') THEN {w}[:-4] || 'y'"
        f" WHEN regexp_matches({w}, '(s|x|z|ch|sh)es$') THEN {w}[:-3] WHEN regexp_matches({w}, '[^su]s$') THEN {w}[:-2] ELSE {w} END END"
    )


def _plural(w: str) -> str:
    return f"CASE WHEN regexp_matches({w}, '[^aeiou]y$') THEN {w}[:-2] || 'ies' WHEN regexp_matches({w}, '(s|x|z|ch|sh)$') THEN {w} || 'es' ELSE {w} || 's' END"


# ---- disambiguation --------------------------------------------------------------------------------------------------
#
# Customers as makers with a segment and a nation. Every maker has an entity that tells of its goods and its nation; every third has a works of
# the same label and other words; every eleventh a namesake with the same words (a tie); every fifth a page that redirects to a firm (an alias).


def _makers(spark, d):
    c, k, n = read(spark, d, "customer"), F.col("c_custkey") + 100, F.col("c_nationkey") + 100
    value = [("company", F.concat(F.lit("maker "), k.cast("string"))), ("segment", F.lower("c_mktsegment")), ("country", F.concat(F.lit("nation "), n.cast("string")))]
    cells = F.array(*[F.struct(F.lit(i).alias("col_idx"), F.lit(h).alias("header"), v.alias("value"), v.alias("value_original")) for i, (h, v) in enumerate(value)])
    return c.select(F.lit("makers").alias("table_id"), F.col("c_custkey").alias("row_idx"), F.inline(cells))


def _maker_graph(spark, d):
    c = read(spark, d, "customer")
    k, n = (F.col("c_custkey") + 100).cast("string"), (F.col("c_nationkey") + 100).cast("string")
    at = lambda head, x, tail="": F.concat(F.lit(DBR + head), x, F.lit(tail))
    name, goods = F.concat(F.lit("maker "), k), F.concat(F.lit("One of the companies that make "), F.lower("c_mktsegment"), F.lit(" goods in nation "), n)
    own = [triples.triples_of(of, at(head, k), {ONTO + "country": at("Nation_", n)}, {LABEL: name, ONTO + "abstract": goods}, "en") for of, head in ((c, "Maker_"), (c.where("c_custkey % 11 = 0"), "maker_"))]
    works = triples.triples_of(c.where("c_custkey % 3 = 0"), at("Maker_", k, "_works"), {}, {LABEL: name, ONTO + "abstract": F.lit("a company in countries far away")}, "en")
    page = triples.triples_of(c.where("c_custkey % 5 = 0"), at("Alias_", k), {REDIRECT: at("Firm_", k)}, {LABEL: name}, "en")
    firm = triples.triples_of(c.where("c_custkey % 5 = 0"), at("Firm_", k), {}, {ONTO + "abstract": F.concat(F.lit("machinery of nation "), n)}, "en")
    lands = read(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("string").alias("n"))
    nation = triples.triples_of(lands, at("Nation_", F.col("n")), {}, {LABEL: F.concat(F.lit("nation "), F.col("n"))}, "en")
    return own[0].unionByName(own[1]).unionByName(works).unionByName(page).unionByName(firm).unionByName(nation)


_MAKERS = f"""c AS (SELECT c_custkey AS row, c_custkey + 100 AS k, c_nationkey + 100 AS n, lower(c_mktsegment) AS seg FROM customer),
 cells AS (SELECT row, CAST(unnest([0, 1, 2]) AS INTEGER) AS col, unnest(['maker ' || k, seg, 'nation ' || n]) AS value FROM c),
 heads AS (SELECT {_words("'company segment country'")} AS head),
 own AS (SELECT *, unnest(CASE WHEN row % 11 = 0 THEN ['Maker_', 'maker_'] ELSE ['Maker_'] END) AS head FROM c),
 t AS (SELECT '{DBR}' || head || k AS s, '{ONTO}country' AS p, '{DBR}Nation_' || n AS o, 'uri' AS kind FROM own UNION ALL SELECT '{DBR}' || head || k, '{LABEL}', 'maker ' || k, 'literal' FROM own
  UNION ALL SELECT '{DBR}' || head || k, '{ONTO}abstract', 'One of the companies that make ' || seg || ' goods in nation ' || n, 'literal' FROM own
  UNION ALL SELECT '{DBR}Maker_' || k || '_works', unnest(['{LABEL}', '{ONTO}abstract']), unnest(['maker ' || k, 'a company in countries far away']), 'literal' FROM c WHERE row % 3 = 0
  UNION ALL SELECT '{DBR}Alias_' || k, unnest(['{LABEL}', '{REDIRECT}']), unnest(['maker ' || k, '{DBR}Firm_' || k]), unnest(['literal', 'uri']) FROM c WHERE row % 5 = 0
  UNION ALL SELECT '{DBR}Firm_' || k, '{ONTO}abstract', 'machinery of nation ' || n, 'literal' FROM c WHERE row % 5 = 0
  UNION ALL SELECT '{DBR}Nation_' || (n_nationkey + 100), '{LABEL}', 'nation ' || (n_nationkey + 100), 'literal' FROM nation)"""


def _name(uri: str) -> str:
    return f"lower(translate(substr({uri}, 29), '_', ' '))"


_DISAMBIGUATED = f"""WITH {_MAKERS}, hit AS (SELECT q.value, t.s FROM (SELECT DISTINCT value FROM cells WHERE col <> 1) q JOIN t ON t.p = '{LABEL}' AND t.o = q.value),
 found AS (SELECT value, s AS entity, NULL AS alias FROM hit UNION SELECT hit.value, r.o, hit.s FROM hit JOIN t r ON r.s = hit.s AND r.p = '{REDIRECT}'),
 text AS (SELECT s AS entity, CASE WHEN kind = 'uri' THEN {_name("o")} ELSE lower(o) END AS x FROM t UNION ALL SELECT o, {_name("s")} FROM t WHERE kind = 'uri'),
 said AS (SELECT entity, list_distinct(flatten(list(list_filter(regexp_extract_all(x, '[a-z]+'), lambda w: length(w) > 1)))) AS ws FROM text WHERE entity IN (SELECT entity FROM found) GROUP BY entity),
 rw AS (SELECT a.row, a.col, list_filter(list_distinct(flatten(list({_words("b.value")}))), lambda w: NOT list_contains({_STOPS}, w)) AS told FROM cells a JOIN cells b ON a.row = b.row AND a.col <> b.col GROUP BY a.row, a.col),
 sc AS (SELECT cells.row, cells.col, value, entity, alias, {_words("value")} AS cw, {_words(_name("entity"))} AS nw, coalesce(ws, []) AS ws, {_name("entity")} AS name, {_name("alias")} AS other,
  list_transform(coalesce(ws, []), lambda w: {_singular("w")}) AS sg, list_filter(head, lambda w: NOT list_contains({_STOPS}, w)) AS head, told FROM cells JOIN found USING (value) LEFT JOIN said USING (entity) JOIN rw ON rw.row = cells.row AND rw.col = cells.col, heads WHERE cells.col <> 1),
 z AS (SELECT *, levenshtein(value, name) / greatest(length(value), length(name), 1) AS e1, levenshtein(value, other) / greatest(length(value), length(other), 1) AS e2,
  CAST(len(list_filter(sg, lambda w: list_contains(head, w) OR list_contains(head, {_plural("w")}))) + len(list_filter(sg, lambda w: list_contains(told, w) OR list_contains(told, {_plural("w")}))) AS INTEGER) AS row_score,
  CAST(len(list_intersect(cw, nw)) + len(list_intersect(cw, ws)) AS INTEGER) AS cell_score FROM sc),
 y AS (SELECT *, least(e1, coalesce(e2, e1)) AS edit, row_score / greatest(max(row_score) OVER w, 1) + cell_score / greatest(max(cell_score) OVER w, 1) - 2 * least(e1, coalesce(e2, e1)) AS final FROM z WINDOW w AS (PARTITION BY row, col))
 SELECT row AS row_idx, col AS col_idx, value, entity, alias, round(edit, 9) AS edit, row_score, cell_score, round(final, 9) AS final, row_number() OVER (PARTITION BY row, col ORDER BY round(final, 12) DESC, entity, alias NULLS FIRST) = 1 AS winning FROM y"""


@query(_DISAMBIGUATED)
def disambiguated_cells(spark, d):
    """Every candidate of two entity columns, scored by the words of row, header, name and graph, with ties and aliases."""
    cells, columns = _makers(spark, d), spark.createDataFrame([("makers", 0), ("makers", 2)], "table_id string, col_idx int")
    got = phases.disambiguation_phase(cells, columns, _maker_graph(spark, d), LABEL, REDIRECT, TYPE, ONTO + "Person")
    return got.select("row_idx", "col_idx", "value", "entity", "alias", F.round("edit", 9).alias("edit"), "row_score", "cell_score", F.round("final", 9).alias("final"), "winning")


@query(f"SELECT row_idx, col_idx, value, entity, CAST(0 AS BIGINT) AS looked_up FROM ({_DISAMBIGUATED}) WHERE winning")
def linked_cells(spark, d):
    """Two runs of linking over one memo: the second finds every value in it and looks up none."""
    cells, g = _makers(spark, d), staged(_maker_graph(spark, d))
    columns = spark.createDataFrame([("makers", 0, None), ("makers", 2, None)], "table_id string, col_idx int, type string")
    memo = Versions(spark, folder(spark))
    phases.linking_phase(cells, columns, g, LABEL, REDIRECT, TYPE, ONTO + "Person", memo)
    linked, n = phases.linking_phase(cells, columns, g, LABEL, REDIRECT, TYPE, ONTO + "Person", memo)
    return linked.select("row_idx", "col_idx", "value", "entity", F.lit(n).cast("long").alias("looked_up"))


# ---- what is kept on disk --------------------------------------------------------------------------------------------


@query(ORACLES["triple_patterns"])
def stored_patterns(spark, d):
    """Two hops over triples kept by subject: only what comes to them is shuffled."""
    store = TripleStore.write(graph(spark, d), folder(spark))
    hop = lambda p, s, o: store.by_subject.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))
    return hop(LABEL, "s", "label").join(hop(ONTO + "nation", "s", "n"), "s").join(hop(ONTO + "region", "n", "region"), "n").select("s", "label", "region")


@query("""WITH l AS (SELECT 'part/' || p_partkey AS s, p_name || ' ' || p_type AS label FROM part), w AS (SELECT s, label, list_distinct(list_filter(regexp_extract_all(lower(label), '[0-9A-Za-z_]+'), lambda x: length(x) > 1)) AS w FROM l),
 q AS (SELECT DISTINCT lower(p_type) AS q FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT p_name || ' ' || lower(p_type) FROM part),
 z AS (SELECT q, s, label FROM (SELECT q, list_distinct(list_filter(regexp_extract_all(q, '[0-9A-Za-z_]+'), lambda x: length(x) > 1)) AS a FROM q) JOIN w ON list_has_all(w, a))
 SELECT * FROM z QUALIFY dense_rank() OVER (PARTITION BY q ORDER BY length(s), s) <= 50""")
def label_index_top50(spark, d):
    """The first 50 labels of one-word and longer queries, from an index written in blocks."""
    p = spread(spark, d, "part")
    index = LabelIndex.write(p.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("s"), F.concat_ws(" ", "p_name", "p_type").alias("label")), folder(spark), block=64)
    queries = p.select(F.lower("p_type").alias("q")).union(p.select("p_name")).union(p.select(F.concat_ws(" ", "p_name", F.lower("p_type")))).distinct()
    return index.match(queries, k=50, block=64)


@query("""SELECT q, p_partkey AS table_id, p_name AS name FROM part JOIN (SELECT DISTINCT substr(p_name, 3, 4) AS q FROM part UNION SELECT DISTINCT upper(substr(p_name, 1, 2)) FROM part) ON contains(lower(p_name), lower(q)) WHERE q <> ''""")
def catalogue_name_search(spark, d):
    """Names that hold a text anywhere, in any case, by their runs of three characters."""
    p = read(spark, d, "part")
    tables = p.select(F.col("p_partkey").alias("table_id"), F.col("p_name").alias("name"))
    queries = p.select(F.substring("p_name", 3, 4).alias("q")).union(p.select(F.upper(F.substring("p_name", 1, 2)))).distinct()
    return catalog.search_names(tables, staged(catalog.name_index(tables)), queries)


@query("""WITH o AS (SELECT o_orderkey AS table_id, o_orderdate AS pub_date FROM orders), m AS (SELECT max(pub_date) AS d FROM o WHERE pub_date < TIMESTAMP '1996-01-01'), a AS (SELECT d, max(table_id) AS k FROM o, m WHERE pub_date = d GROUP BY d)
 SELECT table_id, pub_date FROM o, a WHERE (pub_date, table_id) > (d, k) ORDER BY pub_date, table_id LIMIT 25""")
def catalogue_page(spark, d):
    """The page behind a row that was shown last, read from a catalogue written in page order."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("table_id"), F.col("o_orderdate").alias("pub_date"))
    kept = staged(catalog.in_page_order(o, 8))
    last = kept.where("pub_date < '1996-01-01'").agg(F.max(F.struct("pub_date", "table_id")).alias("x")).select("x.*").first()
    return catalog.page_after(kept, tuple(last) if last.pub_date is not None else None)


@query("SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS name FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT s_suppkey + 1000, s_name FROM supplier")
def catalogue_update(spark, d):
    """A catalogue after changes, additions and removals, each a version that readers see whole."""
    n, s = read(spark, d, "nation"), read(spark, d, "supplier")
    v = Versions(spark, folder(spark))
    v.publish(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
    v.update(s.select((F.col("s_suppkey") + 1000).alias("k"), F.col("s_name").alias("name")), ["k"])
    v.update(n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"), F.concat(F.upper("n_name"), F.lit("!")).alias("name")), ["k"], removed=n.where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))
    return v.latest()


# ---- concepts --------------------------------------------------------------------------------------------------------
#
# Makers and their nations with types below two roots; the second column's header names a class, and labels look up classes.

EDGES = [("Agent", "Person"), ("Agent", "Organisation"), ("Organisation", "Company"), ("Company", "Brewery"), ("Place", "PopulatedPlace"), ("PopulatedPlace", "Country"), ("PopulatedPlace", "City"), ("Place", "Brewery")]
ROOTS = [("Agent", 0), ("Place", 1)]


def _typed(spark, d):
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    k = (F.col("c_custkey") + 100).cast("string")
    maker, land = F.concat(F.lit(DBR + "Maker_"), k), F.concat(F.lit(DBR + "Nation_"), (F.col("n_nationkey") + 100).cast("string"))
    is_a = lambda of, s, *kinds: [triples.triples_of(of, s, {TYPE: F.lit(ONTO + x)}) for x in kinds]
    parts = [*is_a(c, maker, "Agent", "Organisation"), *is_a(c.where("c_custkey % 3 = 0"), maker, "Company"), *is_a(c.where("c_custkey % 4 = 0"), maker, "Brewery", "Oddity"), *is_a(n, land, "Place", "Country"), *is_a(n.where("n_nationkey % 2 = 0"), land, "City")]
    parts += [triples.triples_of(c, maker, {}, {LABEL: F.concat(F.lit("maker "), k)}), triples.triples_of(n, land, {}, {LABEL: F.concat(F.lit("nation "), (F.col("n_nationkey") + 100).cast("string"))})]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _sql_edges() -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in EDGES)


@query(f"""WITH RECURSIVE e(parent, child) AS (VALUES {_sql_edges()}), o(root, rank) AS (VALUES ('Agent', 0), ('Place', 1)),
 p(root, class, path, n) AS (SELECT root, root, [root], 1 FROM o UNION ALL SELECT p.root, e.child, list_append(p.path, e.child), p.n + 1 FROM p JOIN e ON p.class = e.parent),
 sp AS (SELECT root, class, path FROM p QUALIFY row_number() OVER (PARTITION BY root, class ORDER BY n, path) = 1),
 c AS (SELECT c_custkey AS row, c_custkey + 100 AS k, c_nationkey + 100 AS n FROM customer),
 kinds AS (SELECT 'Maker_' || k AS s, unnest(['Agent', 'Organisation'] || CASE WHEN row % 3 = 0 THEN ['Company'] ELSE [] END || CASE WHEN row % 4 = 0 THEN ['Brewery', 'Oddity'] ELSE [] END) AS class FROM c
  UNION ALL SELECT 'Nation_' || (n_nationkey + 100), unnest(['Place', 'Country'] || CASE WHEN n_nationkey % 2 = 0 THEN ['City'] ELSE [] END) FROM nation),
 cells AS (SELECT row, CAST(unnest([0, 1]) AS INTEGER) AS col, unnest(['maker ' || k, 'nation ' || n]) AS value, unnest(['Maker_' || k, 'Nation_' || n]) AS s FROM c),
 f AS (SELECT col, class, count(*) AS freq, count(DISTINCT s) AS entities FROM cells JOIN kinds USING (s) WHERE class IN (SELECT parent FROM e UNION SELECT child FROM e) GROUP BY ALL),
 lb AS (SELECT DISTINCT s, lower(replace(s, '_', ' ')) AS label FROM kinds), pre AS (SELECT q.col, q.value, lb.s, lb.label FROM (SELECT DISTINCT col, value FROM cells) q JOIN lb ON starts_with(lb.label, q.value) QUALIFY row_number() OVER (PARTITION BY q.value ORDER BY length(lb.label), lb.label, lb.s) <= 5),
 look AS (SELECT DISTINCT col, class FROM pre JOIN kinds USING (s) WHERE levenshtein(value, label) / greatest(length(value), length(label)) < 0.2),
 b AS (SELECT f.col, f.class, freq + CASE WHEN look.class IS NOT NULL THEN floor(w * 0.3) ELSE 0 END + CASE WHEN (f.col, f.class) IN ((1, 'Country'), (0, 'Company')) THEN w ELSE 0 END AS freq, CASE WHEN (f.col, f.class) IN ((1, 'Country'), (0, 'Company')) THEN w ELSE entities END AS entities
  FROM f LEFT JOIN look ON look.col = f.col AND look.class = f.class, (SELECT least(count(*), 30) AS w FROM customer)),
 s AS (SELECT * FROM b QUALIFY freq / max(freq) OVER (PARTITION BY col) > 0.3),
 own AS (SELECT class, root, path, rank FROM sp JOIN o USING (root) QUALIFY row_number() OVER (PARTITION BY class ORDER BY rank) = 1), known AS (SELECT * FROM s JOIN own USING (class)),
 br AS (SELECT col, root FROM known GROUP BY col, root, rank QUALIFY row_number() OVER (PARTITION BY col ORDER BY sum(entities) DESC, rank) = 1),
 st AS (SELECT known.col, path, unnest(path) AS step FROM known JOIN br ON br.col = known.col AND br.root = known.root), ps AS (SELECT st.col, st.path, sum(coalesce(s.entities, 1)) AS n FROM st LEFT JOIN s ON s.col = st.col AND s.class = st.step GROUP BY ALL),
 best AS (SELECT col, list_filter(path, lambda x: x NOT IN ('Agent', 'Thing')) AS path FROM ps QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, len(path) DESC, array_to_string(path, '/') DESC) = 1),
 near AS (SELECT col, 2 * count(*) FILTER (WHERE edit < 0.4) < count(*) AS unsure FROM (SELECT 0 AS col, CASE WHEN row % 5 < 3 THEN 0.6 ELSE 0.1 END AS edit FROM c UNION ALL SELECT 1, 0.0 FROM (SELECT DISTINCT n FROM c)) GROUP BY col)
 SELECT best.col AS col_idx, best.path[-1] AS class, array_to_string(best.path, '/') AS path, CAST(s.freq AS BIGINT) AS freq, unsure FROM best JOIN s ON s.col = best.col AND s.class = best.path[-1] JOIN near ON near.col = best.col""")
def column_concepts(spark, d):
    """Class and path of two entity columns, with classes of lookups and headers, a class below two roots, and unsure columns."""
    c = read(spark, d, "customer")
    k, n = (F.col("c_custkey") + 100).cast("string"), (F.col("c_nationkey") + 100).cast("string")
    both = [("company name", "maker ", "Maker_", k, F.when(F.col("c_custkey") % 5 < 3, 0.6).otherwise(0.1)), ("country", "nation ", "Nation_", n, F.lit(0.0))]
    rows = F.array(*[F.struct(F.lit(i).alias("col_idx"), F.lit(h).alias("header"), F.concat(F.lit(v), x).alias("value"), F.concat(F.lit(DBR + e), x).alias("entity"), far.alias("edit")) for i, (h, v, e, x, far) in enumerate(both)])
    cells = c.select(F.lit("makers").alias("table_id"), F.col("c_custkey").alias("row_idx"), F.inline(rows))
    edges, order = spark.createDataFrame(EDGES, "parent string, child string"), spark.createDataFrame(ROOTS, "root string, rank int")
    got = phases.concept_phase(cells, cells, _typed(spark, d), LABEL, TYPE, edges, order, ONTO)
    return got.select("col_idx", "class", F.array_join("path", "/").alias("path"), F.col("freq").cast("long").alias("freq"), "unsure")


# ---- predicates ------------------------------------------------------------------------------------------------------
#
# Five columns over customers: balances, days, persons, descriptions, segments; each is compared with values of three predicates, among them
# numbers below one and below zero, days, and texts of other kinds.

_COLUMNS = {
    0: ("CAST(c_acctbal AS STRING)", "CAST(c_acctbal AS VARCHAR)"),
    1: ("trim(LEADING '+' FROM CAST(date_add(DATE'1990-01-01', CAST(c_custkey * 13 AS INT)) AS STRING))", "CAST(DATE '1990-01-01' + CAST(c_custkey * 13 AS INTEGER) AS VARCHAR)"),
    2: ("concat('J. Maker', c_custkey % 60)", "'J. Maker' || (c_custkey % 60)"),
    3: ("concat(repeat('goods for every house and garden ', 3), c_mktsegment)", "repeat('goods for every house and garden ', 3) || c_mktsegment"),
    4: ("c_mktsegment", "c_mktsegment"),
}
_SMALL = "c_custkey % 40 = 0"


def _values_sql(spark_side: bool) -> str:
    text = "STRING" if spark_side else "VARCHAR"
    join = (lambda *x: f"concat({', '.join(x)})") if spark_side else (lambda *x: " || ".join(x))
    c = {k: v[0 if spark_side else 1] for k, v in _COLUMNS.items()}
    rows = [
        (0, "p1", c[0]), (0, "p2", f"CAST(round(c_acctbal / 20000, 3) AS {text})"), (0, "p3", f"CAST(c_custkey AS {text})"), (0, "p4", "'many'"),
        (1, "p1", c[1]), (1, "p2", "'0312-05-07'"), (1, "p3", "'12'"), (2, "p1", join("'Jane Maker'", "c_custkey % 50")), (2, "p2", join("'Somebody '", "c_custkey")),
        (3, "p1", join("'every house and garden '", "''")), (3, "p2", c[3]), (4, "p1", "lower(c_mktsegment)"), (4, "p2", f"CAST(c_acctbal AS {text})"), (4, "p3", "'x'"),
    ]
    return " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS col_idx, '{p}' AS p, {v} AS value FROM customer WHERE {_SMALL}" for i, p, v in rows)


_X = "CASE WHEN kind = 'n' THEN CAST(value AS DOUBLE) WHEN kind = 'd' THEN CAST(datediff('day', DATE '0001-01-01', CAST(value AS DATE)) + 1 AS DOUBLE) END"
_KIND = "CASE WHEN regexp_full_match(value, '-?[0-9]+(\\.[0-9]+)?') THEN 'n' WHEN regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'd' ELSE 't' END"


@query(f"""WITH cells AS ({' UNION ALL '.join(f"SELECT CAST({i} AS INTEGER) AS col_idx, {v[1]} AS value FROM customer" for i, v in _COLUMNS.items())}), v0 AS ({_values_sql(False)}),
 c AS (SELECT *, {_KIND} AS kind FROM cells), v AS (SELECT *, {_KIND} AS kind, count(*) OVER (PARTITION BY col_idx, p) AS freq FROM v0),
 cx AS (SELECT *, CASE WHEN kind <> 't' THEN {_X} END AS x FROM c), vx AS (SELECT DISTINCT *, CASE WHEN kind <> 't' THEN {_X} END AS x FROM v),
 s AS (SELECT cx.col_idx, p, vx.value, freq, avg(CASE WHEN cx.kind <> 't' THEN 1 - abs(cx.x - vx.x) / greatest(abs(cx.x), abs(vx.x), 1)
  WHEN length(cx.value) > 80 THEN CASE WHEN contains(lower(cx.value), lower(vx.value)) OR contains(lower(vx.value), lower(cx.value)) THEN least(length(cx.value), length(vx.value)) / greatest(length(cx.value), length(vx.value)) ELSE 0 END
  WHEN regexp_matches(cx.value, '^[A-Za-z]\\.\\s*\\w') THEN 1 - levenshtein(lower(cx.value), o) / greatest(length(cx.value), length(o), 1)
  ELSE 1 - levenshtein(lower(cx.value), lower(vx.value)) / greatest(length(cx.value), length(vx.value), 1) END) AS mean
  FROM cx JOIN (SELECT *, substr(lower(value), 1, 1) || substr(lower(value), length(string_split(value, ' ')[1]) + 1) AS o FROM vx) vx ON cx.col_idx = vx.col_idx AND cx.kind = vx.kind GROUP BY ALL)
 SELECT col_idx, p, round(max(mean) * freq, 6) AS score FROM s GROUP BY col_idx, p, freq HAVING max(mean) > 0.25""")
def typed_predicates(spark, d):
    """All branches of the likeness of cells and values: numbers, dates, persons, descriptions, other texts."""
    c = read(spark, d, "customer")
    cells = c.selectExpr("'makers' AS table_id", "inline(array(" + ", ".join(f"named_struct('col_idx', {i}, 'value', {v[0]})" for i, v in _COLUMNS.items()) + "))")
    values = spark.sql(_values_sql(True).replace("FROM customer", "FROM {c}"), c=c)
    counted = values.withColumn("table_id", F.lit("makers")).groupBy("table_id", "col_idx", "p", "value").agg(F.count(F.lit(1)).alias("n"))
    freq = F.sum("n").over(relations.Window.partitionBy("table_id", "col_idx", "p"))
    return relations.typed_similarity(cells, counted.withColumn("freq", freq)).select("col_idx", "p", F.round("score", 6).alias("score"))


# ---- ontology --------------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || c_custkey AS child, 'c' || CAST(floor(c_custkey / 3) AS BIGINT) AS parent FROM customer WHERE c_custkey > 0 UNION SELECT 'n' || n_nationkey, 'n' || (n_nationkey - 1) FROM nation WHERE n_nationkey > 0),
 p(above, class, path) AS (SELECT child, child, [child] FROM e UNION SELECT parent, parent, [parent] FROM e UNION SELECT p.above, e.child, list_append(p.path, e.child) FROM p JOIN e ON e.parent = p.class)
 SELECT above, class, array_to_string(path, '/') AS path FROM p""")
def ontology_closure(spark, d):
    """A tree over customers and a chain over nations, closed by doubling."""
    c, n = read(spark, d, "customer").where("c_custkey > 0"), read(spark, d, "nation").where("n_nationkey > 0")
    tree = c.select(F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 3).cast("string")).alias("parent"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child"))
    chain = n.select(F.concat(F.lit("n"), (F.col("n_nationkey") - 1).cast("string")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"))
    return concepts.ontology_closure(tree.unionByName(chain)).select("above", "class", F.array_join("path", "/").alias("path"))
