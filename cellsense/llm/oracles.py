"""SQL of the corpus operators that SQL can express."""

from __future__ import annotations

from .collocations import COVER, LEAST, SCALE, TOP
from .mixing import WORD
from .quality_rules import CLASSES, GUARD_CHARS, GUARD_WORDS, LEAST_DOCS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, WORD_ALLOWANCE, WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def closure(nodes: str, pairs: str) -> str:
    """CTEs: l (links both ways) and c (node, the smallest node it reaches)."""
    return f"""l AS (SELECT a, b FROM {pairs} UNION ALL SELECT b, a FROM {pairs}), r(a, c) AS (SELECT id, id FROM {nodes} UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.a),
 c AS (SELECT a, min(c) AS c FROM r GROUP BY a)"""


JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
 s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
 e AS (SELECT id, len(s) AS n, unnest(s) AS t FROM s),
 p AS (SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.t = y.t AND x.id < y.id AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n) GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
 {closure("s", "p")} SELECT s.id AS doc_id, len(s.s) AS n_shingles, c.c AS component_id FROM s JOIN c ON c.a = s.id"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 k AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 p AS (SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.label = y.label AND x.id < y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
 {closure("v", "p")}, n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
 SELECT v.id AS vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, v.id = c.c AS kept FROM v JOIN c ON c.a = v.id LEFT JOIN n ON n.a = v.id"""

MIXING = f"""WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, source, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS g,
 md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')) AS k FROM documents),
 s AS (SELECT source, g, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source, g),
 w AS (SELECT *, CAST([3, 1, 2][i % 3 + 1] AS DOUBLE) AS w FROM s), o AS (SELECT *, 2.0::DOUBLE * n / w AS cap FROM w),
 q AS (SELECT *, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(2.0::DOUBLE * n) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM o WINDOW b AS (ORDER BY cap, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT first(level ORDER BY cap, i) AS level FROM q WHERE level <= cap),
 t AS (SELECT w.g, w.n, CASE WHEN n = 0 THEN 0 ELSE least(w * coalesce(f.level, CAST('inf' AS DOUBLE)), 2.0::DOUBLE * n) END AS target, CAST('0x' || substr(md5('17|' || w.g), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM w LEFT JOIN f ON true),
 x AS (SELECT doc_id, size, n, target, u, CASE WHEN n > 0 THEN target / n ELSE 0 END AS r, row_number() OVER (PARTITION BY g ORDER BY size, k) - 1 AS j FROM d JOIN t USING (g)),
 y AS (SELECT *, CAST(floor(u + r * (j + 1)) - floor(u + r * j) AS INTEGER) AS copies FROM x)
 SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM y"""

#: Character classes as SQL patterns, in the order of CLASSES; "mark" is what the others leave of ASCII.
_CLASS = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "stop": r"[.,;:?''\x22()-]", "symbol": "[#*$%&|<>]", "wide": r"[^\x00-\x7F]"}
_COUNT = {k: f"(length(t) - length(regexp_replace(t, '{rx}', '', 'g')))" for k, rx in _CLASS.items()}
_COUNT["mark"] = f"(length(t) - {' - '.join(_COUNT.values())})"
_COMMON = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in WORDS) + "]"


def _distance(bins: str, sums: str) -> str:
    """Jensen-Shannon distance of doc bins(id, k, n) to the languages' sums(lang, k, n) that the document may use(id, lang, own), its own counts left out; the smallest of all languages."""
    return f"""(SELECT id, min(sqrt(least(greatest(s / 2, 0), 1))) AS d FROM (SELECT id, lang, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) AS s
 FROM (SELECT i.id, f.lang, f.k, (f.n - CASE WHEN u.own THEN coalesce(b.n, 0) ELSE 0 END) / greatest(f.total - CASE WHEN u.own THEN i.total ELSE 0 END, 1) AS q, coalesce(b.n, 0) / greatest(i.total, 1) AS p
  FROM (SELECT id, sum(n) AS total FROM {bins} GROUP BY id) i JOIN use u ON u.id = i.id JOIN (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM {sums}) f ON f.lang = u.lang LEFT JOIN {bins} b ON b.id = i.id AND b.k = f.k) GROUP BY id, lang) GROUP BY id)"""


RULES = f"""WITH b AS (SELECT doc_id AS id, lang, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w FROM b),
 cb AS (SELECT id, unnest({list(CLASSES)}) AS k, unnest([{', '.join(_COUNT[k] for k in CLASSES)}]) AS n FROM b),
 u AS (SELECT id, coalesce(list_position({_COMMON}, trim(translate(x, '{_UPPER}', '{_LOWER}'), '.,;:!?')), 0) AS k FROM (SELECT id, unnest(w) AS x FROM w)),
 wb AS (SELECT id, k, count(*) AS n FROM u GROUP BY ALL), big AS (SELECT id, lang FROM w WHERE len(w) >= {GUARD_WORDS} AND lang IS NOT NULL),
 known AS (SELECT lang FROM big GROUP BY lang HAVING count(*) >= {LEAST_DOCS}), use AS (SELECT w.id, known.lang, len(w) >= {GUARD_WORDS} AND coalesce(w.lang = known.lang, false) AS own FROM w CROSS JOIN known),
 cs AS (SELECT lang, k, sum(n) AS n FROM cb JOIN big USING (id) GROUP BY ALL),
 ws AS (SELECT lang, k, sum(n) AS n FROM wb JOIN big USING (id) GROUP BY ALL), wz AS (SELECT lang, k, coalesce(ws.n, 0) AS n FROM (SELECT DISTINCT lang FROM ws) CROSS JOIN (SELECT unnest(range(0, {len(WORDS)} + 1)) AS k) LEFT JOIN ws USING (lang, k)),
 cd AS {_distance("cb", "cs")}, wd AS {_distance("wb", "wz")},
 g AS (SELECT id, i, count(*) OVER (PARTITION BY id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
 rep AS (SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY id),
 z AS (SELECT w.id, len(w.w) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, {_COUNT['symbol']} AS n_symbols, len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, cd.d AS c, wd.d AS v, length(t) AS chars
 FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ln FROM w) w LEFT JOIN rep ON rep.id = w.id LEFT JOIN cd ON cd.id = w.id LEFT JOIN wd ON wd.id = w.id),
 y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM z)
 SELECT id AS doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN chars >= {GUARD_CHARS} THEN round(c, 6) END AS char_distance, CASE WHEN n_words >= {GUARD_WORDS} THEN round(v, 6) END AS word_distance,
 NOT base_failed AND NOT coalesce(chars >= {GUARD_CHARS} AND c > {MAX_CHAR_DISTANCE}, false) AND NOT coalesce(n_words >= {GUARD_WORDS} AND v > {MAX_WORD_DISTANCE} + {WORD_ALLOWANCE} / sqrt(n_words), false) AS kept FROM y"""

COLLOCATIONS = rf"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
 w AS (SELECT lang, regexp_extract_all(unnest(p), '[^\x20\x09]+') AS w FROM t),
 g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
 n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
 c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
 cuts AS (SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, CAST({SCALE} * CAST(c.f AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.j + 1:], ' ')),
 best AS (SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
 inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS most FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
 kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < {COVER} * CAST(a AS HUGEINT))
 SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)) WHERE rank <= {TOP}"""

NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
 n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
 SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

ORACLES = {"op6_quality_rules": RULES, "op7_jaccard_join": JACCARD, "op8_embedding_dedup": VECTORS, "op9_mixing": MIXING, "op11_hard_negatives": NEGATIVES, "op12_collocations": COLLOCATIONS}
