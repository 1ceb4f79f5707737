"""Quality rules, classifiers and url filters."""

import itertools
import re
import zlib
from collections import Counter

import compare
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsense.llm import quality_classifier, quality_rules, toxicity, url_filters
from cellsense.llm.queries import ORACLES, QUERIES


def base(text):
    b = (text or "").encode()
    w = b.split()
    lines = [x for x in b.split(b"\n") if x.split()]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_counts(spark, odd):
    extra = spark.createDataFrame([(500, "a b c\na b c\n\n a b c\n#x é|", "en"), (501, "a a a a a", "en"), (502, "x y z x y", "en"), (503, "x\x0by\x85z w", "en")], "doc_id long, text string, lang string")
    docs = odd.select("doc_id", "text", "lang").unionByName(extra)
    for r, t in zip(quality_rules.judge(docs).orderBy("doc_id", "n_words").collect(), sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)), strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t.text), t.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_distance_of_distributions():
    assert quality_rules.jensen_shannon(np.array([[1, 1], [2, 0]]), np.array([0.5, 0.5])) == pytest.approx([0, 0.5579, ], abs=1e-3)
    assert quality_rules.jensen_shannon(np.array([[3, 0]]), np.array([0.0, 1.0])) == pytest.approx([1])


def test_junk_goes_and_prose_stays(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = quality_rules.judge(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_every_language_has_a_reference(spark, tmp_path):
    rng, rows = np.random.default_rng(7), []
    common = [x.split() for x in quality_rules.COMMON.values()]
    for k in range(20):  # the last four, in scripts of their own, have the least text
        letters = [chr((0x4E00, 0x0E01, 0x0621, 0x0905)[k - 16] + i) for i in range(20)] if k > 15 else list("abcdefghijklmnopqrstuvwxyz")
        for _ in range(2 if k > 15 else 4):
            own = ["".join(rng.choice(letters, 5)) for _ in range(80 if k > 15 else 150)]
            rows.append((len(rows), " ".join([*own, *(rng.choice(common[k % 4], 50 + k) if k < 16 else [])]), f"l{k:02}"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare.difference(spark, con, QUERIES["op6_quality_rules"], ORACLES["op6_quality_rules"], str(tmp_path)) == ""
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert len(quality_rules.references(docs)) == 20 and quality_rules.keep(docs).where("lang >= 'l16'").count() == 8


def test_a_mark_of_its_own_is_no_reference(spark, data, tmp_path):
    """Junk of a language mark that no other document has is compared with the others' references, and its own counts are left out."""
    rng = np.random.default_rng(9)
    junk = [(10_000 + i, " ".join("".join(rng.choice(list("0123456789#%&|<>{}="), 9)) for _ in range(120)), f"x{i}") for i in range(50)]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    both = docs.unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    before, after = ({r.doc_id for r in quality_rules.judge(d).where("kept").collect()} for d in (docs, both))
    assert after == before and not any(i >= 10_000 for i in after)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare.difference(spark, con, QUERIES["op6_quality_rules"], ORACLES["op6_quality_rules"], str(tmp_path)) == ""
    alone = spark.createDataFrame(junk[:1], "doc_id long, text string, lang string")
    assert [(r.kept, r.char_distance) for r in quality_rules.judge(alone).collect()] == [(True, None)]  # nothing to compare with


def test_rules_without_a_language_column(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").drop("lang")
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_empty_tables(none, spark):
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep(none).columns == none.columns
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(none, labels).count() == 0 and toxicity.classify(none, labels).count() == 0


def test_without_labels_all_scores_are_even(odd, spark):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.classify(odd, labels).collect()} == {0.5}
    assert {r.score for r in toxicity.classify(odd, labels).collect()} == {0.5}


def auc(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality_classifier"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id)
    assert auc(got.score.values, got.quality.values) > 0.95 and (got.predicted == got.quality).mean() > 0.9


def test_isotonic_levels_rise():
    x, y = np.random.default_rng(0).normal(size=300), np.random.default_rng(1).integers(0, 2, 300)
    at, level = quality_classifier.isotonic(x, y)
    assert (np.diff(level) > 0).all() and (np.diff(at) > 0).all()


def test_toxicity_learns_words_and_unseen_spellings(spark):
    rng = np.random.default_rng(4)
    clean = ["".join(rng.choice(list("aeiourstln"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(clean, 40))
        if i % 3 == 0:
            w[5], w[20] = "wretchling", "grubfiend"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(1000, " ".join(rng.choice(clean, 40))), (1001, " ".join([*rng.choice(clean, 37), "wretchlings", "grubfiends", "wretchlingz"])), (1002, None), (1003, "")]
    got = {r.doc_id: r for r in toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [r for i, r in got.items() if i < 600 and r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.95
    assert got[1001].score > 0.5 > got[1000].score and 0 <= got[1002].score == got[1003].score <= 1


CASES = [
    ("https://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("http://x.ORG/", "x.org", "/", "org/", "allow"),
    ("http://x.org", "x.org", "", None, "allow"), ("ftp://b.com/de/?q=1", "b.com", "/de/", "com/de/", "block"), ("http://b.com/fr/#x", "b.com", "/fr/", "com/fr/", "allow"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("mailto:x", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://É.net?a", "É.net", "", None, "allow"), ("http://a.net/x://y", "a.net", "/x://y", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, c[0], 1) for i, c in enumerate(CASES)], "page_id long, url string, rule int")
    got = sorted(url_filters.judge(pages, []).collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [c[1:] for c in CASES]


def test_url_rules_are_mined(spark):
    rows = [(i, f"http://{'bad' if i % 4 == 0 else 'good'}.net/{'shop' if i % 2 == 0 else 'news'}/{i}") for i in range(400)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)]
    pages, lab = spark.createDataFrame([*rows, (900, "http://bad.net/news/z"), (901, "http://good.net/shop/z"), (902, "http://new.net/" + "a/" * 5000)], "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    mined = url_filters.mine(pages, lab)
    assert any(v == "block" for _, v, _ in mined)
    got = {r.page_id: r for r in url_filters.judge(pages, mined).collect()}
    brute = lambda url: next((v for have, v, _ in mined if set(have) <= set(url_filters.tokens(url))), "allow")
    assert all(got[i].verdict == brute(u) for i, u in [*rows, (900, "http://bad.net/news/z"), (902, "http://new.net/" + "a/" * 5000)])
    assert got[0].verdict == "block" and got[1].verdict == "allow"
    assert url_filters.mine(pages, lab.where("false")) == [] and url_filters.classify(pages.where("false"), lab).count() == 0


def enumerated(rows, least, min_confidence, min_chi):
    """Every set of tokens that stands in enough rows of a verdict, by going through all subsets of all rows."""
    total, hits = len(rows), Counter(v for _, v in rows)
    n, k = Counter(), Counter()
    for have, v in rows:
        for size in range(1, len(have) + 1):
            for c in itertools.combinations(sorted(have), size):
                n[c] += 1
                k[c, v] += 1
    out = {}
    for (c, v), x in k.items():
        gain = x * total - n[c] * hits[v]
        chi = total * gain * abs(gain) / (n[c] * max(total - n[c], 1) * hits[v] * (total - hits[v]))
        if x >= least and x / n[c] >= min_confidence and chi >= min_chi:
            out[c, v] = x / n[c]
    return out


def test_mined_rules_are_those_of_all_subsets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"http://{rng.choice(['a', 'b', 'c'])}.net/{rng.choice(['x', 'y', 'z'])}/{rng.choice(['p.html', 'q.html', 'q'])}{rng.choice(['', '?u=1'])}") for i in range(500)]
    labels = [(i, int("a.net" not in u and "/x/" not in u or rng.random() < 0.1), 0) for i, u in rows]
    mined = url_filters.mine(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    sets = [(frozenset(url_filters.tokens(u)), "allow" if q else "block") for (_, u), (_, q, _) in zip(rows, labels, strict=True)]
    every = enumerated(sets, max(url_filters.MIN_ROWS, url_filters.MIN_SUPPORT * 500), url_filters.MIN_CONFIDENCE, url_filters.MIN_CHI)
    where = lambda c: frozenset(i for i, (have, _) in enumerate(sets) if have.issuperset(c))
    # of rules on the same rows one stands for all; a rule that a shorter one's rows and confidence beat isn't kept
    best = {}
    for (c, v), conf in every.items():
        best.setdefault((where(c), v), conf)
    got = {(where(c), v): conf for c, v, conf in mined}
    assert all(best[key] == pytest.approx(conf) for key, conf in got.items())
    beaten = lambda key: any(v == key[1] and rows > key[0] and conf >= best[key] for (rows, v), conf in best.items())
    assert {key for key in best if not beaten(key)} <= set(got)
    assert len(mined) == len(got) > 3


def test_explicit_rules_teach(spark):
    rows = [(i, f"http://s{i % 7}.{'com' if i % 3 else 'net'}/{'de' if i % 2 else 'fr'}/{i}") for i in range(600)]
    pages, none = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_filters.classify(pages, none).collect()
    by = Counter((r.by, r.verdict) for r in got)
    assert by["mined", "block"] == 100 and by["mined", "allow"] == 100 and by["rule", "block"] == by["rule", "allow"] == 200  # com/de and com/fr teach net
    assert all(r.verdict == ("block" if "/de/" in u else "allow") for r, (_, u) in zip(sorted(got), rows, strict=True))


def test_mined_rules_decide_some_pages(spark):
    d = "/root/testdata/sf0.1"
    by = Counter(r.by for r in QUERIES["op4_url_filters"](spark, d).collect())
    assert by["mined"] > 0 and by["rule"] > 0


def test_toxicity_sample_is_bounded_by_size(spark):
    rows = [(i, "word " * 100) for i in range(50)] + [(100, "x" * 5000), (101, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    sample = lambda **k: toxicity.sample(docs, labels, "toxic", F.lit(True), **k)
    assert len(sample()[0]) == 52
    texts, y = sample(max_bytes=10_000, max_text=4000)
    assert len(texts) == len(y) == 21 and sum(map(len, texts)) == 10_000  # twenty texts and the empty one; the long one is passed over
    assert texts == sample(max_bytes=10_000, max_text=4000)[0]


def test_toxicity_training_matches_a_plain_version():
    """The batched steps against one document and one vector at a time."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(12)]
    texts = [" ".join(rng.choice(words, 6)).encode() for _ in range(10)]
    y = np.array([i % 2 for i in range(10)])
    fast, slow = toxicity.Model(), toxicity.Model()
    steps = 12
    old, toxicity.MIN_STEPS = toxicity.MIN_STEPS, steps
    try:
        fast.train(texts, y, epochs=1)
    finally:
        toxicity.MIN_STEPS = old
    v, u, b = slow.v.astype(np.float64), slow.u.astype(np.float64), slow.b.astype(np.float64)
    ids = {w: toxicity.grams([w])[1] for w in {w for t in texts for w in toxicity.bag(t)}}
    mean = {i: [np.zeros_like(p) for p in (v, u, b)] for i in (0, 1)}
    order = np.random.default_rng(7)
    for step in range(1, steps + 1):
        part = order.permutation(len(texts))
        gv, gu, gb = np.zeros_like(v), np.zeros_like(u), np.zeros_like(b)
        for d in part:
            w = toxicity.bag(texts[d])
            h = sum(toxicity.SCALE / len(w) * np.mean([v[i] for i in ids[x]], axis=0) for x in w)
            z = h @ u + b
            p = np.exp(z - z.max())
            p = p / p.sum()
            p[y[d]] -= 1
            p /= len(part)
            gu, gb = gu + np.outer(h, p), gb + p
            for x in w:
                for i in ids[x]:
                    gv[i] += toxicity.SCALE / len(w) / len(ids[x]) * (u @ p)
        gv += toxicity.DECAY * v
        for k, (x, g) in enumerate(((v, gv), (u, gu), (b, gb))):
            mean[0][k] = 0.9 * mean[0][k] + 0.1 * g
            mean[1][k] = 0.999 * mean[1][k] + 0.001 * g**2
            x -= toxicity.RATE * (mean[0][k] / (1 - 0.9**step)) / (np.sqrt(mean[1][k] / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(fast.u, u, atol=2e-3) and np.allclose(fast.b, b, atol=2e-3) and np.allclose(fast.v[sorted({i for x in ids.values() for i in x})], v[sorted({i for x in ids.values() for i in x})], atol=5e-3)


def test_quality_fit_matches_a_plain_version(spark):
    """Partition-summed normal equations and pooled steps against one matrix and a plain least-squares isotonic fit."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(60)) + (" !! | " * 8 if i % 3 == 0 else ".")) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 != 0) if i % 10 else i % 2) for i, _ in rows], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    part = {r.doc_id: r.c for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(3)) == 0).alias("c")).collect()}
    y = {r.doc_id: r.quality for r in labels.collect()}
    x = {i: quality_classifier.statistics(t.encode()) for i, t in rows}
    train, held = [i for i, _ in rows if not part[i]], [i for i, _ in rows if part[i]]
    a = np.array([x[i] for i in train])
    mean, scale = a.mean(0), np.sqrt(np.maximum((a * a).mean(0) - a.mean(0) ** 2, 1e-6))
    z = quality_classifier.lift(a, mean, scale)
    # ridge as least squares on rows stacked with the root of the penalty
    stacked = np.vstack([z, np.sqrt(quality_classifier.RIDGE) * np.eye(z.shape[1])])
    weights = np.linalg.lstsq(stacked, np.r_[[y[i] for i in train], np.zeros(z.shape[1])], rcond=None)[0]
    raw = quality_classifier.lift(np.array([x[i] for i in held]), mean, scale) @ weights
    assert np.allclose(quality_classifier.lift(np.array([x[i] for i in held]), model.mean, model.scale) @ model.weights, raw, atol=1e-6)
    order = np.argsort(raw, kind="stable")
    t = np.array([y[i] for i in held], float)[order]
    # the isotonic fit at each place is the largest over beginnings before it of the smallest mean to an end after it
    level = [max(min(t[a : e + 1].mean() for e in range(i, len(t))) for a in range(i + 1)) for i in range(len(t))]
    at = [raw[order][[j for j in range(len(t)) if abs(level[j] - v) < 1e-12]].mean() for v in sorted(set(np.round(level, 12)))]
    assert np.allclose(model.level, sorted(set(np.round(level, 12)))) and np.allclose(model.at, at, atol=1e-6)


def test_url_rules_see_whole_urls_and_all_sites(spark):
    tail = "/".join("abcdefghijklm")
    rows = [(i, f"https://www.s{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijkl'[i // 26 % 12]}.net/{tail}?x=1&y=2#z") for i in range(312 * 25)]
    labels = spark.createDataFrame([(i, int(i % 26 >= 13), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    mined = url_filters.mine(spark.createDataFrame(rows, "page_id long, url string"), labels)
    index = url_filters.Index(mined)
    assert all(index.verdict(url_filters.tokens(u)) == ("allow" if i % 26 >= 13 else "block") for i, u in rows[:312])


def test_most_urls_bad(spark):
    rows = [(i, f"http://{'good' if i % 10 == 0 else 'bad'}.net/{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.verdict, r.by) for r in url_filters.classify(pages, labels).collect()}
    assert all(got[i] == ("allow" if i % 10 == 0 else "block", "mined") for i, _ in rows)
