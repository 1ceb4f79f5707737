"""Near-duplicate texts and vectors against brute force."""

import random

import numpy as np
import pytest

from cellsense.llm import embedding_dedup, jaccard_join
from cellsense.llm.common import components, written


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, percent, width):
    sets = {i: shingles(t, width) for i, t in docs}
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in roots(ids, edges).items()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    docs = []
    for g in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 30, 100, 200]))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(w).upper() if g % 2 else "\n".join(w)))
    near = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(700):  # more than one block
        w = list(near)
        w[rng.randrange(150)] = rng.choice(vocabulary)
        docs.append((len(docs), " ".join(w)))
    return [*docs, (len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, " \n")]


@pytest.mark.parametrize(("percent", "width"), [(90, 3), (80, 5)])
def test_components_match_brute_force(spark, corpus, percent, width):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, percent, width, ranges=64).collect()}
    want = brute(corpus, percent, width)
    assert got == want
    kept = {r.doc_id for r in jaccard_join.distinct(df, percent, width).collect()}
    assert kept == {i for i, (n, r) in want.items() if i == r or n == 0}


def test_only_pairs_that_pass_all_filters_are_verified(spark):
    rng = random.Random(4)
    part = [[f"w{i}x{j}" for j in range(40)] for i in range(120)]
    docs = [(i, " ".join(w for k in range(6) for w in part[(i + k) % 120])) for i in range(120)]  # a ring: neighbours share five of six parts
    docs += [(200 + i, " ".join(rng.choice(part[7]) for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marked = written(jaccard_join.prefixes(df, 90, 3, 64))
    verified = []
    ties = jaccard_join.links(df, marked, 90, 3, verified)
    assert ties.where("a <> b").isEmpty()
    lists = {r.cid: r for r in marked.collect()}.values()
    meet = lambda a, b: all(set(a[f"pre{k}"]) & set(b[f"pre{k}"]) for k in range(jaccard_join.ORDERS))
    allowed = sum(meet(a, b) for a in lists for b in lists if a.cid < b.cid)
    checked = sum(v.agg({"checked": "sum"}).first()[0] or 0 for v in verified)
    assert 0 < checked <= allowed < 700


def test_large_group_costs_its_rows(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    docs = [(0, " ".join(base))]
    for i in range(1, 1500):
        w = list(base)
        w[rng.randrange(300)] = f"n{i % 400}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marked, verified = written(jaccard_join.prefixes(df, 90, 3, 64)), []
    got = components(jaccard_join.links(df, marked, 90, 3, verified).select("a", "b"))
    assert got.select("root").distinct().count() == 1
    rows = marked.agg({"cid": "count"}).first()[0]
    assert sum(v.agg({"checked": "sum"}).first()[0] or 0 for v in verified) < 20 * rows  # of a million pairs


def test_odd_rows(odd, none):
    got = jaccard_join.join(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[111].component_id == by[112].component_id == by[113].component_id == 110 and by[115].component_id == 114
    assert by[100].n_shingles == by[101].n_shingles == by[102].n_shingles == 0 and by[102].component_id == 102
    assert by[None].component_id is None
    kept = jaccard_join.distinct(odd, 90, 3)
    assert kept.columns == odd.columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == sorted([-1, *range(60), 100, 101, 102, 103, 104, 110, 114])
    assert jaccard_join.join(none).count() == 0 and jaccard_join.distinct(none).columns == none.columns


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(5, "a b c d")] * 3 + [(5, "other words entirely here")], "doc_id long, text string")
    assert sorted(r.text for r in jaccard_join.distinct(df, 90, 3).collect()) == ["a b c d", "other words entirely here"]


def test_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 5)]
    for one_task in (0, 1000):
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
        assert got == roots({x for e in edges for x in e}, edges)


def test_chains_in_random_order(spark):
    ids = random.Random(2).sample(range(10**6), 4000)
    edges = [*zip(ids, ids[1:], strict=False), *((2_000_000 + i, 3_000_000) for i in range(500)), (2_000_499, 1_500_000), (5_000_001, 5_000_001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=0).collect()}
    edges = [(a, b) for a, b in edges if a != b]
    assert got == roots({x for e in edges for x in e}, edges)


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for g in range(150):
        base = rng.normal(size=64)
        for _ in range(int(rng.integers(1, 8))):
            v = base + rng.normal(size=64) * rng.choice([0, 0.02, 0.08, 0.15])
            rows.append((k, int(g % 4), [float(np.float32(x)) for x in v]))
            k += 1
    near = rng.normal(size=64)
    for _ in range(1100):  # more than one block
        rows.append((k, 9, [float(np.float32(x)) for x in near + 0.05 * rng.normal(size=64)]))
        k += 1
    odd = [(k, 1, None), (k + 1, None, rows[0][2]), (k + 2, 1, [0.0] * 64), (k + 3, 1, [float("nan")] * 64), (k + 4, 1, [None] * 64), (k + 5, 1, [float("inf")] * 64), (k + 6, 1, []), (k + 7, 1, [1.0, 2.0]), (k + 8, 1, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, label int, embedding array<float>, node int, links string")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    x, label = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    n = np.linalg.norm(x, axis=1)
    near = ((x @ x.T) / np.outer(n, n) >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    count = near.sum(1)
    found = np.array([got[i].n_links for i in range(k)])
    assert (found <= count).all() and found.sum() >= 0.99 * count.sum()
    want = roots(range(k), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    assert sum(got[i].component_id != want[i] for i in range(k)) <= 3
    assert all(got[i].kept == (got[i].component_id == i) for i in range(k))
    assert [got[k + i].n_links for i in range(9)] == [0] * 7 + [1, 1] and got[k + 8].component_id == k + 7
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(embedding_dedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(embedding_dedup.hadamard(embedding_dedup.hadamard(x)), x)


@pytest.mark.parametrize("depth", [2, 3, 4, 5])
@pytest.mark.parametrize("dim", [64, 128])
def test_recall_at_every_depth(depth, dim):
    """Of pairs just at the limit, the share that meets in a bucket."""
    rng = np.random.default_rng([depth, dim])
    x = rng.normal(size=(400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z
    a, b = embedding_dedup.buckets(x, depth), embedding_dedup.buckets(y, depth)
    met = [any(set(p) & set(q) for p, q in zip(s, t, strict=True)) for s, t in zip(a.tolist(), b.tolist(), strict=True)]
    assert np.mean(met) >= 0.99


def test_numbers_of_any_size_link(spark):
    base = np.random.default_rng(1).normal(size=32)
    rows = [(i, 1, [float(v) for v in base * s]) for i, s in enumerate((1.0, 1e300, 1e-300, 1e-310, -1.0))] + [(None, 1, [float(v) for v in base]), (None, 1, None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    by = {r.vec_id: r for r in got if r.vec_id is not None}
    assert [by[i].n_links for i in range(5)] == [4, 4, 4, 4, 0] and {by[i].component_id for i in range(4)} == {0}
    assert sorted((r.n_links, r.component_id is None) for r in got if r.vec_id is None) == [(0, True), (4, False)]
