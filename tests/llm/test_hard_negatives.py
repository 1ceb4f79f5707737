"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest

from cellsense.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, q string, block string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, c, None if e is None else [None if x is None else float(x) for x in e], "x", "y", 1) for i, c, e in rows], SCHEMA)


def plain(rows, every, moved=7, classes=10):
    best = {}
    for i, c, e in rows:
        if i is None or c is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = ((c + 1) % classes if i % moved == 0 else c, [math.floor(256 * float(np.float32(x))) for x in e])
        best[i] = min(best.get(i, v), v)
    out = []
    for a, (c, q) in best.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, r, strict=False)) for i, (_, r) in best.items()}
        for p in sorted((i for i, (k, _) in best.items() if k == c and i != a), key=lambda i: (-score[i], i))[:5]:
            fit = sorted((i for i, (k, _) in best.items() if k != c and 50 * score[p] <= 100 * score[i] <= 95 * score[p]), key=lambda i: (-score[i], i))[:3]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit)]
    return sorted(out)


def clusters(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        x = centers[rng.integers(0, 6)] + spread * rng.normal(size=dims)
        rows.append((i, int(rng.integers(0, 4)), (x / np.linalg.norm(x)).tolist()))
    return rows


@pytest.mark.parametrize("spread,block,group", [(0.3, 20, 8), (1.0, 50, 5), (0.5, 2048, 2048)])
def test_equals_all_pairs(spark, spread, block, group):
    rows = clusters(int(spread * 100), 700, 12, spread)
    rows += [(1000 + i, i % 2, rows[3][2]) for i in range(120)]  # one vector many times, of two labels
    want = plain(rows, 10)
    label = H.F.when(H.F.col("vec_id") % 7 == 0, (H.F.col("label") + 1) % 10).otherwise(H.F.col("label"))
    got = H.mine(H.integers(frame(spark, rows), label), H.F.col("vec_id") % 10 == 0, block=block, group=group)
    assert len(want) > 200 and sorted(tuple(r) for r in got.collect()) == want


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.5]), (2, 1, [0.5, 0.4]), (3, 2, [0.4, 0.4]), (4, 2, [0.4, 0.4]), (5, 2, [0.4, 0.4]), (6, 3, [0.4, 0.4]), (8, None, [0.4, 0.4]), (9, 2, None)]
    rows += [(10, 2, [0.4, None]), (11, 2, [nan, 0.4]), (12, 2, [0.4, inf]), (None, 2, [0.4, 0.4]), (13, 1, [0.6]), (15, 2, []), (16, 1, [-1.0, -1.0]), (1, 1, [0.5, 0.5]), (3, 1, [0.3, 0.4]), (50, 5, [1.0, 0.0]), (100, 2, [3e5, 0.0])]
    got = H.hard_negatives(frame(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == plain([r for r in rows if r[0] != 100], 50)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and dict(got.dtypes)["rank"] == "int"
    assert H.hard_negatives(frame(spark, rows).where("false")).count() == 0
    assert H.hard_negatives(frame(spark, rows[1:3])).count() == 0


def test_intervals_hold(spark):
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(-300, 300, (9, 6)), rng.integers(-300, 300, (7, 6)) // rng.integers(1, 50)
        lo, hi = H.interval(*H.ball(a.astype(float)), *H.ball(b.astype(float)))
        got = H.products(a, b)
        assert lo <= got.min() and got.max() <= hi


def test_near_clusters_are_pruned():
    rng = np.random.default_rng(5)
    far = [(200 * np.eye(8)[i % 8] + rng.integers(-5, 5, 8)).astype(np.int64) for i in range(4000)]
    rows, scored = np.array(far), []
    a = H.Anchors(np.arange(100), rows[:800:8], np.zeros(100, dtype=np.int64), np.full((100, 1), -(1 << 62)), np.full((100, 1), 1 << 62), 5, True)
    a.score, plain_score = lambda *x: (scored.append((x[1] - x[0]) * len(x[2])), plain_score(*x)), a.score
    a.meet(H.Tree(np.arange(1000, 5000), rows), 0)
    assert sum(scored) < 0.3 * 100 * 4000
    got = np.sort((rows[:800:8] @ rows.T), axis=1)[:, ::-1][a.tree.order, :5]
    assert (a.best[:, 0] == got).all()


def test_large_numbers_are_exact():
    a = np.array([[(1 << 26) - 1] * 64, [-(1 << 26) + 1] * 64])
    assert H.products(a, a).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in a] for r in a]
