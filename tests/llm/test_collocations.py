"""Collocations against a plain count, and suffix arrays against sorting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellsense.llm import collocations as C


def plain(rows, least, top, cover=80, longest=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        rows = []
        for p, a in cands.items():
            if 100 * most[p] >= cover * a:
                continue
            score, _, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    phrase = ["new york city", "as well as", "Prime Minister of the", "x y x y x", "ça va très bien"]
    word = lambda: rng.choice("the of a zu it x y né 😀 city new".split()) + rng.choice(["", "", ",", ". ", "\n", "\t"])
    return [(rng.choice(["en", "en", "en", "de", None, "und"]), " ".join(rng.choice(phrase) if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("size,least,top", [(2_000_000, 5, 2000), (50, 5, 2000), (300, 3, 7)])
def test_equals_a_plain_count(spark, size, least, top):
    rows = texts(size, 150) + [("en", None), ("en", ""), ("fr", " \t ."), ("en", "the the the the the the " * 20)]
    docs = spark.createDataFrame([(lang, t, 1, "x") for lang, t in rows], "lang string, text string, n long, words string").repartition(3)
    got = C.collocations(docs, least=least, top=top, size=size)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, top)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | {c: "bigint" for c in ("rank", "a", "l", "r", "n", "score")}


def test_odd_and_no_texts(spark, odd, none):
    assert sorted(tuple(r) for r in C.collocations(odd, least=3).collect()) == plain([(r.lang, r.text) for r in odd.collect()], 3, 2000)
    assert C.collocations(none).count() == 0


@pytest.mark.parametrize("depth", [2, 4])
def test_suffix_array_is_the_sorted_order(depth):
    rng = np.random.default_rng(depth)
    for n in (0, 1, 2, 50, 400):
        ids = rng.integers(0, 5, n).astype(np.int32)
        order, lcp = C.suffix_array(ids, depth)
        whole = lambda i: tuple(ids[i : i + depth][: next((k for k, x in enumerate(ids[i : i + depth]) if x == 0), depth)])  # noqa: B023, E731
        assert sorted(order.tolist()) == np.flatnonzero(ids).tolist() and [whole(i) for i in order] == sorted(whole(i) for i in order)
        for k in range(2, depth + 1):
            grams, c = C.intervals(ids, order, lcp, k)
            assert dict(zip(map(tuple, grams.tolist()), c.tolist(), strict=True)) == Counter(whole(i)[:k] for i in order if len(whole(i)) >= k)


def test_pairs_go_packed_and_come_back_to_their_shards(spark):
    """The frequent pairs of all shards and each shard's own; a row of the shuffle holds many pairs, in a third of the bytes that their numbers take."""
    rng = np.random.default_rng(6)
    shards_, rows = {}, []
    for shard in (0, 1 << 41, 7 << 41):
        number = np.sort(rng.choice(5000, 800, replace=False)) + (3 << 41)
        ids = np.append(np.minimum(rng.zipf(1.3, 20_000), 800), 0).astype("<i4")
        rows.append((shard, ids.tobytes(), [(k + 1, int(x)) for k, x in enumerate(number)]))
        shards_[shard] = Counter(zip(number[ids[:-2] - 1].tolist(), number[ids[1:-1] - 1].tolist(), strict=True))
    numbered = spark.createDataFrame(rows, "shard long, ids binary, local array<struct<at:int,number:long>>")
    sent = C.pairs(numbered, 4).collect()
    assert len(sent) == 12 and sum(r.n for r in sent) == sum(map(len, shards_.values())) and 3 * sum(len(r.data) for r in sent) < 24 * sum(r.n for r in sent)
    got = C.frequent_pairs(C.pairs(numbered, 4), 30).collect()
    whole = Counter()
    for c in shards_.values():
        whole.update(c)
    often = {k: v for k, v in whole.items() if v >= 30}
    assert {(r.w1, r.w2): r.f for r in got if r.f is not None} == often and len(often) > 50
    back = [(r.shard, *pair) for r in got if r.shard is not None for pair in C.unpack(r.data, r.n, 2).T.tolist()]
    assert sorted(back) == sorted((s, *k) for s, c in shards_.items() for k in c if k in often)
