"""Packing, sharding and mixing against brute force."""

import random
import struct
import zlib
from collections import defaultdict
from itertools import product

import pytest

from cellsense.llm import mixing, packing, sharding
from cellsense.llm.queries import vocabulary


def words(text):
    return len((text or "").encode().split())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def held(rows, ids_of, capacity):
    sequences, cover = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        cover[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for doc, pieces in cover.items():
        got = b"".join(bytes(r.ids) for r in sorted(pieces, key=lambda r: r.start))
        assert sum(r.length for r in pieces) % len(ids_of[doc]) == 0
        if len(pieces) and sum(r.length for r in pieces) == len(ids_of[doc]):
            assert got == struct.pack(f"<{len(ids_of[doc])}I", *ids_of[doc])
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.doc_tokens == len(ids_of[doc]) for r in pieces)
    used = [sum(r.length for r in p) for p in sequences.values()]
    return sum(used), sum(0 if not u & (u - 1) else capacity - u for u in used)


def test_packing_is_whole_and_nearly_without_padding(odd, tokenizer):
    docs = {r.doc_id: r.text or "" for r in odd.collect()}
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids + [1] for d, t in docs.items()}
    total, padding = held(packing.pack(odd, vocabulary(), with_ids=True).collect(), ids, 2048)
    assert total == sum(len(ids[r.doc_id]) for r in odd.collect()) and padding == 0


def test_token_ids_match_on_white_space_and_special_text(tokenizer):
    table = packing.words(vocabulary())
    for t in ["", " ", "a  b", "a   b", " a\n b \n", "a\n  b", "x\t y", "é ñ  ", "a <|endoftext|> b", "it's  John's", "a b", " lead", "tab\t\tx  \n\n z", "1 2  3"]:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(table.ids(t)) // 4}I", table.ids(t))) == want, repr(t)


def test_token_ids_match_on_every_mix_of_white_space_and_words(tokenizer):
    table = packing.words(vocabulary())
    texts = ["".join(x) for n in range(5) for x in product([" ", "\n", "\u3000", "\x1c", "a", "'s", "1", "."], repeat=n)]
    texts.append(" " * 1_200_000 + "a" + "\n " * 1000 + "b")  # a look-ahead overran its stack here
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert table.ids(text) == struct.pack(f"<{len(want.ids)}I", *want.ids), repr(text[:20])


def test_new_words_of_a_text_are_encoded_in_one_call(monkeypatch):
    """each word not met before took a call of its own, which doubled the packing's time."""
    table, calls = packing.words(vocabulary()), []
    encode = table.encode
    monkeypatch.setattr(table, "encode", lambda text: calls.append(text) or encode(text))
    table.ids(" ".join(f"word{i}" for i in range(1000)))
    assert len(calls) == 1


def test_hot_lengths_are_cut():
    p = packing.Packer(64, 16, 0)
    for i in range(100):
        p.add(i, struct.pack("<40I", *range(40)))
    p.end()
    used = defaultdict(int)
    for r in p.out:
        used[r[5]] += r[2]
    assert sum(used.values()) == 4000 and all(u & (u - 1) == 0 for u in used.values())


def test_packing_of_nothing(none):
    assert packing.pack(none, vocabulary()).count() == 0


def jump(key, n):
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 16, 17, 1000])
def test_jump_hash(spark, n):
    keys = [0, 1, -1, 5, 10**12, -(10**15), 2**63 - 1, -(2**63), *range(50, 90)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()
    assert [r.s for r in got] == [jump(r.k, n) for r in got]


def test_sharding(odd, none):
    rows = sharding.shard(odd, 4).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.shard == jump(r.doc_id or 0, 4) and r.grown_shard in (r.shard, 4)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    assert sharding.shard(none, 4).count() == 0


def test_write_shards(odd, tmp_path, spark):
    sharding.write_shards(odd, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()


def test_shares_by_plain_rounds():
    def rounds(sizes, weights, total, limit):
        target, done = [0.0] * len(sizes), [False] * len(sizes)
        while True:
            left, w = total - sum(t for t, d in zip(target, done, strict=True) if d), sum(x for x, d in zip(weights, done, strict=True) if not d)
            over = False
            for i in range(len(sizes)):
                if not done[i]:
                    target[i] = left * weights[i] / w
            for i in range(len(sizes)):
                if not done[i] and target[i] > limit * sizes[i]:
                    target[i], done[i], over = limit * sizes[i], True, True
            if not over:
                return target

    for sizes in ([100, 10, 50, 7, 900], [5, 5], [0, 10, 10], [1]):
        w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        assert mixing.share_out(sizes, w, 1.5 * sum(sizes), 2.0) == pytest.approx(rounds(sizes, w, 1.5 * sum(sizes), 2.0))


def test_mixing(odd, none):
    rows = mixing.mix_plan(odd).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in rows) == sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix_plan(odd.repartition(5)).collect())
    sizes = defaultdict(int)
    for r in odd.collect():
        sizes[r.source] += words(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.share_out([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2.0), strict=True))
    assert {round(r.target, 6) for r in rows} == {round(t, 6) for t in want.values()}
    assert all(r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0 for r in rows)
    for s in ("s0", "s1"):
        taken = sum(r.taken for r in rows if round(r.target, 6) == round(want[s], 6))
        assert abs(taken - want[s]) <= 0.1 * want[s]
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_many_sources_get_the_same_targets(spark):
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(400)}" if rng.random() < 0.95 else None, rng.choice([0, 1, 5, 40, 900])) for _ in range(3000)]
    sized = spark.createDataFrame(rows, "source string, _size long")
    few = {r._g: (r.source_size, r.target) for r in mixing.targets(sized).collect()}
    many = {r._g: (r.source_size, r.target) for r in mixing.targets(sized, small=0).collect()}
    assert few.keys() == many.keys() and all(many[g] == (n, pytest.approx(t)) for g, (n, t) in few.items())
    assert mixing.targets(sized.where("false"), small=-1).count() == 0
