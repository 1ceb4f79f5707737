"""The token file format against the tokenizers library, and its parts."""

import random
import struct
import zlib

import numpy as np
import pytest

from cellsense.llm import token_planes as P
from cellsense.llm.queries import QUERIES, vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def expected(rows, tokenizer):
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), at))
        at += len(ids)
    return out, at


@pytest.mark.parametrize("kind,block", [("byte", 1 << 16), ("bit", 1000)])
def test_round_trip_of_odd_texts(spark, odd, tokenizer, tmp_path, kind, block):
    path = str(tmp_path / "out")
    P.write(odd, path, vocabulary(), kind=kind, block=block)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_crc32, r.start) for r in P.read_documents(spark, path).collect()), key=lambda r: r[3])
    want, total = expected([(r.doc_id, r.text) for r in odd.collect()], tokenizer)
    assert got == want
    # any stretch of ids can be read by place
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    ids = [i for doc, *_ in want for i in [*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 0]]
    for start, n in ((0, 10), (total - 5, 5), (total // 3, 2500)):
        read = sorted(P.read_ids(spark, path, start, n).collect())
        assert [i for r in read for i in r.ids] == ids[start : start + n] and read[0].start == start


def test_blocks_are_full_and_small(spark, odd, tmp_path):
    path = str(tmp_path / "out")
    P.write(odd, path, vocabulary(), block=500)
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    last = {s: max(r.chunk for r in chunks if r.shard == s) for s in {r.shard for r in chunks}}
    assert all(r.n_ids == 500 for r in chunks if r.chunk != last[r.shard]) and all(r.first == 500 * r.chunk for r in chunks)


def test_nothing(spark, none, tmp_path):
    path = str(tmp_path / "out")
    P.write(none, path, vocabulary())
    assert P.read_documents(spark, path).count() == 0 and P.read_ids(spark, path, 0, 5).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_hold_any_ids(kind):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (P.ids_of(P.planes(ids, kind), n) == ids).all()


def test_moved_parts_make_the_whole():
    rng = random.Random(2)
    for _ in range(50):
        text, out = rng.randbytes(rng.randint(1, 300)), 0
        cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(4))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            out ^= P.moved(zlib.crc32(text[a:b]), len(text) - b)
        assert out == zlib.crc32(text)


def test_words_get_the_ids_of_the_whole_text(tokenizer):
    rng, ids = random.Random(1), P.table(vocabulary())
    letters = "abXY  '.,1295\n\t\r\x0b\x00éß İǅ中😀​-_$€ sdm"
    for text in ["it's  John's", " lead", "a <|endoftext|> b", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(2000))]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.of(text) == struct.pack(f"<{len(want)}I", *want), repr(text)


def test_query(spark, data, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_tokens, r.ids_crc32, r.start) for r in QUERIES["op13_token_planes"](spark, data).collect()), key=lambda r: r[3])
    assert got == expected(rows, tokenizer)[0]
