import datetime
import random

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank and very long texts, repeated rows, copies, and columns whose names clash with inner ones."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(120)
    rows = [(i, text(rng.randint(1, 300)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, " \t\n", None, "s1", 3), (None, text(80), "de", None, 1), (103, text(40_000), "en", "s2", 1), (104, "x" * 120_000, "en", "s2", 1)]
    rows += [(110, base, "en", "s0", 1), (111, base, "en", "s0", 1), (112, base + " end", "en", "s1", 1), (113, base, "en", "s0", 1), (113, base, "en", "s0", 1), (114, "two words", "en", "s1", 1), (115, "two words", "en", "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("size", "_size", "copies", "cid", "root", "_id", "_null", "stays", "kept", "_slot", "shard", "label", "count"):
        df = df.selectExpr("*", f"'{c}' as `{c}`")
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def today():
    return datetime.date(2024, 2, 29)
