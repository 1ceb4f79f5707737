"""The pipeline against plain versions of its stages."""

import corpus_pipeline
import pytest

from cellsense.llm import pii, quality_rules
from cellsense.llm.queries import PII_KEY


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [spark.read.parquet(f"{data}/documents.parquet"), *out]


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "PII", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_decisions_take_effect(stages):
    docs, ruled, single, private, mixed, packed = stages
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in ruled.collect()} == kept and len(kept) < docs.count()
    from test_pairs import brute

    want = brute([(r.doc_id, r.text) for r in ruled.collect()], 80, 5)
    assert {r.doc_id for r in single.collect()} == {i for i, (n, root) in want.items() if i == root or n == 0}
    before = {r.doc_id: r.text for r in single.collect()}
    after = {r.doc_id: r.text for r in private.collect()}
    assert set(before) == set(after) and any(before[i] != after[i] for i in before)
    assert after == {r.doc_id: r.text for r in pii.pseudonymise(single, PII_KEY).collect()}
    copies = mixed.groupBy("doc_id").count().collect()
    assert {r["count"] for r in copies} <= {1, 2} and {r.doc_id for r in copies} <= set(after)
    tokens = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in tokens) == 2048


def test_run_gives_the_last_stage(spark, data, stages):
    got = corpus_pipeline.run(spark, data)
    assert got.columns == stages[-1].columns and got.count() == stages[-1].count()
