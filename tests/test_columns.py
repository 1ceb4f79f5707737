import pytest
from pyspark.sql import functions as F

from cellsense.operators.columns import classify, subject_columns, subject_scores, values
from cellsense.plans.pipeline import analyse
from cellsense.sources.tables import read_json_records



ROWS = [("milan", "italy", "AB1", "1"), ("rome", "italy", "CD2", "2"), ("turin", "italy", "EF3", "3"), ("new york", "united states", "", "4"), ("paris", "france", "GH4", "5")]


@pytest.fixture(scope="module")
def cells(spark):
    return read_json_records(spark, [dict(zip(("name", "country", "code", "pop"), r, strict=True)) for r in ROWS], "t")


def test_classes_scores_and_subject(cells):
    cols = classify(values(cells, "value_raw"))
    assert {r.header: r.col_class for r in cols.collect()} == {"name": "NE", "country": "NE", "code": "NO_ANN", "pop": "LIT"}
    scores = {r.header: (r.emc, r.uc, r.aw, r.df, round(r.score, 5)) for r in subject_scores(cols).collect()}
    assert scores == {"name": (0, 1.0, 1.2, 0, 3.0), "country": (0, 0.6, 1.2, 1, 1.55563)}
    assert subject_columns(cols).first()[:2] == ("t", 0)


def test_whole_pipeline(cells):
    out = analyse(cells)
    assert out["subjects"].first().subject_col == 0
    assert out["cells"].where(F.col("header") == "name").count() == 5


def test_no_entity_column_gives_null(spark):
    t = read_json_records(spark, [{"a": "1"}, {"a": "2"}], "n")
    assert subject_columns(classify(values(t, "value_raw"))).first().subject_col is None
