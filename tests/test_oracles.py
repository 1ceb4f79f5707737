import compare
import pytest

import __spark_entry__ as entry_points
from cellsense.plans import annotated, phase_queries, whole_tables  # noqa: F401 - they register their queries
from cellsense.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, con, data, name):
    assert compare.difference(spark, con, QUERIES[name], ORACLES[name], data) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).count() == 20
