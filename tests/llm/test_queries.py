import compare
import pytest

from cellsense.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, data, name):
    assert compare.difference(spark, compare.connect(data), QUERIES[name], ORACLES[name], data) == ""


def test_all_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
