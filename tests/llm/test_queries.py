import pytest

from strandflow.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, same, name):
    same(spark, QUERIES[name], ORACLES[name])
