import pytest

from millrace.llm.queries import ORACLES, QUERIES

from ..oracle import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    check(spark, con, QUERIES[name], ORACLES[name], SF)
