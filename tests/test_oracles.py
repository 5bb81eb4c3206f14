import pytest

from millrace.plans.queries import ORACLES, QUERIES

from .oracle import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    check(spark, con, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_rows_without_sql(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(r["error"] is None for r in rows if "error" in r)
