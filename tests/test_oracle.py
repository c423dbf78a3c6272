import pytest
from oracle import DATA, compare, duck

from querymill import plans

CON = duck("sf0.001")
QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_duckdb(spark, name):
    assert compare(QUERIES[name](spark, f"{DATA}/sf0.001"), CON, ORACLE[name]) in ("", "no rows")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0
