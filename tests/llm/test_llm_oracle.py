import pytest
from oracle import DATA, compare, duck

from querymill.llm.oracle import ORACLE
from querymill.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_duckdb(spark, name):
    assert compare(QUERIES[name](spark, f"{DATA}/sf0.001"), duck("sf0.001"), ORACLE[name]) in ("", "no rows")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() >= 0
