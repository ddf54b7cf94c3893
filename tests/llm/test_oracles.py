import pytest

from mnemoflow.llm.queries import ORACLE_SQL, QUERIES

from .oracle import oracle, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == oracle(ORACLE_SQL[name], sf_dir)
