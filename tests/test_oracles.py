import pytest

from mnemoflow.plans.oracles import ORACLES as ORACLE_SQL
from mnemoflow.plans.queries import QUERIES

from .oracle import oracle, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == oracle(ORACLE_SQL[name], sf_dir)


def test_recall_rows(spark, sf_dir):
    rows = QUERIES["recall"](spark, sf_dir).collect()
    assert rows and max(r["rank"] for r in rows) <= 11
    closed = QUERIES["evidence_closure"](spark, sf_dir).collect()
    assert {r.role for r in closed} <= {"Main", "GraphBridge", "LocalNeighbor"}
    assert all(len({r.idx for r in closed if r.query_id == q}) == len([r for r in closed if r.query_id == q]) for q in {r.query_id for r in closed})
