"""Every query with SQL gives the same rows as DuckDB; the others run."""

import os

import pytest

from braidwork.plans import cluster_queries, core_queries, graph_queries, induction_queries, metric_queries, ontology_queries, record_queries, step_queries, store_queries, text_queries
from tests.compare import SMALL, connection, same

MODULES = (core_queries, cluster_queries, graph_queries, induction_queries, metric_queries, ontology_queries, record_queries, step_queries, store_queries, text_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are missing")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    same(QUERIES[name](spark, SMALL), SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    df.write.format("noop").mode("overwrite").save()
    assert df.columns
