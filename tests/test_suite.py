"""Every registered query against its SQL on the smallest test tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from quarry.suite import all_queries, all_sql  # noqa: E402

FOLDER = os.environ.get("SUITE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, SQL = all_queries(), all_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)

    def plain(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return "null"
        return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)

    columns = [[plain(v) for v in table.column(n).to_pylist()] for n in names]
    return names, sorted(zip(*columns))


def test_keys():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"fit_encoder"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    query = QUERIES[name](spark, FOLDER)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    found = query.toArrow()
    assert rows(found) == rows(connection.execute(SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
