"""Rows and the parameters of their scope in bounded groups."""

import re

import pyarrow as pa
import pytest
from pyspark import TaskContext

from quarry.operators.scopes import with_parameters


@pytest.fixture
def plain_joins(spark):
    """Joins by a shuffle, none of whose partitions are put together."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"]
    held = {name: spark.conf.get(name) for name in names}
    for name, value in zip(names, ["-1", "false", "16"]):
        spark.conf.set(name, value)
    yield
    for name, value in held.items():
        spark.conf.set(name, value)


def test_a_scope_is_not_one_task(spark, plain_joins):
    """Groups of one scope are spread over tasks, each with all of its parameters."""
    rows = spark.range(4000).selectExpr("id AS k", "if(id < 3900, 'big', 'small') AS scope")
    parameters = spark.range(30).selectExpr("if(id < 20, 'big', 'small') AS scope", "id AS p")

    def run(scope, group, own):
        task = TaskContext.get().partitionId()
        n = len(group)
        columns = [pa.array([scope] * n), group.column("k"), pa.array([len(own)] * n), pa.array([task] * n)]
        return pa.table(columns, ["scope", "k", "own", "task"])

    # A join by scope alone reads a whole scope in one task.
    found = with_parameters(rows, ["k"], parameters, run, "scope string, k long, own long, task long", 100)
    joins = re.findall(r"SortMergeJoin \[(.*?)\]", found._jdf.queryExecution().executedPlan().toString())
    assert joins and all("scope" in by and "_slot" in by for by in joins)
    table = found.toPandas()
    assert sorted(table.k) == list(range(4000))
    assert set(table[table.scope == "big"].own) == {20} and set(table[table.scope == "small"].own) == {10}
    assert table[table.scope == "big"].task.nunique() > 4
