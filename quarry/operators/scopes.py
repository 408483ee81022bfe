"""Rows that meet the parameters of their scope, in groups of a bounded size."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.session import materialise

#: Slots in which the rows and the parameters of one scope meet their numbers.
SLOTS = 64


def with_parameters(
    rows: DataFrame,
    keys: list[str],
    parameters: DataFrame,
    function: Callable[[str, pa.Table, pa.Table], pa.Table],
    schema: str,
    group_rows: int,
) -> DataFrame:
    """``function(scope, rows, parameters)`` for groups of about ``group_rows`` rows of
    one scope. ``rows`` should be a written table, as it is read twice.

    A scope's rows are salted by their keys, so one that holds most rows is
    spread over many groups; each group gets the scope's parameters once,
    however many rows it has. Parameters of scopes without rows do not move;
    for one without parameters, the function gets an empty table.

    The numbers of groups are a small table by (scope, slot) and are met by both
    columns: a join by scope alone would bring a whole scope into one task, and
    its groups would stay there. The parameters are dealt evenly before they are
    copied, so that no task makes all copies of a scope.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64(F.lit("slot"), *keys), F.lit(SLOTS)).cast("int"))
    held = rows.groupBy("scope", "_slot").agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("scope"))
    parts = materialise(
        held.select("scope", "_slot", F.ceil(total / group_rows).cast("int").alias("_parts")), "parts"
    )
    salt = F.pmod(F.xxhash64(*keys), F.col("_parts")).cast("int")
    dealt = rows.join(parts, ["scope", "_slot"]).withColumn("_part", salt).drop("_parts", "_slot")
    copies = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")
    scopes = parts.groupBy("scope").agg(F.max("_parts").alias("_parts"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("_slot")
    columns = [F.col(f"`{name}`") for name in parameters.columns]
    even = parameters.withColumn("_slot", F.pmod(F.xxhash64(*columns), F.lit(SLOTS)).cast("int"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = (
        even.repartition(tasks, "scope", "_slot")
        .join(scopes.select("scope", "_parts", spread), ["scope", "_slot"])
        .select(*columns, copies)
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        scope = (left if len(left) else right).column("scope")[0].as_py()
        return function(scope, left.drop_columns(["_part"]), right.drop_columns(["_part"]))

    by = ["scope", "_part"]
    return dealt.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInArrow(run, schema)


def fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def take_columns(table: pa.Table, names: list[str]) -> list[pa.ChunkedArray]:
    return [table.column(name) for name in names]
