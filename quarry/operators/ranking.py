"""Row numbers and top-k that hold when one group owns most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.session import materialise

_POSITION_BITS = 33  # layout of monotonically_increasing_id
_POSITION_MASK = (1 << _POSITION_BITS) - 1


def row_numbers(df: DataFrame, by: list[str], order: list, name: str = "row_index") -> DataFrame:
    """0-based position of every row inside its group, in ``order``.

    A window over a group would pull the whole group into one task. Here one
    range sort spreads any group over many tasks, the written result fixes
    each row's (task, position), and two small tables turn that into a
    position inside the group: rows before each task, and each group's first
    row. ``order`` must end in something unique; ``by`` must not be null.
    """
    place = F.monotonically_increasing_id()
    placed = materialise(df.orderBy(*by, *order).withColumn("_place", place), "placed")
    task = F.shiftright("_place", _POSITION_BITS)
    position = F.col("_place").bitwiseAND(F.lit(_POSITION_MASK))

    # One row per task of the sort: bounded by the number of partitions.
    per_task = placed.groupBy(task.alias("_task")).agg((F.max(position) + 1).alias("_rows"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(
        per_task.select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )

    def with_global(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_task", task).join(offsets, "_task").withColumn(
            "_global", F.col("_offset") + position
        )

    drop = ["_place", "_task", "_offset", "_global", "_start"]
    numbered = with_global(placed)
    if by:
        firsts = placed.groupBy(*by).agg(F.min("_place").alias("_place"))
        starts = materialise(
            with_global(firsts).select(*by, F.col("_global").alias("_start")), "starts"
        )
        numbered = numbered.join(starts, by)
    else:
        numbered = numbered.withColumn("_start", F.lit(0))
    return numbered.withColumn(name, (F.col("_global") - F.col("_start")).cast("long")).drop(*drop)


def top_k(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    k: int,
    spread_on: list[str],
    name: str = "rank",
    spread: int = 32,
) -> DataFrame:
    """The first ``k`` rows of each group with their 1-based rank.

    Two levels: each slice of a group keeps its own first ``k``, then at most
    ``spread * k`` rows per group meet in one task. Exact, whatever the skew.
    """
    slot = F.pmod(F.xxhash64(*spread_on), F.lit(spread))
    inner = Window.partitionBy(*by, "_slot").orderBy(*order)
    outer = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_slot", slot)
        .withColumn("_inner", F.row_number().over(inner))
        .filter(F.col("_inner") <= k)
        .withColumn(name, F.row_number().over(outer))
        .filter(F.col(name) <= k)
        .drop("_slot", "_inner")
    )


def batches(
    df: DataFrame, by: list[str], key: str, size: int, seed: int = 0, name: str = "batch_id"
) -> DataFrame:
    """Seeded shuffle into batches of exactly ``size``; the short rest is left out."""
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    numbered = row_numbers(df.withColumn("_shuffle", shuffled), by, ["_shuffle", key], "_row")
    full = df.groupBy(*by).agg(F.floor(F.count("*") / size).alias("_full"))
    return (
        numbered.join(full, by)
        .withColumn(name, F.floor(F.col("_row") / size).cast("int"))
        .filter(F.col(name) < F.col("_full"))
        .drop("_shuffle", "_row", "_full")
    )


def proportional_batches(
    df: DataFrame,
    by: str,
    key: str,
    batch_size: int,
    seed: int = 0,
    name: str = "batch_id",
    within: list[str] | None = None,
) -> DataFrame:
    """Spread every group evenly over all batches, so each batch mixes the
    groups in proportion to their sizes. With ``within``, batches are formed
    separately for each of its values."""
    within = within or []
    sizes = df.groupBy(*within, by).agg(F.count("*").alias("_group_rows"))
    if within:
        totals = df.groupBy(*within).agg(F.count("*").alias("_all_rows"))
        sizes = sizes.join(totals, within)
    else:
        sizes = sizes.withColumn("_all_rows", df.agg(F.count("*").alias("n")).scalar())
    sizes = sizes.withColumn("_batches", F.ceil(F.col("_all_rows") / batch_size))
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    groups = [*within, by]
    numbered = row_numbers(df.withColumn("_shuffle", shuffled), groups, ["_shuffle", key], "_row")
    return (
        numbered.join(sizes, groups)
        .withColumn(name, F.expr("_row * _batches div _group_rows").cast("int"))
        .drop("_shuffle", "_row", "_group_rows", "_all_rows", "_batches")
    )
