"""Queries per day, kept up to date as the query log grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_counts(log: DataFrame, ts: str = "created_at", late: str = "1 day") -> DataFrame:
    """Per-day counts of a streaming log; a day closes once it is ``late`` past."""
    return (
        log.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.count("*").alias("n_logs"))
        .select(F.col("w.start").alias("day"), "n_logs")
    )
