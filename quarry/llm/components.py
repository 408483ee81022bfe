"""Connected components: of edge arrays inside a task, and of edge tables in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quarry.session import materialise


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of edges between 0 .. n - 1: at most n - 1 edges with the same components."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for nodes of ``a, b``.

    Alternates large and small stars (Kiveris et al., 2014). Neighbours are
    only ever reduced to a minimum, which is aggregated before the shuffle, so
    a node may have any number of them. Each round is a written table.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    e, seen = materialise(e.distinct(), "edges"), None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
                e.select("lo", "lo").distinct()
            )
        seen = mark
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialise(large.distinct(), "stars")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = materialise(small.union(low.select("hi", "m")).distinct(), "edges")
