"""Embedding near-duplicates by int8 tile products with error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.components import components, forest
from quarry.session import materialise

#: Distinct vectors in one side of a tile.
TILE_ROWS = 2048
#: Room for rounding in double precision, added to every bound.
ROUNDING = 1e-9


def usable(vector: Column) -> Column:
    """Not null, and no component null, infinite or not a number."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales and the norms of what the codes leave of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - scale[:, None] * codes
    return codes, scale, np.sqrt((rest * rest).sum(axis=1)) + ROUNDING


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b with a cosine of at least the threshold.

    With u = s q + e and w = t p + f, the product of the codes is off by at
    most |e| |w| + |s q| |f|, which is |e| + (1 + |e|) |f| for unit rows. Only
    pairs that reach the threshold with that bound are computed in double
    precision, from the vectors themselves.
    """
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    qa, sa, ea = quantise(a / na[:, None])
    qb, sb, eb = quantise(b / nb[:, None])
    # Sums of int8 products are whole numbers, exact in single precision up to 2**24.
    kind = np.float32 if 127 * 127 * a.shape[1] < 1 << 24 else np.float64
    rows, cols = [], []
    right = qb.astype(kind).T
    for i in range(0, len(a), 256):
        part = slice(i, i + 256)
        product = (qa[part].astype(kind) @ right).astype(np.float64) * sa[part, None] * sb[None, :]
        bound = ea[part, None] + (1 + ea[part, None]) * eb[None, :] + ROUNDING
        x, y = np.nonzero(product >= threshold - bound)
        for j in range(0, len(x), 1 << 16):
            p, q = x[j : j + (1 << 16)] + i, y[j : j + (1 << 16)]
            sure = (a[p] * b[q]).sum(axis=1) / (na[p] * nb[q]) >= threshold
            rows.append(p[sure])
            cols.append(q[sure])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def near_duplicates(
    df: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` of every row of ``df``.

    Rows link when labels are equal and not null and the cosine is at least
    ``threshold``. Vectors that are null, empty, zero or hold null or
    non-finite components, vectors of different lengths, and rows without an id
    or label link with nothing (component: themselves). Equal vectors of a
    label are compared once, with their number as weight; repeated rows count
    as rows. An empty table gives an empty one. Ids are integers.

    A label is cut into blocks of about ``tile_rows`` distinct vectors and each
    pair of blocks is one tile, so a label with a third of all rows is spread
    over many tasks. A tile returns a number of links for each row and at most
    one edge less than its rows, never the pairs.
    """
    vector = F.transform("vector", lambda x: x.cast("double"))
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")
    ).withColumn("vector", vector)
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    fit = usable(F.col("vector")) & F.col("id").isNotNull() & F.col("label").isNotNull()
    rows = rows.withColumn("fit", F.when(fit, length > 0).otherwise(F.lit(False)))
    good = rows.where("fit")
    distinct = materialise(
        good.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("weight")),
        "vectors",
    )
    sizes = distinct.groupBy("label", F.size("vector").alias("width")).agg(
        F.ceil(F.count("*") / tile_rows).cast("int").alias("blocks")
    )
    placed = (
        distinct.withColumn("width", F.size("vector"))
        .join(sizes, ["label", "width"])
        .withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "label", "width", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            "block", "rep", "weight", "vector",
        )
    )

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        first = group[group["block"] == i]
        second = group[group["block"] == j]
        if not len(first) or not len(second):
            return pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")
        x, y = similar(np.stack(first["vector"].to_numpy()), np.stack(second["vector"].to_numpy()), threshold)
        ra, wa = first["rep"].to_numpy(), first["weight"].to_numpy()
        rb, wb = second["rep"].to_numpy(), second["weight"].to_numpy()
        if i == j:
            x, y = x[x != y], y[x != y]
            ends, child_root = np.bincount(x, wb[y], len(ra)), forest(x, y, len(ra))
            reps, counts = ra, ends
        else:
            counts = np.concatenate([np.bincount(x, wb[y], len(ra)), np.bincount(y, wa[x], len(rb))])
            reps, child_root = np.concatenate([ra, rb]), forest(x, len(ra) + y, len(ra) + len(rb))
        some = counts > 0
        child, root = child_root
        return pd.DataFrame({
            "a": np.concatenate([reps[some], reps[child]]),
            "b": np.concatenate([reps[some], reps[root]]),
            "links": np.concatenate([counts[some].astype(np.int64), np.zeros(len(child), np.int64)]),
        })

    found = materialise(
        placed.groupBy("label", "width", "i", "j").applyInPandas(tile, "a long, b long, links long"), "tiles"
    )
    linked = found.where("a = b").groupBy("a").agg(F.sum("links").alias("others"))
    member = components(found.select("a", "b"))
    classes = (
        distinct.join(linked, distinct["rep"] == linked["a"], "left")
        .join(member, distinct["rep"] == member["node"], "left")
        .select(
            "label", "vector",
            (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked_rows = good.join(classes, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where("not fit").select("id", F.lit(0).cast("long"), "id")
    return linked_rows.union(alone).select(
        F.col("id").alias(id_col),
        F.col("n_links").cast("long").alias("n_links"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
