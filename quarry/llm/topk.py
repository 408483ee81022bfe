"""Exact top-k inner products in three phases with a uniform threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.embedding_dedup import usable
from quarry.session import materialise

#: Candidates and queries of one tile, queries multiplied at a time, and slices
#: of the components whose partial scores are the local lists.
TILE_ROWS, TILE_QUERIES, STEP, SLICES = 16_384, 4_096, 128, 4


def integer_vector(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of each component x, taken as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))


def partial_scores(queries: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Exact inner products over each slice of the components."""
    high = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    # Whole numbers below 2**53 are exact in double precision.
    kind = np.float64 if high < 1 << 53 else np.int64
    cuts = np.array_split(np.arange(rows.shape[1]), min(SLICES, rows.shape[1]))
    return [(queries[:, c].astype(kind) @ rows[:, c].astype(kind).T).astype(np.int64) for c in cuts]


LOWEST = np.iinfo(np.int64).min


def local_lists(parts: list[np.ndarray], own: np.ndarray, k: int) -> np.ndarray:
    """Per query the k best totals among the entries that lead a list (phase 1)."""
    total = sum(parts)
    total[own] = LOWEST
    k = min(k, total.shape[1])
    lead = np.zeros(total.shape, bool)
    for part in parts:
        part = np.where(own, LOWEST, part)
        top = np.argpartition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k :]
        np.put_along_axis(lead, top, True, axis=1)
    seen = np.where(lead, total, LOWEST)
    return -np.sort(-np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k :], axis=1)


def sufficient(parts: list[np.ndarray], own: np.ndarray, cutoff: np.ndarray, ids: np.ndarray, k: int):
    """Query rows, columns and totals of entries that may be among the best k (2 and 3).

    A total of at least the cutoff has a list with at least its m-th part, so
    only entries that reach that part in some list are resolved.
    """
    part_cut = -(-cutoff // len(parts)) if len(parts) > 1 else cutoff
    enough = np.zeros(parts[0].shape, bool)
    for part in parts:
        enough |= part >= part_cut[:, None]
    x, y = np.nonzero(enough & ~own)
    total = sum(part[x, y] for part in parts)
    keep = total >= cutoff[x]
    x, y, total = x[keep], y[keep], total[keep]
    order = np.lexsort((ids[y], -total, x))
    x, y, total = x[order], y[order], total[order]
    first = np.searchsorted(x, x)
    keep = np.arange(len(x)) - first < k
    return x[keep], y[keep], total[keep]


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    factor: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, id_col, score``: for each query the ``k`` highest integer
    inner products over all other rows (all, if fewer), ties to the smaller id.

    Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows without an id; an id that is repeated counts once, with
    its smallest vector. Vectors of different lengths are not compared. An
    empty table gives an empty one. Other columns are not read.

    Queries meet candidates in tiles. Phase 1: in each tile, slices of the
    components give local score lists, and the totals of their leaders are
    gathered; the k-th best of a query is a safe cutoff, since k rows reach it.
    Phase 2: the cutoffs go back to the tiles, as a table joined by query, and
    a tile takes the entries of which some list has an equal share of it.
    Phase 3: their scores are resolved exactly and the best k are kept.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    rows = rows.groupBy("id").agg(F.min(F.struct(integer_vector(F.col("v"), factor).alias("v"), "q")).alias("r"))
    rows = materialise(
        rows.select("id", F.col("r.v").alias("v"), F.size("r.v").alias("width"), F.col("r.q").alias("q")), "rows"
    )
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    tiles, blocks = -(-n // TILE_ROWS) or 1, -(-n_queries // TILE_QUERIES) or 1

    def dealt(cut: DataFrame | None):
        # Keys of both sides are ints: rows meet by the hash of the typed value.
        hashed = F.xxhash64("id")
        left = rows.select(
            "width", F.pmod(hashed, F.lit(tiles)).cast("int").alias("tile"), "id", "v",
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        )
        right = rows.where("q")
        right = right.withColumn("cutoff", F.lit(None).cast("long")) if cut is None else right.join(cut, "id", "left")
        right = right.select(
            "width", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "id", "v", "cutoff",
            F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(blocks)).cast("int").alias("block"),
        )
        keys = ["width", "tile", "block"]
        # Both sides read one table: new names for columns keep them apart.
        left, right = left.toDF(*left.columns), right.toDF(*right.columns)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys))

    def steps(left: pd.DataFrame, right: pd.DataFrame):
        if not len(left) or not len(right):
            return
        ids, matrix = left["id"].to_numpy(), np.stack(left["v"].to_numpy())
        queries = np.stack(right["v"].to_numpy())
        for i in range(0, len(right), STEP):
            part = right.iloc[i : i + STEP]
            asked = part["id"].to_numpy()
            yield ids, part, asked, partial_scores(queries[i : i + STEP], matrix), asked[:, None] == ids[None, :]

    def gather(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        asked, scores = [], []
        for _, _, own, parts, same in steps(left, right):
            best = local_lists(parts, same, k)
            asked.append(np.repeat(own, best.shape[1]))
            scores.append(best.ravel())
        out = pd.DataFrame({
            "id": np.concatenate(asked) if asked else np.zeros(0, np.int64),
            "score": np.concatenate(scores) if scores else np.zeros(0, np.int64),
        })
        return out[out["score"] > LOWEST]

    def resolve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, part, asked, parts, same in steps(left, right):
            # Fewer than k leaders: every entry is sufficient.
            cut = part["cutoff"].astype("Int64").fillna(-(1 << 62)).to_numpy(np.int64)
            x, y, total = sufficient(parts, same, cut, ids, k)
            out.append(pd.DataFrame({"query_id": asked[x], "id": ids[y], "score": total}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []}, dtype="int64")

    lists = dealt(None).applyInPandas(gather, "id long, score long")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score")))
    cut = lists.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k)
    cut = materialise(cut.select("id", F.col("score").alias("cutoff")), "cutoffs")
    found = dealt(cut).applyInPandas(resolve, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return (
        found.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
