"""Ranking quality: mean reciprocal rank and discounted cumulative gain."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry import constants as C
from quarry.functions import vectors as V
from quarry.operators.embedding import matrix
from quarry.operators.neighbours import DECIMALS, _unit
from quarry.operators.ranking import batches, row_numbers


def correct_ranks(pairs: DataFrame, by: list[str], key: str) -> DataFrame:
    """Rank of each query's own code among the codes of its batch.

    ``pairs`` has ``by`` (which names a batch of bounded size), ``key``,
    ``query_vec`` and ``code_vec``. Equal distances count against the query;
    a zero vector has no rank. One matrix product per batch, one row out per
    query.
    """
    selected = pairs.select(*by, key, "query_vec", "code_vec")
    schema = selected.drop("query_vec", "code_vec").withColumn("rank", F.lit(0).cast("long")).schema

    def ranks(table: pa.Table) -> pa.Table:
        distance = np.round(
            1.0 - _unit(matrix(table.column("query_vec"))) @ _unit(matrix(table.column("code_vec"))).T,
            DECIMALS,
        )
        own = np.diag(distance)[:, None]
        with np.errstate(invalid="ignore"):
            rank = (distance <= own).sum(axis=1)
        columns = [table.column(name).combine_chunks() for name in [*by, key]]
        return pa.Table.from_arrays([*columns, pa.array(rank, pa.int64())], [*by, key, "rank"])

    return selected.groupBy(*by).applyInArrow(ranks, schema).filter(F.col("rank") >= 1)


def batch_mrr(pairs: DataFrame, by: list[str], key: str) -> DataFrame:
    return correct_ranks(pairs, by, key).groupBy(*by).agg(F.avg(1.0 / F.col("rank")).alias("mrr"))


def mrr_by_language(
    pairs: DataFrame, key: str, batch_size: int = C.EVALUATION_BATCH, seed: int = 0
) -> DataFrame:
    """Mean over full batches; a language smaller than one batch has no row."""
    batched = batches(pairs, ["language"], key, batch_size, seed)
    return (
        batch_mrr(batched, ["language", "batch_id"], key)
        .groupBy("language")
        .agg(F.avg("mrr").alias("mrr"), F.count("*").alias("n_batches"))
    )


def mrr(
    pairs: DataFrame,
    key: str,
    batch_size: int = C.EVALUATION_BATCH,
    seed: int = 0,
    owner: list[str] | None = None,
) -> DataFrame:
    """Mean over all batches of all languages, not over languages; one value
    per ``owner`` (a model's repository) if given."""
    owner = owner or []
    batched = batches(pairs, [*owner, "language"], key, batch_size, seed)
    return (
        batch_mrr(batched, [*owner, "language", "batch_id"], key)
        .groupBy(*owner)
        .agg(F.avg("mrr").alias("mrr"), F.count("*").alias("n_batches"))
    )


def gains(predictions: DataFrame, relevance: DataFrame) -> DataFrame:
    """DCG per (language, query) that has annotations.

    ``predictions`` has language, query, url and a 1-based ``rank`` that
    counts unannotated and repeated urls too.
    """
    hits = relevance.join(predictions, ["language", "query", "url"], "left")
    gain = F.when(F.col("rank").isNotNull(), V.rank_gain(F.col("relevance"), F.col("rank")))
    return hits.groupBy("language", "query").agg(
        F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg")
    )


def ideal_gains(relevance: DataFrame) -> DataFrame:
    """IDCG over all annotated urls, best first.

    Ranks come from the distributed numbering, since one query may own a
    large part of the annotations.
    """
    ranked = row_numbers(
        relevance, ["language", "query"], [F.col("relevance").desc(), "url"], "place"
    )
    return ranked.groupBy("language", "query").agg(
        F.sum(V.rank_gain(F.col("relevance"), F.col("place") + 1)).alias("idcg")
    )


def ndcg_by_query(predictions: DataFrame, relevance: DataFrame) -> DataFrame:
    """DCG over IDCG; queries without any positive annotation are left out."""
    return (
        gains(predictions, relevance)
        .join(ideal_gains(relevance), ["language", "query"])
        .filter(F.col("idcg") > 0)
        .withColumn("ndcg", F.col("dcg") / F.col("idcg"))
    )


def ndcg_by_language(predictions: DataFrame, relevance: DataFrame) -> DataFrame:
    return (
        ndcg_by_query(predictions, relevance)
        .groupBy("language")
        .agg(F.avg("ndcg").alias("ndcg"), F.count("*").alias("n_queries"))
    )


def mean_ndcg(predictions: DataFrame, relevance: DataFrame) -> DataFrame:
    return ndcg_by_language(predictions, relevance).agg(F.avg("ndcg").alias("mean_ndcg"))


def url_lists(predictions: DataFrame) -> DataFrame:
    """Predicted urls of each (language, query), best first; at most the
    number of requested neighbours per list."""
    return predictions.groupBy("language", "query").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]
        ).alias("urls")
    )
