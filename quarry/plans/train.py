"""Training a base model and judging it on the test set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry import constants as C
from quarry.operators.embedding import Model
from quarry.operators.evaluation import batch_mrr
from quarry.operators.ranking import batches
from quarry.operators.training import embed_pairs, fit
from quarry.session import materialise


def judge(
    sequences: DataFrame, model: Model, batch_size: int = C.EVALUATION_BATCH, seed: int = 0
) -> DataFrame:
    """MRR per language and, with a null language, over all batches.

    One pass: the per-batch scores are shared by both levels.
    """
    pairs = embed_pairs(sequences, model)
    scores = batch_mrr(
        batches(pairs, ["language"], "row_id", batch_size, seed), ["language", "batch_id"], "row_id"
    )
    return scores.rollup("language").agg(
        F.avg("mrr").alias("mrr"), F.count("*").alias("n_batches")
    )


def train(
    sequences: DataFrame, model: Model, evaluation_batch: int = C.EVALUATION_BATCH, **options
) -> tuple[Model, DataFrame, DataFrame]:
    """Fit on train, stop on valid, judge the best model on test.

    Returns the model, its history and its test scores.
    """
    sequences = materialise(sequences, "sequences")
    part = {name: sequences.filter(F.col("set") == name) for name in C.SPLIT_SHARES}
    best, history = fit(
        part["train"], part["valid"], model, evaluation_batch=evaluation_batch, **options
    )
    return best, history, judge(part["test"], best, evaluation_batch)
