"""Losses, batches, early stopping and fitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import ranking as R, training as K
from quarry.operators.embedding import initial_model
from quarry.plans import prepare as P
from quarry.session import materialise
from quarry.suite.common import rounded, table
from quarry.suite.evaluation import vector_pairs
from quarry.suite.search import MEANS
from quarry.suite.sequences import pair_documents
from quarry.suite.vocabulary import SIZE

BATCH = 64
PATIENCE = 3


def proportional_batches(spark, folder):
    vectors = table(spark, folder, "embeddings").select("label", "vec_id")
    return R.proportional_batches(vectors, "label", "vec_id", BATCH, seed=2)


def _batched(spark, folder):
    return R.proportional_batches(vector_pairs(spark, folder), "language", "vec_id", BATCH, seed=2)


def margin_loss(spark, folder):
    losses = K.margin_losses(_batched(spark, folder), ["batch_id"], "vec_id")
    return losses.select("batch_id", "vec_id", rounded(F.col("loss")).alias("loss"))


def mean_loss(spark, folder):
    found = K.mean_loss(_batched(spark, folder), ["batch_id"], "vec_id")
    return found.select(rounded(F.col("mean_loss")).alias("mean_loss"))


def _daily_scores(spark, folder):
    """A score series per event type: its mean value of each day."""
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return (
        table(spark, folder, "events")
        .groupBy("event_type", day.alias("epoch"))
        .agg(F.round(F.avg("value"), 4).alias("score"))
    )


def early_stopping(spark, folder):
    return K.early_stopping(_daily_scores(spark, folder), ["event_type"], PATIENCE)


def best_epoch(spark, folder):
    scores = _daily_scores(spark, folder)
    return scores.groupBy("event_type").agg(
        F.min_by("epoch", F.struct(-F.col("score"), "epoch")).alias("best_epoch"),
        F.max("score").alias("best_score"),
    )


def fit_encoder(spark, folder):
    """A few epochs on the conversation pairs; one row per epoch."""
    documents = materialise(pair_documents(spark, folder), "pairs")
    vocabulary = P.prepare_vocabularies(documents, SIZE)
    sequences = materialise(P.prepare_sequences(documents, "row_id", vocabulary), "sequences")
    model = initial_model(vocabulary, width=16)
    _, history = K.fit(
        sequences.filter("set = 'train'"), sequences.filter("set = 'valid'"), model,
        batch_size=128, rate=0.05, max_epochs=3, patience=2, evaluation_batch=10,
    )
    return history.select("epoch", "loss", "score")


QUERIES = {
    f.__name__: f
    for f in [proportional_batches, margin_loss, mean_loss, early_stopping, best_epoch, fit_encoder]
}

_NUMBERED = f"""numbered AS (
  SELECT label, vec_id, (
    (row_number() OVER (PARTITION BY label ORDER BY md5('2:' || vec_id), vec_id) - 1)
    * ceil((count(*) OVER ()) / {BATCH}e0)::BIGINT // (count(*) OVER (PARTITION BY label)))::INTEGER AS batch_id
  FROM embeddings)"""
_LOSSES = f"""{MEANS}, {_NUMBERED},
pairs AS (
  SELECT n.batch_id, n.vec_id, e.embedding::DOUBLE[] AS q,
    list_transform(list_zip(e.embedding, m.vec), lambda z: (z[1]::DOUBLE + z[2] * 3e0) / 4e0) AS c
  FROM numbered n JOIN embeddings e USING (vec_id) JOIN means m ON m.label = e.label),
units AS (
  SELECT batch_id, vec_id,
    list_transform(q, lambda x: x / (sqrt(list_dot_product(q, q)) + 1e-8)) AS q,
    list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-8)) AS c FROM pairs),
losses AS (
  SELECT a.batch_id, a.vec_id, greatest(0e0,
    1e0 - max(CASE WHEN a.vec_id = b.vec_id THEN list_dot_product(a.q, b.c) END)
    + max(CASE WHEN a.vec_id <> b.vec_id THEN greatest(list_dot_product(a.q, b.c), 0e0) ELSE 0e0 END)) AS loss
  FROM units a JOIN units b USING (batch_id) GROUP BY ALL)"""
_SCORES = """scores AS (
  SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS epoch,
    round(avg(value), 4) AS score FROM events GROUP BY ALL)"""

SQL = {
    "proportional_batches": f"WITH {_NUMBERED} SELECT label, vec_id, batch_id FROM numbered",
    "margin_loss": f"WITH {_LOSSES} SELECT batch_id, vec_id, round(loss, 6) + 0e0 AS loss FROM losses",
    "mean_loss": f"""
WITH {_LOSSES}
SELECT round(avg(x), 6) + 0e0 AS mean_loss FROM (SELECT avg(loss) AS x FROM losses GROUP BY batch_id)""",
    "early_stopping": f"""
WITH RECURSIVE {_SCORES},
placed AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY epoch) AS i FROM scores),
run AS (
  SELECT event_type, i, epoch, score AS best, epoch AS best_epoch, 0 AS misses FROM placed WHERE i = 1
  UNION ALL
  SELECT p.event_type, p.i, p.epoch, greatest(r.best, p.score),
    CASE WHEN p.score >= r.best THEN p.epoch ELSE r.best_epoch END,
    CASE WHEN p.score >= r.best THEN 0 ELSE r.misses + 1 END
  FROM run r JOIN placed p ON p.event_type = r.event_type AND p.i = r.i + 1
  WHERE r.misses < {PATIENCE})
SELECT event_type, arg_max(best_epoch, i) AS best_epoch, max(best) AS best_score, max(epoch) AS last_epoch,
  max(misses) >= {PATIENCE} AS stopped
FROM run GROUP BY event_type""",
    "best_epoch": f"""
WITH {_SCORES}
SELECT event_type, arg_max(epoch, score * 1e6 - epoch) AS best_epoch, max(score) AS best_score
FROM scores GROUP BY event_type""",
}
