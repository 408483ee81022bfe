"""Ranking quality over vectors, predictions and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions import vectors as V
from quarry.operators import evaluation as E, ranking as R
from quarry.plans import search as P
from quarry.suite.common import joined, rounded, table
from quarry.suite.search import (
    CODE_VECTORS, MEANS, QUERY_VECTORS, SPACE, document_vectors, model, sql_distance, sql_top,
    _with_means,
)
from quarry.suite.common import documents
from quarry.suite.vocabulary import both_vocabularies

BATCH = 20


def vector_pairs(spark, folder):
    """Each vector as a query, its middle with the label's mean as the code."""
    middle = F.zip_with("embedding", "mean", lambda a, b: (a.cast("double") + b * 3.0) / 4.0)
    return _with_means(spark, folder).select(
        F.col("label").alias("language"),
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("query_vec"),
        middle.alias("code_vec"),
    )


def evaluation_batches(spark, folder):
    pairs = vector_pairs(spark, folder).select("language", "vec_id")
    return R.batches(pairs, ["language"], "vec_id", BATCH, seed=1)


def correct_rank(spark, folder):
    pairs = R.batches(vector_pairs(spark, folder), ["language"], "vec_id", BATCH, seed=1)
    return E.correct_ranks(pairs, ["language", "batch_id"], "vec_id")


def mrr(spark, folder):
    found = E.mrr(vector_pairs(spark, folder), "vec_id", BATCH, seed=1)
    return found.select(rounded(F.col("mrr")).alias("mrr"), "n_batches")


def mrr_by_language(spark, folder):
    found = E.mrr_by_language(vector_pairs(spark, folder), "vec_id", BATCH, seed=1)
    return found.select("language", rounded(F.col("mrr")).alias("mrr"), "n_batches")


def _predicted(spark, folder, k=C.EVALUATION_RESULTS):
    """Text queries against all documents, as deep as the evaluation goes."""
    vocabulary = both_vocabularies(spark, folder)
    queries = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    items = document_vectors(spark, folder, vocabulary).select(
        "language", F.col("doc_id").alias("row_index"), "embedding"
    )
    docs = documents(spark, folder).select(
        "language", F.col("doc_id").alias("row_index"), "identifier", F.col("path").alias("url")
    )
    found = P.predict(queries, items, docs, vocabulary, model(spark, folder), k)
    return found.select(F.col("query_id").alias("query"), "language", "identifier", "url", "rank")


def search_cli(spark, folder):
    """The command line's depth: 30 documents of every language."""
    return _predicted(spark, folder, C.CLI_RESULTS)


def predictions(spark, folder):
    return _predicted(spark, folder)


def url_lists(spark, folder):
    found = E.url_lists(_predicted(spark, folder))
    return found.select("language", "query", joined(F.col("urls")).alias("urls"))


def _relevance(spark, folder):
    """Each labelled document is annotated for one of the text queries."""
    n = table(spark, folder, "benchmark").agg(F.count("*").alias("n")).scalar()
    labels = table(spark, folder, "labels")
    docs = documents(spark, folder).select("doc_id", "language", F.col("path").alias("url"))
    return labels.join(docs, "doc_id").select(
        "language",
        (F.col("doc_id") % n).alias("query"),
        "url",
        (F.col("quality") * 2 + F.col("toxic")).cast("double").alias("relevance"),
    )


def dcg(spark, folder):
    found = E.gains(_predicted(spark, folder), _relevance(spark, folder))
    return found.select("language", "query", rounded(F.col("dcg")).alias("dcg"))


def idcg(spark, folder):
    found = E.ideal_gains(_relevance(spark, folder))
    return found.select("language", "query", rounded(F.col("idcg")).alias("idcg"))


def ndcg_by_query(spark, folder):
    found = E.ndcg_by_query(_predicted(spark, folder), _relevance(spark, folder))
    return found.select("language", "query", rounded(F.col("ndcg")).alias("ndcg"))


def ndcg(spark, folder):
    found = E.ndcg_by_language(_predicted(spark, folder), _relevance(spark, folder))
    return found.select("language", rounded(F.col("ndcg")).alias("ndcg"), "n_queries")


def mean_ndcg(spark, folder):
    found = E.mean_ndcg(_predicted(spark, folder), _relevance(spark, folder))
    return found.select(rounded(F.col("mean_ndcg")).alias("mean_ndcg"))


QUERIES = {
    f.__name__: f
    for f in [
        evaluation_batches, correct_rank, mrr, mrr_by_language, predictions, search_cli, url_lists, dcg, idcg,
        ndcg_by_query, ndcg, mean_ndcg,
    ]
}

PAIRS = f"""{MEANS},
vector_pairs AS (
  SELECT label AS language, vec_id, embedding::DOUBLE[] AS q,
    list_transform(list_zip(embedding, vec), lambda z: (z[1]::DOUBLE + z[2] * 3e0) / 4e0) AS c
  FROM embeddings JOIN means USING (label)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY language ORDER BY md5('1:' || vec_id), vec_id) - 1 AS rn,
    count(*) OVER (PARTITION BY language) AS n FROM vector_pairs),
batched AS (
  SELECT *, (rn // {BATCH})::INTEGER AS batch_id FROM numbered WHERE rn // {BATCH} < n // {BATCH}),
ranks AS (
  SELECT a.language, a.batch_id, a.vec_id,
    count(*) FILTER ({sql_distance('a.q', 'b.c')} <= {sql_distance('a.q', 'a.c')}) AS rank
  FROM batched a JOIN batched b ON a.language = b.language AND a.batch_id = b.batch_id GROUP BY ALL),
per_batch AS (SELECT language, batch_id, avg(1e0 / rank) AS mrr FROM ranks GROUP BY ALL)"""

PREDICTED = f"""{SPACE}, {CODE_VECTORS}, {QUERY_VECTORS},
pairs AS (
  SELECT q.query_id, d.language, d.doc_id AS row_index, d.identifier, d.path AS url,
    {sql_distance('q.vec', 'v.vec')} AS distance
  FROM query_vec q, code_vec v JOIN docs d ON d.doc_id = v.doc_id),
predicted AS (
  SELECT query_id AS query, language, identifier, url, rank FROM (
    {sql_top("(SELECT * FROM pairs WHERE NOT isnan(distance))", C.EVALUATION_RESULTS)}))"""

RELEVANCE = """relevance AS (
  SELECT language, doc_id % (SELECT count(*) FROM benchmark) AS query, path AS url,
    quality * 2e0 + toxic AS relevance
  FROM labels JOIN docs USING (doc_id))"""
_GAIN = "(power(2e0, relevance) - 1e0) / log2({} + 1e0)"
GAINS = f"""{RELEVANCE},
gains AS (
  SELECT r.language, r.query, coalesce(sum(CASE WHEN rank IS NOT NULL THEN {_GAIN.format('rank')} END), 0e0) AS dcg
  FROM relevance r LEFT JOIN predicted p USING (language, query, url) GROUP BY ALL),
ideal AS (
  SELECT language, query, sum({_GAIN.format('place')}) AS idcg FROM (
    SELECT *, row_number() OVER (PARTITION BY language, query ORDER BY relevance DESC, url) AS place FROM relevance)
  GROUP BY ALL),
scored AS (
  SELECT language, query, dcg / idcg AS ndcg FROM gains JOIN ideal USING (language, query) WHERE idcg > 0)"""

SQL = {
    "evaluation_batches": f"WITH {PAIRS} SELECT language, vec_id, batch_id FROM batched",
    "correct_rank": f"WITH {PAIRS} SELECT * FROM ranks",
    "mrr": f"WITH {PAIRS} SELECT round(avg(mrr), 6) + 0e0 AS mrr, count(*) AS n_batches FROM per_batch",
    "mrr_by_language": f"""
WITH {PAIRS}
SELECT language, round(avg(mrr), 6) + 0e0 AS mrr, count(*) AS n_batches FROM per_batch GROUP BY language""",
    "predictions": f"WITH RECURSIVE {PREDICTED} SELECT * FROM predicted",
    "search_cli": f"WITH RECURSIVE {PREDICTED} SELECT * FROM predicted WHERE rank <= {C.CLI_RESULTS}",
    "url_lists": f"""
WITH RECURSIVE {PREDICTED}
SELECT language, query, string_agg(url, '|' ORDER BY rank) AS urls FROM predicted GROUP BY ALL""",
    "dcg": f"""
WITH RECURSIVE {PREDICTED}, {GAINS} SELECT language, query, round(dcg, 6) + 0e0 AS dcg FROM gains""",
    "idcg": f"""
WITH RECURSIVE {PREDICTED}, {GAINS} SELECT language, query, round(idcg, 6) + 0e0 AS idcg FROM ideal""",
    "ndcg_by_query": f"""
WITH RECURSIVE {PREDICTED}, {GAINS} SELECT language, query, round(ndcg, 6) + 0e0 AS ndcg FROM scored""",
    "ndcg": f"""
WITH RECURSIVE {PREDICTED}, {GAINS}
SELECT language, round(avg(ndcg), 6) + 0e0 AS ndcg, count(*) AS n_queries FROM scored GROUP BY language""",
    "mean_ndcg": f"""
WITH RECURSIVE {PREDICTED}, {GAINS}
SELECT round(avg(x), 6) + 0e0 AS mean_ndcg FROM (SELECT avg(ndcg) AS x FROM scored GROUP BY language)""",
}
