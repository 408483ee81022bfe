"""Counting, n-grams and vocabularies of the code corpus and the queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry import constants as C
from quarry.operators import vocabulary as K
from quarry.session import materialise, shared_folder
from quarry.sources.catalogue import save_table
from quarry.suite.common import CODE_DOCS, TEXT_QUERIES, code_documents, quote, text_queries

# Ids past the vector table have no vector and no weight in an embedding.
SIZE = QUERY_SIZE = C.VOCABULARY_SIZE


def code_counts(spark, folder):
    return K.token_counts(code_documents(spark, folder))


def query_counts(spark, folder):
    return K.token_counts(text_queries(spark, folder))


def code_vocabulary(spark, folder):
    return K.fit_vocabulary(code_counts(spark, folder), SIZE)


def query_vocabulary(spark, folder):
    return K.fit_vocabulary(query_counts(spark, folder), QUERY_SIZE)


def both_vocabularies(spark, folder):
    """The code scopes and the query scope in one vocabulary table."""
    counts = code_counts(spark, folder).unionByName(query_counts(spark, folder))
    return K.fit_vocabulary(counts, SIZE)


def token_counts(spark, folder):
    return code_counts(spark, folder)


def query_token_counts(spark, folder):
    """Pooled over all languages: code documents' words and typed queries."""
    pooled = code_documents(spark, folder).select(F.lit("query").alias("scope"), "tokens")
    return K.token_counts(pooled.unionByName(text_queries(spark, folder).select("scope", "tokens")))


def _oov(spark, folder):
    counts = materialise(code_counts(spark, folder), "counts")
    words = materialise(K.word_vocabulary(counts, SIZE, C.BPE_SHARE), "words")
    return K.out_of_vocabulary(counts, words)


def oov_words(spark, folder):
    return _oov(spark, folder)


def ngram_counts(spark, folder):
    return K.ngram_counts(_oov(spark, folder))


def top_ngrams(spark, folder):
    return K.most_common(K.ngram_counts(_oov(spark, folder)), "ngram", 10 * SIZE)


def word_vocab(spark, folder):
    counts = materialise(code_counts(spark, folder), "counts")
    return K.word_vocabulary(counts, SIZE, C.BPE_SHARE)


#: Words that a vocabulary must hold; not all of them are in the texts.
REQUIRED = ["the", "def", "a-token-of-no-text"]


def required_vocab(spark, folder):
    """Words with required ones first, and the pieces that follow their share."""
    return K.fit_vocabulary(code_counts(spark, folder), SIZE, required=REQUIRED)


def stored_vocab(spark, folder):
    """The vocabulary of the code, written and read."""
    path = f"{shared_folder(spark)}/vocabulary-{uuid.uuid4().hex}"
    save_table(code_vocabulary(spark, folder), path)
    return spark.read.parquet(path)


def bpe_vocab(spark, folder):
    return code_vocabulary(spark, folder).filter("kind = 'bpe'")


def threshold_vocab(spark, folder):
    counts = materialise(code_counts(spark, folder), "counts")
    return K.threshold_vocabulary(counts, SIZE, 10)


def _pooled(spark, folder):
    docs = code_documents(spark, folder).select(F.lit("query").alias("scope"), "tokens")
    return K.fit_vocabulary(K.token_counts(docs), SIZE)


def merge_vocab(spark, folder):
    """The queries' vocabulary appended to one pooled over all documents."""
    merged = K.merge_vocabularies(_pooled(spark, folder), query_vocabulary(spark, folder))
    return merged.select("scope", "kind", "token", "id", "count").orderBy("scope", "id")


def new_tokens(spark, folder):
    return K.additional_tokens(_pooled(spark, folder), query_vocabulary(spark, folder)).select(
        "scope", "kind", "token"
    )


QUERIES = {
    f.__name__: f
    for f in [
        token_counts, query_token_counts, oov_words, ngram_counts, top_ngrams, word_vocab,
        bpe_vocab, threshold_vocab, merge_vocab, new_tokens, required_vocab, stored_vocab,
    ]
}


# --- The same in SQL ------------------------------------------------------------


def sql_counts(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT scope, token, count(*) AS count
  FROM (SELECT scope, unnest(tokens) AS token FROM {source}) GROUP BY scope, token)"""


def sql_vocabulary(p: str, counts: str, size: int, share: float = C.BPE_SHARE, required: tuple = ()) -> str:
    """CTEs ``{p}words, {p}oov, {p}grams, {p}bpe, {p}vocab`` from a counts CTE."""
    pad, unk, sow, eow = (quote(x) for x in (C.PAD, C.UNK, C.SOW, C.EOW))
    n = 2 + len(required)
    first = max(int(size * (1 - share)), n)
    others = "".join(
        f"\n  UNION ALL SELECT DISTINCT scope, 'word', {quote(x)}, {i}, 2147483648 FROM {counts}"
        for i, x in enumerate(sorted(required), 2)
    )
    reserved = ", ".join([pad, unk, *map(quote, required)])
    return f"""{p}words AS (
  SELECT DISTINCT scope, 'word' AS kind, {pad} AS token, 0 AS id, 4294967296 AS count FROM {counts}
  UNION ALL SELECT DISTINCT scope, 'word', {unk}, 1, 2147483648 FROM {counts}{others}
  UNION ALL SELECT scope, 'word', token, rn + {n - 1}, count FROM (
    SELECT *, row_number() OVER (PARTITION BY scope ORDER BY count DESC, token) AS rn
    FROM {counts} WHERE token NOT IN ({reserved})) WHERE rn <= {first - n}),
{p}oov AS (
  SELECT c.* FROM {counts} c WHERE NOT EXISTS (
    SELECT 1 FROM {p}words w WHERE w.scope = c.scope AND w.token = c.token)),
{p}spans AS (
  SELECT scope, token, count, start, unnest(range(1, least({C.NGRAM_MAX}, length(token) - start + 1) + 1)) AS size
  FROM (SELECT *, unnest(range(1, length(token) + 1)) AS start FROM {p}oov)),
{p}grams AS (
  SELECT scope, substr(token, start, size) AS ngram, sum(count)::BIGINT AS count FROM {p}spans
  WHERE NOT regexp_matches(substr(token, start, size), '[\\s\\x0b]') GROUP BY ALL),
{p}bpe AS (
  SELECT DISTINCT scope, 'bpe' AS kind, {sow} AS token, {first} AS id, 9223372036854775807 AS count FROM {counts}
  UNION ALL SELECT DISTINCT scope, 'bpe', {eow}, {first + 1}, 9223372036854775807 FROM {counts}
  UNION ALL SELECT scope, 'bpe', ngram, rn + {first + 1}, count FROM (
    SELECT *, row_number() OVER (PARTITION BY scope ORDER BY count DESC, ngram) AS rn
    FROM {p}grams WHERE ngram NOT IN ({sow}, {eow})) WHERE rn <= {size - first - 2}),
{p}vocab AS (SELECT * FROM {p}words UNION ALL SELECT * FROM {p}bpe)"""


CODE_VOCAB = ",\n".join(
    [CODE_DOCS, sql_counts("code_counts", "code_docs"), sql_vocabulary("c_", "code_counts", SIZE)]
)
_POOLED_DOCS = "pooled_docs AS (SELECT 'query' AS scope, tokens FROM code_docs)"
_MERGE = ",\n".join(
    [
        CODE_DOCS, _POOLED_DOCS, TEXT_QUERIES,
        sql_counts("base_counts", "pooled_docs"), sql_vocabulary("b_", "base_counts", SIZE),
        sql_counts("query_counts", "text_queries"), sql_vocabulary("q_", "query_counts", QUERY_SIZE),
        """extra AS (SELECT * FROM q_vocab q WHERE NOT EXISTS (
  SELECT 1 FROM b_vocab b WHERE b.kind = q.kind AND b.token = q.token))""",
    ]
)

SQL = {
    "token_counts": f"WITH {CODE_DOCS}, {sql_counts('n', 'code_docs')} SELECT * FROM n",
    "query_token_counts": f"""
WITH {CODE_DOCS}, {TEXT_QUERIES},
pooled AS (SELECT 'query' AS scope, tokens FROM code_docs UNION ALL SELECT scope, tokens FROM text_queries),
{sql_counts('n', 'pooled')} SELECT * FROM n""",
    "oov_words": f"WITH {CODE_VOCAB} SELECT scope, token, count FROM c_oov",
    "ngram_counts": f"WITH {CODE_VOCAB} SELECT * FROM c_grams",
    "top_ngrams": f"""
WITH {CODE_VOCAB}
SELECT scope, ngram, count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY scope ORDER BY count DESC, ngram)::INTEGER AS rank FROM c_grams)
WHERE rank <= {10 * SIZE}""",
    "word_vocab": f"WITH {CODE_VOCAB} SELECT scope, kind, token, id::INTEGER AS id, count FROM c_words",
    "bpe_vocab": f"WITH {CODE_VOCAB} SELECT scope, kind, token, id::INTEGER AS id, count FROM c_bpe",
    "required_vocab": f"""
WITH {CODE_DOCS}, {sql_counts('n', 'code_docs')}, {sql_vocabulary('r_', 'n', SIZE, required=tuple(REQUIRED))}
SELECT scope, kind, token, id::INTEGER AS id, count FROM r_vocab""",
    "stored_vocab": f"WITH {CODE_VOCAB} SELECT scope, kind, token, id::INTEGER AS id, count FROM c_vocab",
    "threshold_vocab": f"""
WITH {CODE_DOCS}, {sql_counts('n', 'code_docs')}
SELECT DISTINCT scope, 'simple' AS kind, '%MASK%' AS token, 0 AS id, 0::BIGINT AS count FROM n
UNION ALL SELECT DISTINCT scope, 'simple', '%UNK%', 1, 0 FROM n
UNION ALL SELECT scope, 'simple', token, rn + 1, count FROM (
  SELECT *, row_number() OVER (PARTITION BY scope ORDER BY count DESC, token)::INTEGER AS rn
  FROM n WHERE count >= 10 AND token NOT IN ('%MASK%', '%UNK%')) WHERE rn <= {SIZE}""",
    "merge_vocab": f"""
WITH {_MERGE},
parts AS (SELECT *, 0 AS origin, id AS old FROM b_vocab UNION ALL SELECT *, 1, 0 FROM extra)
SELECT scope, kind, token, (row_number() OVER (PARTITION BY scope ORDER BY kind DESC, origin, old, token) - 1)::INTEGER AS id, count
FROM parts ORDER BY scope, id""",
    "new_tokens": f"WITH {_MERGE} SELECT scope, kind, token FROM extra",
}
