"""Embeddings, nearest neighbours and the three searches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions import text as T, vectors as V
from quarry.operators import embedding as E, neighbours as N
from quarry.operators.corpus import with_row_index
from quarry.operators.encoding import encode
from quarry.operators.vocabulary import merge_vocabularies
from quarry.plans import search as P
from quarry.session import materialise, shared_folder
from quarry.sources.catalogue import clear_cache, load_model, save_model, with_cache
from quarry.suite.common import (
    CODE_DOCS, DOCS, TEXT_QUERIES, code_documents, documents, quote, rounded, sql_code_tokens,
    sql_normal_code, sql_strip, table, text_queries,
)
from quarry.suite.sequences import CODE_ENCODED, sql_encode, sql_walk
from quarry.suite.vocabulary import (
    SIZE, _MERGE, _pooled, both_vocabularies, code_vocabulary, query_vocabulary, sql_counts,
    sql_vocabulary,
)

SCOPES = ["python", "java", "go", "php", "query"]


def model(spark, folder):
    """Fixed test weights: the vector table as token vectors of every scope,
    and gates and normalisation from whole-number formulas."""
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("int").alias("id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
    )
    scopes = spark.sql(
        "SELECT * FROM VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(SCOPES))
        + " AS t(scope, n)"
    )
    names = F.explode(F.array(*[F.lit(s) for s in SCOPES])).alias("scope")
    j = F.sequence(F.lit(1), F.lit(64))
    gate = F.transform(j, lambda x: ((x * 7 + F.col("n") * 3) % 11 - 5) / F.lit(5.0))
    p = F.col("position")
    norms = scopes.select(
        "scope", F.explode(F.sequence(F.lit(0), F.lit(C.CODE_LENGTH - 1))).alias("position")
    ).select(
        "scope", "position",
        (p * 0.01 - 0.5).alias("mean"), (p * 0.1 + 1.0).alias("var"),
        (p * 0.02 + 1.0).alias("gamma"), (F.lit(0.5) - p * 0.01).alias("beta"),
    )
    return E.Model(vectors.select(names, "id", "vec"), scopes.select("scope", gate.alias("w")), norms)


def _by_number(vectors, keys, name="embedding"):
    return vectors.select(
        *keys, F.posexplode(name).alias("dim", "value")
    ).select(*keys, "dim", rounded(F.col("value")).alias("value"))


def document_vectors(spark, folder, vocabulary):
    encoded = encode(code_documents(spark, folder), ["doc_id"], vocabulary, C.CODE_LENGTH)
    return E.embed(encoded, ["doc_id"], model(spark, folder)).withColumnRenamed("scope", "language")


def encode_embeddings(spark, folder):
    vectors = document_vectors(spark, folder, code_vocabulary(spark, folder))
    return _by_number(vectors, ["doc_id", "language"])


def stored_model(spark, folder):
    """The test weights, written and read: what each part holds of a scope."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    save_model(model(spark, folder), path)
    held = load_model(spark, path)
    per = lambda df, n, total: df.groupBy("scope").agg(F.count("*").alias(n), rounded(F.sum(total), 4).alias(f"{n}_sum"))
    width = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return (
        per(held.tokens, "vectors", F.element_at("vec", 1))
        .join(per(held.gate, "gates", width), "scope")
        .join(per(held.norms, "positions", F.col("mean") + F.col("var") + F.col("gamma") + F.col("beta")), "scope")
    )


def encode_embeddings_join(spark, folder):
    """The same embeddings in many small groups of each scope."""
    weights = model(spark, folder)
    encoded = encode(
        code_documents(spark, folder), ["doc_id"], code_vocabulary(spark, folder), C.CODE_LENGTH
    )
    vectors = E.embed(encoded, ["doc_id"], weights, group_rows=50)
    return _by_number(vectors.withColumnRenamed("scope", "language"), ["doc_id", "language"])


def encode_query(spark, folder):
    queries = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    vectors = P.embed_queries(queries, both_vocabularies(spark, folder), model(spark, folder))
    return _by_number(vectors, ["query_id"])


def _snippets(spark, folder):
    """Benchmark texts as code of one of four languages."""
    n = F.col("item_id") % 4
    language = F.when(n == 0, "python").when(n == 1, "java").when(n == 2, "go").otherwise("php")
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), language.alias("language"), F.col("text").alias("code"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("repo"),
    )


def encode_code(spark, folder):
    snippets = _snippets(spark, folder).select("query_id", "language", "code")
    vectors = P.embed_code(
        snippets, ["query_id"], both_vocabularies(spark, folder), model(spark, folder)
    )
    return _by_number(vectors.withColumnRenamed("scope", "language"), ["query_id", "language"])


def transfer_embeddings(spark, folder):
    """Base vectors follow their tokens into a merged vocabulary."""
    merged = materialise(
        merge_vocabularies(_pooled(spark, folder), query_vocabulary(spark, folder)), "merged"
    )
    base = model(spark, folder).tokens.filter("scope = 'query'")
    moved = E.transfer_embeddings(merged, base, 64)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return moved.select(
        "scope", "id", "copied", F.size("vec").alias("width"),
        F.when(F.col("copied"), rounded(total)).alias("total"),
    )


def vector_items(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("label").alias("language"), F.col("vec_id").alias("row_index"), "embedding"
    )


def label_means(spark, folder):
    """One query per label: the mean of its vectors."""
    numbers = table(spark, folder, "embeddings").select(
        "label", F.posexplode("embedding").alias("dim", "x")
    )
    means = numbers.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return means.groupBy("label").agg(F.transform(listed, lambda s: s["x"]).alias("embedding")).select(
        F.col("label").alias("query_id"), "embedding"
    )


def _hits(hits):
    return hits.select(
        "query_id", "language", "row_index", "rank", rounded(F.col("distance"), 9).alias("distance")
    )


def knn_exact(spark, folder):
    return _hits(N.nearest(vector_items(spark, folder), label_means(spark, folder), C.WEB_RESULTS))


def knn_evaluation(spark, folder):
    """The same search as deep as the evaluation goes."""
    found = N.nearest(vector_items(spark, folder), label_means(spark, folder), C.EVALUATION_RESULTS)
    return _hits(found)


def knn_index_all_cells(spark, folder):
    """Probing every cell is exact."""
    index = N.VectorIndex.build(vector_items(spark, folder), n_cells=8)
    return _hits(index.search(label_means(spark, folder), C.WEB_RESULTS, probes=8))


def similar_docs(spark, folder):
    """Stored vectors like the ones users of the event log looked at."""
    seen = table(spark, folder, "events").select(F.col("user_id").alias("row_index")).distinct()
    items = vector_items(spark, folder)
    requests = seen.join(items.select("language", "row_index"), "row_index").select(
        F.col("row_index").alias("query_id"), "language", "row_index"
    )
    return _hits(N.nearest_to_stored(items, requests, C.WEB_RESULTS))


def _with_means(spark, folder):
    means = label_means(spark, folder).select(
        F.col("query_id").alias("label"), F.col("embedding").alias("mean")
    )
    return table(spark, folder, "embeddings").join(means, "label")


def cosine_pairs(spark, folder):
    return _with_means(spark, folder).select(
        "vec_id", rounded(V.cosine_similarity(F.col("embedding"), F.col("mean"))).alias("similarity")
    )


def match_rating(spark, folder):
    cosine = F.round(V.cosine_distance(F.col("embedding"), F.col("mean")), N.DECIMALS)
    angular = V.angular_distance(cosine)
    return _with_means(spark, folder).select(
        "vec_id", rounded(cosine, 9).alias("cosine"), rounded(angular).alias("angular"),
        V.match_rating(angular).alias("rating"),
    )


def stored_documents(spark, folder):
    docs = documents(spark, folder).select("doc_id", "repo", "language", "path", "text")
    numbered = with_row_index(docs, ["repo", "language"], ["path"], ["doc_id"])
    return materialise(
        numbered.select(
            "doc_id", "repo", "language", "row_index", "path",
            F.sha1("text").alias("code_hash"),
            F.concat(F.lit("https://host/"), "path").alias("url"),
        ),
        "documents",
    )


def _search_tables(spark, folder):
    stored = stored_documents(spark, folder)
    vocabulary = both_vocabularies(spark, folder)
    vectors = document_vectors(spark, folder, vocabulary).select("doc_id", "embedding")
    items = materialise(
        stored.select("doc_id", "repo", "language", "row_index").join(vectors, "doc_id").drop("doc_id"),
        "items",
    )
    languages = stored.groupBy("repo").agg(F.array_sort(F.collect_set("language")).alias("languages"))
    return stored, items, languages, vocabulary


def _results(found):
    return found.select(
        "query_id", "language", "row_index", "url", "code_hash", "filename", "rank",
        rounded(F.col("distance")).alias("distance"), "rating",
    )


def search_text(spark, folder):
    """Every benchmark text in its repository, some with a language filter."""
    stored, items, languages, vocabulary = _search_tables(spark, folder)
    n = F.col("item_id") % 3
    tail = F.when(n == 0, " +language=Python,go").when(n == 1, " +language=ruby").otherwise("")
    queries = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("repo"),
        F.concat("text", tail).alias("query"),
    )
    return _results(
        P.text_search(queries, languages, ["repo"], items, stored, vocabulary, model(spark, folder))
    )


def search_code(spark, folder):
    stored, items, languages, vocabulary = _search_tables(spark, folder)
    return _results(
        P.code_search(
            _snippets(spark, folder), languages, ["repo"], items, stored, vocabulary,
            model(spark, folder),
        )
    )


def search_similar(spark, folder):
    """Documents like each stored one, by repository and hash."""
    stored, items, _, _ = _search_tables(spark, folder)
    requests = stored.select("repo", "code_hash").distinct().select(
        F.concat_ws(":", "repo", "code_hash").alias("query_id"), "code_hash", "repo"
    )
    return _results(P.similar_documents(requests, items, stored, by=["repo"]))


def search_rejects(spark, folder):
    """Why requests of all three searches are turned down: every document and
    benchmark text as a query and as code, some of unknown repositories or
    languages, and hashes of documents in the wrong repository."""
    stored = stored_documents(spark, folder)
    languages = stored.groupBy("repo").agg(F.array_sort(F.collect_set("language")).alias("languages"))
    texts = table(spark, folder, "documents").select(F.concat(F.lit("d"), "doc_id").alias("query_id"), "doc_id", "text").union(
        table(spark, folder, "benchmark").select(F.concat(F.lit("b"), "item_id"), "item_id", "text")
    )
    n = F.col("doc_id")
    repo = F.concat(F.lit("src"), (n % 25).cast("string")).alias("repo")
    tail = F.when(n % 3 == 0, " +language=Python,go").when(n % 3 == 1, " +language=ruby").otherwise("")
    queries = texts.select("query_id", repo, F.concat(F.substring("text", 1, 300), tail).alias("query"))
    names = F.array(*[F.lit(x) for x in ("python", "java", "go", "php", "ruby")])
    snippets = texts.select("query_id", repo, F.get(names, (n % 5).cast("int")).alias("language"), F.col("text").alias("code"))
    hashes = texts.select("query_id", repo, F.sha1("text").alias("code_hash"))
    found = [
        ("text", P.checked_queries(queries, languages, ["repo"])),
        ("code", P.checked_snippets(snippets, languages, ["repo"])),
        ("similar", P.checked_hashes(hashes, stored, ["repo"])),
    ]
    rows = [df.select(F.lit(kind).alias("kind"), "query_id", F.coalesce("problem", F.lit("ok")).alias("problem")) for kind, df in found]
    return rows[0].union(rows[1]).union(rows[2])


CACHE_SCHEMA = "cache_key string, query_id int, language int, row_index long, rank int, distance double"


def result_cache(spark, folder):
    """All label queries through a cache that already holds some of them."""
    path = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    clear_cache(spark, path, CACHE_SCHEMA)
    key = T.cache_key("query", F.lit("org"), F.lit("labels"), F.col("query_id").cast("string"))
    requests = materialise(label_means(spark, folder).withColumn("cache_key", key), "requests")
    items = vector_items(spark, folder)

    def compute(misses):
        found = N.nearest(items, misses.select("query_id", "embedding"), C.WEB_RESULTS)
        return found.join(misses.select("query_id", "cache_key"), "query_id")

    with_cache(requests.filter("query_id < 5"), path, CACHE_SCHEMA, compute)
    results = with_cache(requests, path, CACHE_SCHEMA, compute)
    return results.select(
        "cache_key", "query_id", "language", "row_index", "rank",
        rounded(F.col("distance"), 9).alias("distance"),
    )


QUERIES = {
    f.__name__: f
    for f in [
        encode_embeddings, encode_embeddings_join, encode_query, encode_code, transfer_embeddings,
        knn_exact, knn_evaluation, knn_index_all_cells, similar_docs, cosine_pairs,
        match_rating, search_text, search_code, search_similar, search_rejects, result_cache,
        stored_model,
    ]
}


# --- The same in SQL ------------------------------------------------------------

TOKENS = "tok AS (SELECT vec_id::INTEGER AS id, embedding::DOUBLE[] AS vec FROM embeddings)"
_W = "list_transform(range(1, 65), lambda j: (((j * 7 + n * 3) % 11) - 5) / 5e0)"
_SCOPE_ROWS = ", ".join(f"('{s}', {i})" for i, s in enumerate(SCOPES))
WEIGHTS = f"""{TOKENS},
dims AS (SELECT id, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM tok),
scopes AS (SELECT * FROM (VALUES {_SCOPE_ROWS}) AS t(scope, n)),
gates AS (SELECT scope, id, list_dot_product(vec, {_W}) AS g FROM scopes, tok)"""


def sql_embed(name: str, source: str, key: str) -> str:
    """CTE ``{name}(key, scope, vec)`` of the id lists in a CTE."""
    return f"""{name}_occ AS (
  SELECT {key}, scope, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS p FROM {source}),
{name}_w AS (
  SELECT o.{key}, o.scope, o.id, sum(1e0 / (1e0 + exp(-((2e-2 * p + 1e0) / sqrt(1e-1 * p + 1e0 + 1e-5)
    * (g - (1e-2 * p - 5e-1)) + (5e-1 - 1e-2 * p))))) AS w
  FROM {name}_occ o JOIN gates USING (scope, id) WHERE o.id <> 0 GROUP BY ALL),
{name}_mass AS (SELECT {key}, scope, sum(w) AS m FROM {name}_w GROUP BY ALL),
{name}_sum AS (
  SELECT {key}, scope, d, sum(w * x) AS s FROM {name}_w JOIN dims USING (id) GROUP BY ALL),
{name} AS (
  SELECT f.{key}, f.scope, coalesce(list(s / (m + 1e-8) ORDER BY d) FILTER (s IS NOT NULL),
      list_resize([]::DOUBLE[], 64, 0e0)) AS vec
  FROM {source} f LEFT JOIN {name}_mass USING ({key}, scope) LEFT JOIN {name}_sum USING ({key}, scope)
  GROUP BY ALL)"""


def sql_numbers(source: str, keys: str) -> str:
    return (
        f"SELECT {keys}, (generate_subscripts(vec, 1) - 1)::INTEGER AS dim, "
        f"round(unnest(vec), 6) + 0e0 AS value FROM {source}"
    )


def sql_distance(a: str, b: str) -> str:
    return (
        f"round(1e0 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) "
        f"* sqrt(list_dot_product({b}, {b}))), 9)"
    )


_SNIPPET_LANGUAGE = (
    "CASE item_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'go' ELSE 'php' END"
)
SPACE = ",\n".join(
    [
        CODE_DOCS,
        TEXT_QUERIES,
        f"""snippets AS (
  SELECT item_id AS query_id, 'src' || (item_id % 20) AS repo, language, language AS scope,
    {sql_normal_code('language', 'lexed')} AS tokens
  FROM (SELECT *, {sql_code_tokens('language', 'text')} AS lexed
    FROM (SELECT *, {_SNIPPET_LANGUAGE} AS language FROM benchmark)))""",
        "learn AS (SELECT scope, tokens FROM code_docs UNION ALL SELECT scope, tokens FROM text_queries)",
        sql_counts("learn_counts", "learn"),
        sql_vocabulary("l_", "learn_counts", SIZE),
        f"""a_vocab AS (SELECT * FROM l_vocab),
a_bpe AS (SELECT * FROM l_bpe),
a_oov AS (
  SELECT DISTINCT scope, token FROM (
    SELECT scope, unnest(tokens) AS token FROM learn
    UNION ALL SELECT scope, unnest(tokens) FROM snippets) c
  WHERE NOT EXISTS (SELECT 1 FROM l_words w WHERE w.scope = c.scope AND w.token = c.token)),
a_spans AS (
  SELECT scope, token, start, unnest(range(1, least({C.NGRAM_MAX}, length(token) - start + 1) + 1)) AS size
  FROM (SELECT *, unnest(range(1, length(token) + 1)) AS start FROM a_oov))""",
        sql_walk("a_"),
        WEIGHTS,
    ]
)
CODE_VECTORS = (
    sql_encode("code_enc", "a_", "code_docs", "doc_id", C.CODE_LENGTH)
    + ",\n"
    + sql_embed("code_vec", "code_enc", "doc_id")
)
QUERY_VECTORS = (
    sql_encode("query_enc", "a_", "text_queries", "query_id", C.QUERY_LENGTH)
    + ",\n"
    + sql_embed("query_vec", "query_enc", "query_id")
)
SNIPPET_VECTORS = (
    sql_encode("snip_enc", "a_", "snippets", "query_id", C.CODE_LENGTH)
    + ",\n"
    + sql_embed("snip_vec", "snip_enc", "query_id")
)
STORED = """stored AS (
  SELECT doc_id, repo, language, path, sha1(text) AS code_hash, 'https://host/' || path AS url,
    row_number() OVER (PARTITION BY repo, language ORDER BY path) - 1 AS row_index FROM docs)"""
MEANS = """means AS (
  SELECT label, list(x ORDER BY d) AS vec FROM (
    SELECT label, d, avg(x) AS x FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)
    GROUP BY ALL) GROUP BY label)"""


def sql_top(source: str, k: int, by: str = "query_id, language") -> str:
    """Best ``k`` rows of a CTE (query_id, language, row_index, distance)."""
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY distance, row_index)::INTEGER AS rank "
        f"FROM {source} QUALIFY rank <= {k}"
    )


def _sql_knn(k: int) -> str:
    return f"""
WITH {MEANS},
pairs AS (
  SELECT m.label AS query_id, e.label AS language, vec_id AS row_index,
    {sql_distance('m.vec', 'e.embedding::DOUBLE[]')} AS distance
  FROM means m, embeddings e)
SELECT query_id, language, row_index, rank, distance + 0e0 AS distance
FROM ({sql_top('pairs', k)})"""


_RESULT = """query_id, language, row_index, url, code_hash, string_split(path, '/')[-1] AS filename, rank,
  round(sqrt(2e0 * greatest(distance, 0e0)), 6) + 0e0 AS distance,
  round((2e0 - sqrt(2e0 * greatest(distance, 0e0))) / 2e0 * 100e0, 1) AS rating"""

SQL = {
    "encode_embeddings": f"""
WITH RECURSIVE {CODE_ENCODED}, {WEIGHTS}, {sql_embed('vectors', 'encoded', 'doc_id')}
{sql_numbers('vectors', 'doc_id, scope AS language')}""",
    "encode_query": f"""
WITH RECURSIVE {SPACE}, {QUERY_VECTORS} {sql_numbers('query_vec', 'query_id')}""",
    "encode_code": f"""
WITH RECURSIVE {SPACE}, {SNIPPET_VECTORS} {sql_numbers('snip_vec', 'query_id, scope AS language')}""",
    "transfer_embeddings": f"""
WITH {_MERGE}, {TOKENS},
parts AS (SELECT *, 0 AS origin, id AS old FROM b_vocab UNION ALL SELECT *, 1, NULL FROM extra),
merged AS (
  SELECT scope, old, (row_number() OVER (PARTITION BY scope ORDER BY kind DESC, origin, old, token) - 1)::INTEGER AS id
  FROM parts)
SELECT scope, m.id, t.id IS NOT NULL AS copied, 64 AS width, round(list_sum(vec), 6) + 0e0 AS total
FROM merged m LEFT JOIN tok t ON t.id = m.old""",
    "knn_exact": _sql_knn(C.WEB_RESULTS),
    "knn_evaluation": _sql_knn(C.EVALUATION_RESULTS),
    "knn_index_all_cells": _sql_knn(C.WEB_RESULTS),
    "similar_docs": f"""
WITH pairs AS (
  SELECT a.vec_id AS query_id, b.label AS language, b.vec_id AS row_index,
    {sql_distance('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} AS distance
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.vec_id IN (SELECT user_id FROM events))
SELECT query_id, language, row_index, rank, distance + 0e0 AS distance
FROM ({sql_top('pairs', C.WEB_RESULTS)})""",
    "cosine_pairs": f"""
WITH {MEANS}
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], vec) /
  ((sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8) * (sqrt(list_dot_product(vec, vec)) + 1e-8)), 6) + 0e0 AS similarity
FROM embeddings JOIN means USING (label)""",
    "match_rating": f"""
WITH {MEANS},
d AS (SELECT vec_id, {sql_distance('embedding::DOUBLE[]', 'vec')} AS c FROM embeddings JOIN means USING (label))
SELECT vec_id, c + 0e0 AS cosine, round(sqrt(2e0 * greatest(c, 0e0)), 6) + 0e0 AS angular,
  round((2e0 - sqrt(2e0 * greatest(c, 0e0))) / 2e0 * 100e0, 1) AS rating FROM d""",
    "search_text": f"""
WITH RECURSIVE {SPACE}, {CODE_VECTORS}, {QUERY_VECTORS}, {STORED},
asked AS (
  SELECT item_id AS query_id, 'src' || (item_id % 20) AS repo,
    CASE item_id % 3 WHEN 0 THEN ['python', 'go'] WHEN 1 THEN ['ruby'] END AS named,
    length(text) + CASE item_id % 3 WHEN 0 THEN length(' +language=Python,go') WHEN 1 THEN length(' +language=ruby') ELSE 0 END AS n
  FROM benchmark),
pairs AS (
  SELECT a.query_id, s.repo, s.language, s.row_index, s.url, s.code_hash, s.path,
    {sql_distance('q.vec', 'v.vec')} AS distance
  FROM asked a JOIN query_vec q USING (query_id) JOIN stored s USING (repo)
  JOIN code_vec v ON v.doc_id = s.doc_id
  WHERE a.n <= {C.MAX_QUERY_CHARS} AND (a.named IS NULL OR list_contains(a.named, s.language))),
best AS ({sql_top('pairs', C.WEB_RESULTS)})
SELECT {_RESULT} FROM best""",
    "search_code": f"""
WITH RECURSIVE {SPACE}, {CODE_VECTORS}, {SNIPPET_VECTORS}, {STORED},
pairs AS (
  SELECT a.query_id, s.language, s.row_index, s.url, s.code_hash, s.path,
    {sql_distance('q.vec', 'v.vec')} AS distance
  FROM snippets a JOIN snip_vec q USING (query_id) JOIN stored s ON s.repo = a.repo AND s.language = a.language
  JOIN code_vec v ON v.doc_id = s.doc_id),
best AS ({sql_top('pairs', C.WEB_RESULTS)})
SELECT {_RESULT} FROM best""",
    "search_similar": f"""
WITH RECURSIVE {SPACE}, {CODE_VECTORS}, {STORED},
mine AS (
  SELECT repo || ':' || code_hash || ':' || repo || '/' || language || ':' || row_index AS query_id,
    doc_id, repo, language FROM stored),
pairs AS (
  SELECT m.query_id, s.language, s.row_index, s.url, s.code_hash, s.path,
    {sql_distance('q.vec', 'v.vec')} AS distance
  FROM mine m JOIN code_vec q ON q.doc_id = m.doc_id
  JOIN stored s ON s.repo = m.repo AND s.language = m.language AND s.doc_id <> m.doc_id
  JOIN code_vec v ON v.doc_id = s.doc_id),
best AS ({sql_top('pairs', C.WEB_RESULTS)})
SELECT {_RESULT} FROM best""",
    "search_rejects": f"""
WITH {DOCS}, {STORED},
texts AS (
  SELECT 'd' || doc_id AS query_id, doc_id AS n, text FROM documents
  UNION ALL SELECT 'b' || item_id, item_id, text FROM benchmark),
asked AS (SELECT *, 'src' || (n % 25) AS repo FROM texts),
repos AS (SELECT DISTINCT repo FROM docs),
spoken AS (SELECT DISTINCT repo, language FROM docs),
queries AS (
  SELECT *, left(text, 300) || CASE n % 3 WHEN 0 THEN ' +language=Python,go' WHEN 1 THEN ' +language=ruby' ELSE '' END AS query,
    CASE n % 3 WHEN 0 THEN ['python', 'go'] WHEN 1 THEN ['ruby'] END AS named FROM asked)
SELECT 'text' AS kind, query_id, CASE
    WHEN text IS NULL OR length({sql_strip('query')}) = 0 THEN 'invalid or missing'
    WHEN length(query) > {C.MAX_QUERY_CHARS} THEN 'too long'
    WHEN repo NOT IN (SELECT repo FROM repos) THEN 'unknown repository'
    WHEN named IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM spoken s WHERE s.repo = q.repo AND list_contains(q.named, s.language))
    THEN 'no valid language in the filter' ELSE 'ok' END AS problem
FROM queries q
UNION ALL
SELECT 'code', query_id, CASE
    WHEN text IS NULL OR length({sql_strip('text')}) = 0 THEN 'invalid or missing'
    WHEN length(text) > {C.MAX_CODE_CHARS} THEN 'too long'
    WHEN repo NOT IN (SELECT repo FROM repos) THEN 'unknown repository'
    WHEN NOT EXISTS (SELECT 1 FROM spoken s WHERE s.repo = a.repo
      AND s.language = ['python', 'java', 'go', 'php', 'ruby'][n % 5 + 1])
    THEN 'unknown language' ELSE 'ok' END
FROM asked a
UNION ALL
SELECT 'similar', query_id, CASE WHEN NOT EXISTS (
    SELECT 1 FROM stored s WHERE s.repo = a.repo AND s.code_hash = sha1(a.text))
  THEN 'unknown document' ELSE 'ok' END
FROM asked a""",
    "stored_model": f"""
WITH {WEIGHTS},
first AS (SELECT count(*) AS n, sum(vec[1]) AS s FROM tok),
weights AS (SELECT scope, list_sum({_W}) AS s FROM scopes),
norms AS (
  SELECT count(*) AS n, sum(1e-2 * p - 5e-1 + 1e-1 * p + 1e0 + 2e-2 * p + 1e0 + 5e-1 - 1e-2 * p) AS s
  FROM range({C.CODE_LENGTH}) AS r(p))
SELECT scope, f.n AS vectors, round(f.s, 4) + 0e0 AS vectors_sum, 1::BIGINT AS gates, round(w.s, 4) + 0e0 AS gates_sum,
  m.n AS positions, round(m.s, 4) + 0e0 AS positions_sum
FROM weights w, first f, norms m""",
    "result_cache": f"""
SELECT sha1('query:org:labels:' || query_id) AS cache_key, * FROM ({_sql_knn(C.WEB_RESULTS)})""",
}
SQL["encode_embeddings_join"] = SQL["encode_embeddings"]
