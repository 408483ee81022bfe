"""Two refreshes of overlapping repositories, and searches over what they publish."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions import text as T
from quarry.plans import search as P
from quarry.plans.prepare import update_repositories
from quarry.session import shared_folder
from quarry.sources.publication import REPOSITORY, Snapshot
from quarry.suite.common import DOCS, documents, sql_code_tokens, sql_normal_code, sql_strip, table

#: Documents of a language that a repository needs, width of vectors, trees.
MINIMUM, WIDTH, TREES = 3, 32, 5


def repository_files(spark, folder):
    """English documents are Python files, all others Go files, of ``org/<source>``."""
    docs = documents(spark, folder)
    suffix = F.when(F.col("language") == "python", ".py").otherwise(".go")
    return docs.select(
        F.lit("org").alias("organization"), F.col("repo").alias("name"),
        F.substring("repo", 4, 9).cast("int").alias("number"), "doc_id",
        F.concat(F.regexp_replace("path", r"\.\w+$", ""), suffix).alias("path"), "text",
    )


def whole_files(files):
    """An extractor that takes each file as one definition."""
    tokens = T.code_tokens(F.col("language"), F.col("text"))
    return files.select(
        *REPOSITORY, "commit_hash", "language", "path",
        F.regexp_replace("path", r"[^A-Za-z0-9]", "_").alias("identifier"),
        F.lit("").alias("docstring"), F.lit("").alias("docstring_summary"),
        F.col("text").alias("code"), tokens.alias("code_tokens"),
        F.lit(0).alias("start_row"), F.lit(0).alias("end_row"),
    )


def _refresh_twice(spark, folder):
    """Repositories 0 to 11, without every fourth document; then 8 to 19 whole, but
    for number 9, of which only one word a file is left and which fails."""
    target = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    files = repository_files(spark, folder)
    first = files.where("number < 12 and doc_id % 4 <> 0").withColumn("commit_hash", F.lit("c1"))
    text = F.when(F.col("number") == 9, "x").otherwise(F.col("text"))
    second = files.where("number >= 8").withColumn("text", text).withColumn("commit_hash", F.lit("c2"))
    held = []
    for part in (first, second):
        update_repositories(
            part.drop("number", "doc_id"), whole_files, target, minimum=MINIMUM, width=WIDTH, n_trees=TREES, max_epochs=0
        )
        held.append(Snapshot.current(spark, target))
    return held


def update_repositories_twice(spark, folder):
    """What every table holds of every repository: for a reader who took the
    version before the second refresh and reads after it, and for one after."""
    rows = []
    for name, snapshot in zip(("before", "after"), _refresh_twice(spark, folder)):
        count = lambda table, what, n: snapshot.table(table).groupBy(*REPOSITORY).agg(n.alias(what))  # noqa: E731, B023
        found = snapshot.manifest.select(*REPOSITORY, "update_status", "commit_hash")
        for part in (
            count("code_document", "documents", F.count("*")), count("vocabulary", "vocabularies", F.count_distinct("scope")),
            count("tokens", "encoders", F.count_distinct("scope")), count("gate", "gates", F.count("*")),
            count("norms", "norms", F.count("*")), count("index_vectors", "vectors", F.count("*")),
            count("index_nodes", "roots", F.count_if(F.col("node") == 1)), count("index_groups", "languages", F.count("*")),
        ):
            found = found.join(part, REPOSITORY, "left")
        rows.append(found.withColumn("version", F.lit(name)).fillna(0))
    return rows[0].unionByName(rows[1])


def search_published(spark, folder):
    """Each benchmark text and snippet in a published repository, and each stored
    document, by the repository's own model and index: how many results each
    request has in each language."""
    snapshot = _refresh_twice(spark, folder)[-1]
    everything = TREES * snapshot.table("index_vectors").count()
    repo = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("name")
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("org").alias("organization"), repo, F.col("text").alias("query")
    )
    snippets = asked.select("query_id", *REPOSITORY, F.lit("python").alias("language"), F.col("query").alias("code"))
    stored = snapshot.table("code_document")
    hashes = stored.select(F.concat_ws(":", "name", "code_hash").alias("query_id"), *REPOSITORY, "code_hash").distinct()
    results = {
        "text": P.published_text_search(snapshot, asked, search_k=everything),
        "code": P.published_code_search(snapshot, snippets, search_k=everything),
        "similar": P.published_similar(snapshot, hashes, search_k=everything),
    }
    rows = [
        # Without the row that a request for similar ones names last.
        df.groupBy(F.regexp_replace(F.col("query_id").cast("string"), r":\d+$", "").alias("query_id"), "language").agg(
            F.count("*").alias("n"), F.max("rank").alias("last"), F.count_distinct("row_index").alias("rows"),
        ).withColumn("kind", F.lit(kind))
        for kind, df in results.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES = {f.__name__: f for f in [update_repositories_twice, search_published]}

_FILES = f"""files AS (
  SELECT repo AS name, CAST(substr(repo, 4) AS INTEGER) AS number, doc_id, text,
    CASE language WHEN 'python' THEN 'python' ELSE 'go' END AS language FROM docs),
runs AS (
  SELECT 1 AS run, * FROM files WHERE number < 12 AND doc_id % 4 <> 0
  UNION ALL
  SELECT 2, name, number, doc_id, CASE number WHEN 9 THEN 'x' ELSE text END, language FROM files WHERE number >= 8),
lexed AS (
  SELECT run, name, language, {sql_strip('text')} AS code, {sql_code_tokens('language', 'text')} AS tokens FROM runs
  WHERE length(text) <= {C.MAX_FILE_CHARS}),
kept AS (
  SELECT run, name, language, code, any_value(len({sql_normal_code('language', 'tokens')})) AS n
  FROM lexed WHERE len(tokens) > 1 GROUP BY ALL),
sizes AS (
  SELECT run, name, language, count(*) AS n, count(*) FILTER (n > 0) AS filled FROM kept GROUP BY ALL),
status AS (
  SELECT run, name, coalesce(min(n) >= {MINIMUM}, false) AS good, coalesce(sum(n), 0)::BIGINT AS documents,
    coalesce(sum(filled), 0)::BIGINT AS vectors, count(language) AS languages
  FROM (SELECT DISTINCT run, name FROM runs) LEFT JOIN sizes USING (run, name) GROUP BY ALL),
tried AS (
  SELECT v.version, s.name, arg_max(good, run) AS good, max(run) FILTER (good) AS current
  FROM status s JOIN (VALUES ('before', 1), ('after', 2)) AS v(version, upto) ON run <= upto GROUP BY ALL)"""

SQL = {
    "update_repositories_twice": f"""
WITH {DOCS}, {_FILES}
SELECT version, 'org' AS organization, t.name, (CASE WHEN t.good THEN 1 ELSE 2 END)::INTEGER AS update_status,
  'c' || current AS commit_hash, coalesce(documents, 0) AS documents, coalesce(languages + 1, 0) AS vocabularies,
  coalesce(languages + 1, 0) AS encoders, coalesce(languages + 1, 0) AS gates,
  coalesce({C.CODE_LENGTH} * languages + {C.QUERY_LENGTH}, 0) AS norms, coalesce(vectors, 0) AS vectors,
  coalesce({TREES} * languages, 0) AS roots, coalesce(languages, 0) AS languages
FROM tried t LEFT JOIN status s ON s.run = t.current AND s.name = t.name""",
    "search_published": f"""
WITH {DOCS}, {_FILES},
held AS (
  SELECT s.name, s.language, s.n, s.filled FROM tried t JOIN sizes s ON s.run = t.current AND s.name = t.name
  WHERE t.version = 'after'),
asked AS (
  SELECT item_id::VARCHAR AS query_id, 'src' || (item_id % 20) AS name, text,
    {sql_normal_code("'python'", "code")} AS tokens
  FROM (SELECT *, {sql_code_tokens("'python'", 'text')} AS code FROM benchmark)),
stored AS (
  SELECT k.name || ':' || sha1(k.code) || ':org/' || k.name || '/' || k.language AS query_id, h.language, h.filled - 1 AS n
  FROM kept k JOIN tried t ON t.version = 'after' AND t.current = k.run AND t.name = k.name
  JOIN held h ON h.name = k.name AND h.language = k.language WHERE k.n > 0),
found AS (
  SELECT 'text' AS kind, query_id, language, filled AS n FROM asked JOIN held USING (name)
  WHERE length(text) <= {C.MAX_QUERY_CHARS}
  UNION ALL SELECT 'code', query_id, language, filled FROM asked JOIN held USING (name)
  WHERE language = 'python' AND length(text) <= {C.MAX_CODE_CHARS} AND len(tokens) > 0)
SELECT kind, query_id, language, least(n, {C.WEB_RESULTS}) AS n, least(n, {C.WEB_RESULTS})::INTEGER AS last,
  least(n, {C.WEB_RESULTS}) AS rows
FROM found WHERE n > 0
UNION ALL
SELECT 'similar', query_id, language, least(n, {C.WEB_RESULTS}), least(n, {C.WEB_RESULTS})::INTEGER,
  least(n, {C.WEB_RESULTS})
FROM stored WHERE n > 0""",
}
