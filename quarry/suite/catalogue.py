"""Repositories, request checks, lookups by hash and the query log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry import constants as C
from quarry.plans import search as P
from quarry.session import shared_folder
from quarry.sources import catalogue as K
from quarry.suite.common import DOCS, documents, sql_strip, table


def repositories(spark, folder):
    """Suppliers as repositories; their nation is the organization."""
    nation = table(spark, folder, "nation")
    supplier = table(spark, folder, "supplier")
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        F.col("n_name").alias("organization"),
        F.col("s_name").alias("name"),
        F.col("s_suppkey").alias("id"),
        (F.col("s_suppkey") % 3).cast("int").alias("update_status"),
    )


def repository_language(spark, folder):
    """The kinds of lines that a supplier ships stand for its languages."""
    shipped = (
        table(spark, folder, "lineitem")
        .select(F.col("l_suppkey").alias("id"), F.concat_ws("_", "l_returnflag", "l_linestatus").alias("language"))
        .distinct()
    )
    named = repositories(spark, folder).select("id", "organization", "name")
    return shipped.join(named, "id").select("organization", "name", "language")


def finished_repos(spark, folder):
    return K.finished(repositories(spark, folder))


def active_repos(spark, folder):
    return K.not_in_error(repositories(spark, folder))


def named_repos(spark, folder):
    """Repositories listed as ``organization/name``: those of rich suppliers."""
    rich = table(spark, folder, "supplier").filter("s_acctbal > 5000").select(F.col("s_name").alias("name"))
    names = repositories(spark, folder).join(rich, "name").select(
        F.concat_ws("/", "organization", "name").alias("repository")
    )
    return K.named_repositories(repositories(spark, folder), names)


def repo_languages(spark, folder):
    listing = K.repository_listing(repositories(spark, folder), repository_language(spark, folder))
    return listing.select("id", "organization", "name", F.array_join("languages", ",").alias("languages"))


def repo_count(spark, folder):
    return repositories(spark, folder).groupBy("update_status").agg(F.count("*").alias("n"))


def repo_text_filter(spark, folder):
    return K.matching_repositories(repositories(spark, folder), F.lit("nation_1"))


def query_validation(spark, folder):
    """All document and benchmark texts as if typed by a user."""
    texts = table(spark, folder, "documents").select(F.col("text").alias("query")).unionByName(
        table(spark, folder, "benchmark").select(F.col("text").alias("query"))
    ).unionByName(table(spark, folder, "part").select(F.repeat(F.lit(" "), F.col("p_size") % 3).alias("query")))
    problem = F.coalesce(P.query_problem(F.col("query")), F.lit("ok"))
    return texts.groupBy(problem.alias("problem")).agg(
        F.count("*").alias("n"), F.sum(F.length("query")).alias("chars")
    )


def code_validation(spark, folder):
    """All documents as code requests in one of five languages, of which their
    repository has four at most."""
    docs = documents(spark, folder)
    known = docs.groupBy("repo").agg(F.collect_set("language").alias("languages"))
    names = F.array(*[F.lit(x) for x in ("python", "java", "go", "php", "ruby")])
    asked = docs.withColumn("language", F.get(names, (F.col("doc_id") % 5).cast("int"))).join(known, "repo", "left")
    has = F.coalesce(F.array_contains("languages", F.col("language")), F.lit(False))
    return asked.select(
        "doc_id", F.coalesce(P.code_problem(F.col("text"), has), F.lit("ok")).alias("problem")
    )


def doc_by_hash(spark, folder):
    docs = documents(spark, folder).select(
        F.lit("org").alias("organization"), F.col("repo").alias("name"), "language", "doc_id",
        F.sha1("text").alias("code_hash"),
    )
    wanted = docs.select("organization", "name", "code_hash").distinct()
    return K.documents_by_hash(docs, wanted).select("name", "code_hash", "language", "doc_id")


def doc_by_hash_index(spark, folder):
    """Where all documents are that share a text, in whatever repository, by the index on hashes."""
    path = f"{shared_folder(spark)}/hashes-{uuid.uuid4().hex}"
    docs = documents(spark, folder).select(
        F.lit("org").alias("organization"), F.col("repo").alias("name"), "language",
        F.sha1("text").alias("code_hash"), F.col("doc_id").alias("row_index"),
    )
    K.save_hash_index(docs, path)
    return K.places_by_hash(spark, path, docs.select("code_hash"))


def language_intersect(spark, folder):
    """Languages to search for each benchmark query in its repository."""
    n = F.col("item_id") % 4
    tail = (
        F.when(n == 0, " +language=Go,PYTHON").when(n == 1, " +language=ruby")
        .when(n == 2, " +language=php,php,java").otherwise("")
    )
    queries = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("repo"),
        F.concat("text", tail).alias("query"),
    )
    languages = documents(spark, folder).groupBy("repo").agg(
        F.array_sort(F.collect_set("language")).alias("languages")
    )
    return P.requested_languages(queries, languages, ["repo"]).select(
        "query_id", F.array_join("searched", ",").alias("searched"),
        F.coalesce("problem", F.lit("ok")).alias("problem"),
    )


def _dated(days):
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_logs")


def query_log_per_day(spark, folder):
    return _dated(K.queries_per_day(table(spark, folder, "events"), 5, "ts"))


def query_log_all_days(spark, folder):
    return _dated(K.queries_per_day(table(spark, folder, "events"), None, "ts"))


QUERIES = {
    f.__name__: f
    for f in [
        finished_repos, active_repos, named_repos, repo_languages, repo_count, repo_text_filter,
        query_validation, code_validation, doc_by_hash, doc_by_hash_index, language_intersect, query_log_per_day,
        query_log_all_days,
    ]
}

REPOS = """repos AS (
  SELECT n_name AS organization, s_name AS name, s_suppkey AS id, (s_suppkey % 3)::INTEGER AS update_status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _problem(x: str, longest: int) -> str:
    return (
        f"CASE WHEN {x} IS NULL OR length({sql_strip(x)}) = 0 THEN 'invalid or missing' "
        f"WHEN length({x}) > {longest} THEN 'too long' END"
    )


_DAYS = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_logs FROM events GROUP BY ALL ORDER BY day DESC"

SQL = {
    "finished_repos": f"WITH {REPOS} SELECT * FROM repos WHERE update_status = 1",
    "active_repos": f"WITH {REPOS} SELECT * FROM repos WHERE update_status <> 2",
    "named_repos": f"""
WITH {REPOS}
SELECT r.* FROM repos r JOIN supplier s ON s.s_suppkey = r.id WHERE s_acctbal > 5000""",
    "repo_languages": f"""
WITH {REPOS},
l AS (SELECT DISTINCT l_suppkey AS id, l_returnflag || '_' || l_linestatus AS language
  FROM lineitem)
SELECT r.id, organization, name, string_agg(language, ',' ORDER BY language) AS languages
FROM repos r LEFT JOIN l USING (id) WHERE update_status = 1 GROUP BY ALL""",
    "repo_count": f"WITH {REPOS} SELECT update_status, count(*) AS n FROM repos GROUP BY ALL",
    "repo_text_filter": f"""
WITH {REPOS}
SELECT * FROM repos WHERE contains(lower(name), 'nation_1') OR contains(lower(organization), 'nation_1')""",
    "query_validation": f"""
WITH t AS (
  SELECT text AS query FROM documents UNION ALL SELECT text FROM benchmark
  UNION ALL SELECT repeat(' ', p_size % 3) FROM part)
SELECT coalesce({_problem('query', C.MAX_QUERY_CHARS)}, 'ok') AS problem, count(*) AS n,
  sum(length(query))::BIGINT AS chars FROM t GROUP BY 1""",
    "code_validation": f"""
WITH {DOCS},
known AS (SELECT DISTINCT repo, language FROM docs),
asked AS (SELECT doc_id, repo, text, ['python', 'java', 'go', 'php', 'ruby'][doc_id % 5 + 1] AS language FROM docs)
SELECT doc_id, coalesce({_problem('text', C.MAX_CODE_CHARS)},
  CASE WHEN k.repo IS NULL THEN 'unknown language' END, 'ok') AS problem
FROM asked d LEFT JOIN known k ON k.repo = d.repo AND k.language = d.language""",
    "doc_by_hash": f"""
WITH {DOCS},
h AS (SELECT doc_id, repo, language, sha1(text) AS code_hash FROM docs)
SELECT repo AS name, code_hash, language, doc_id FROM h""",
    "doc_by_hash_index": f"""
WITH {DOCS}
SELECT 'org' AS organization, repo AS name, sha1(text) AS code_hash, language, doc_id AS row_index FROM docs
WHERE text IS NOT NULL""",
    "language_intersect": f"""
WITH {DOCS},
l AS (SELECT repo, list(DISTINCT language ORDER BY language) AS languages FROM docs GROUP BY repo),
q AS (
  SELECT item_id AS query_id, 'src' || (item_id % 20) AS repo,
    CASE item_id % 4 WHEN 0 THEN ['go', 'python'] WHEN 1 THEN ['ruby'] WHEN 2 THEN ['php', 'java'] END AS named
  FROM benchmark),
s AS (SELECT query_id, CASE WHEN named IS NULL THEN languages
  ELSE list_filter(named, lambda x: list_contains(languages, x)) END AS found FROM q JOIN l USING (repo))
SELECT query_id, coalesce(array_to_string(found, ','), '') AS searched,
  CASE WHEN len(found) = 0 THEN 'no valid language in the filter' ELSE 'ok' END AS problem FROM s""",
    "query_log_per_day": f"{_DAYS} LIMIT 5",
    "query_log_all_days": _DAYS,
}
