"""Filters, projections, deduplication, numbering and splitting of a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions import text as T
from quarry.operators import corpus as K
from quarry.suite.common import (
    DOCS, documents, joined, quote, sql_code_tokens, sql_docstring_tokens, sql_joined,
    sql_normal_code, sql_query_tokens, sql_strip, sql_summary, table,
)


def path_filter(spark, folder):
    tail = (
        F.when(F.col("page_id") % 6 == 0, "/index.js")
        .when(F.col("page_id") % 6 == 1, "/vendor/x.rb")
        .when(F.col("page_id") % 6 == 2, "/Tests/x.py")
        .when(F.col("page_id") % 6 == 3, "/main.go")
        .when(F.col("page_id") % 6 == 4, "/dist/a.min.js")
        .otherwise("")
    )
    files = table(spark, folder, "pages").select("page_id", F.concat("url", tail).alias("path"))
    return K.source_files(files).select("page_id", "path", "language")


def size_filter(spark, folder):
    docs = documents(spark, folder).select("doc_id", F.repeat("text", F.lit(5)).alias("text"))
    return K.within_size(docs).select("doc_id", F.length("text").alias("n"))


def _lexed(spark, folder):
    return documents(spark, folder).withColumn(
        "code_tokens", T.code_tokens(F.col("language"), F.col("text"))
    )


def min_tokens(spark, folder):
    return K.with_body(_lexed(spark, folder)).select("doc_id", F.size("code_tokens").alias("n"))


def code_document(spark, folder):
    definitions = _lexed(spark, folder).select(
        "doc_id", "language", "path", "identifier",
        F.concat(F.lit("\n "), "text").alias("docstring"),
        T.docstring_summary(F.col("text")).alias("docstring_summary"),
        F.concat(F.lit("\t"), "text", F.lit("\n")).alias("code"),
        "code_tokens",
        F.lit(0).alias("start_row"),
        (F.size(F.split("text", "\n")) - 1).alias("end_row"),
    )
    return K.code_documents(definitions).select(
        "doc_id", "language", "path", "identifier", "docstring_summary",
        F.md5("docstring").alias("docstring"), F.md5("code").alias("code"),
        joined(F.col("docstring_tokens")).alias("docstring_tokens"), "start_line", "end_line",
    )


def blacklist_anti(spark, folder):
    size = F.col("p_size")
    name = (
        F.when(size % 5 == 0, "toString").when(size % 5 == 1, "valueOf")
        .when(size % 5 == 2, "equals").when(size % 5 == 3, "clone").otherwise("run")
    )
    language = F.when(size % 3 == 0, "java").when(size % 3 == 1, "javascript").otherwise("php")
    definitions = table(spark, folder, "part").select(
        "p_partkey", language.alias("language"), F.concat_ws(".", "p_brand", name).alias("identifier")
    )
    return K.without_blacklisted(definitions).select("p_partkey", "language", "identifier")


def relative_path(spark, folder):
    root = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    return table(spark, folder, "pages").select(
        "page_id", T.relative_path(F.col("url"), root).alias("path")
    )


def _preprocessed(spark, folder):
    docstring = F.when(F.col("n_chars") < 500, "").otherwise(T.docstring_summary(F.col("text")))
    return K.preprocess(
        _lexed(spark, folder).withColumn("docstring_tokens", T.docstring_tokens(docstring)),
        ["doc_id"],
    )


def valid_training_docs(spark, folder):
    return K.valid_training_documents(_preprocessed(spark, folder)).select(
        "doc_id", F.size("query_tokens").alias("n")
    )


def preprocess_doc(spark, folder):
    return _preprocessed(spark, folder).select(
        "doc_id", "language", "identifier", "url",
        joined(F.col("query_tokens")).alias("query_tokens"),
        F.md5(joined(F.col("code_tokens"))).alias("code_tokens"),
    )


def dedupe_docs(spark, folder):
    firsts = K.first_copies(documents(spark, folder), ["repo", "language"], "text", ["doc_id"])
    return firsts.select("repo", "language", "doc_id")


def dedupe_across_repos(spark, folder):
    """The same operator with one group per language only."""
    firsts = K.first_copies(documents(spark, folder), ["language"], "text", ["doc_id"])
    return firsts.select("language", "doc_id")


def row_index(spark, folder):
    docs = documents(spark, folder)
    return K.with_row_index(docs, ["repo", "language"], ["path"], ["doc_id"]).select(
        "doc_id", "repo", "language", "row_index"
    )


def split_sets(spark, folder):
    return K.split_into_sets(documents(spark, folder), "doc_id", seed=7).select("doc_id", "set")


def sample_gate(spark, folder):
    return K.sample_gate(documents(spark, folder), ["repo"], minimum=5)


def corpus_union(spark, folder):
    """Imported deduplicated definitions and imported sets in one corpus."""
    docs = documents(spark, folder)
    dedupe = docs.select("identifier", "language", F.col("text").alias("function"),
                         F.split("text", " ").alias("function_tokens"))
    sets = docs.select(F.col("identifier").alias("func_name"), "language",
                       F.split("text", " ").alias("code_tokens"))
    everything = K.union_corpora([K.import_deduplicated(dedupe), K.import_set(sets, "train")])
    return everything.select(
        "set", "language", "identifier", F.md5("code").alias("code"),
        F.size("code_tokens").alias("n_tokens"),
    )


def corpus_size(spark, folder):
    return (
        documents(spark, folder).groupBy("language").agg(F.count("*").alias("n")).orderBy("language")
    )


def languages_by_sets(spark, folder):
    return K.work_list(documents(spark, folder))


QUERIES = {
    f.__name__: f
    for f in [
        path_filter, size_filter, min_tokens, code_document, blacklist_anti, relative_path,
        valid_training_docs, preprocess_doc, dedupe_docs, dedupe_across_repos, row_index,
        split_sets, sample_gate, corpus_union, corpus_size, languages_by_sets,
    ]
}

_LEXED = f"""{DOCS},
lexed AS (SELECT *, {sql_code_tokens('language', 'text')} AS code_tokens FROM docs)"""
_PREPROCESSED = f"""{_LEXED},
found AS (SELECT *,
  {sql_docstring_tokens(f"CASE WHEN n_chars < 500 THEN '' ELSE {sql_summary('text')} END")} AS t FROM lexed),
pre AS (SELECT doc_id, language, identifier, {sql_query_tokens('t', 'identifier')} AS query_tokens,
  {sql_normal_code('language', 'code_tokens')} AS code_tokens FROM found)"""
_IGNORED = " OR ".join(
    f"(language = {quote(language)} AND contains(lower(path), {quote(part)}))"
    for language, parts in C.IGNORED_PATH_PARTS.items()
    for part in parts
)
_EXTENSION = " ".join(
    f"WHEN ends_with(path, '.{ext}') THEN {quote(language)}" for language, ext in C.EXTENSIONS.items()
)
_BLACKLIST = " OR ".join(
    f"(language = {quote(language)} AND name = {quote(name)})"
    for language, names in C.BLACKLISTED_IDENTIFIERS.items()
    for name in names
)
_SHARE = "('0x' || substr(md5('7:' || doc_id), 1, 7))::BIGINT / 268435456e0"

SQL = {
    "path_filter": f"""
WITH files AS (
  SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '/index.js' WHEN 1 THEN '/vendor/x.rb'
    WHEN 2 THEN '/Tests/x.py' WHEN 3 THEN '/main.go' WHEN 4 THEN '/dist/a.min.js' ELSE '' END AS path
  FROM pages),
known AS (SELECT *, CASE {_EXTENSION} END AS language FROM files)
SELECT page_id, path, language FROM known WHERE language IS NOT NULL AND NOT ({_IGNORED})""",
    "size_filter": """
SELECT doc_id, length(repeat(text, 5))::INTEGER AS n FROM documents WHERE length(repeat(text, 5)) <= 100000""",
    "min_tokens": f"""
WITH {_LEXED} SELECT doc_id, len(code_tokens)::INTEGER AS n FROM lexed WHERE len(code_tokens) > 1""",
    "code_document": f"""
WITH {_LEXED}
SELECT doc_id, language, path, identifier, {sql_strip(sql_summary('text'))} AS docstring_summary,
  md5({sql_strip('text')}) AS docstring, md5({sql_strip('text')}) AS code,
  {sql_joined(sql_docstring_tokens(sql_summary('text')))} AS docstring_tokens,
  1 AS start_line, len(string_split(text, chr(10)))::INTEGER AS end_line
FROM lexed""",
    "blacklist_anti": f"""
WITH d AS (
  SELECT p_partkey, p_brand,
    CASE p_size % 3 WHEN 0 THEN 'java' WHEN 1 THEN 'javascript' ELSE 'php' END AS language,
    CASE p_size % 5 WHEN 0 THEN 'toString' WHEN 1 THEN 'valueOf' WHEN 2 THEN 'equals'
      WHEN 3 THEN 'clone' ELSE 'run' END AS name
  FROM part)
SELECT p_partkey, language, p_brand || '.' || name AS identifier FROM d WHERE NOT ({_BLACKLIST})""",
    "relative_path": """
SELECT page_id, ltrim(substr(url, length(regexp_extract(url, '^[a-z]+://[^/]+')) + 1), '/') AS path
FROM pages""",
    "valid_training_docs": f"""
WITH {_PREPROCESSED} SELECT doc_id, len(query_tokens)::INTEGER AS n FROM pre WHERE len(query_tokens) > 0""",
    "preprocess_doc": f"""
WITH {_PREPROCESSED}
SELECT doc_id, language, identifier, NULL::VARCHAR AS url,
  {sql_joined('query_tokens')} AS query_tokens, md5({sql_joined('code_tokens')}) AS code_tokens FROM pre""",
    "dedupe_docs": f"""
WITH {DOCS}
SELECT repo, language, min(doc_id) AS doc_id FROM docs GROUP BY repo, language, text""",
    "dedupe_across_repos": f"""
WITH {DOCS}
SELECT language, min(doc_id) AS doc_id FROM docs GROUP BY language, text""",
    "row_index": f"""
WITH {DOCS}
SELECT doc_id, repo, language,
  row_number() OVER (PARTITION BY repo, language ORDER BY path) - 1 AS row_index FROM docs""",
    "split_sets": f"""
SELECT doc_id, CASE WHEN {_SHARE} < 0.8 THEN 'train' WHEN {_SHARE} < 0.9 THEN 'valid' ELSE 'test' END AS "set"
FROM documents""",
    "sample_gate": f"""
WITH {DOCS},
n AS (SELECT repo, language, count(*) AS n FROM docs GROUP BY ALL)
SELECT repo, min(n) AS fewest, CASE WHEN bool_and(n >= 5) THEN 1 ELSE 2 END AS update_status
FROM n GROUP BY repo""",
    "corpus_union": f"""
WITH {DOCS}
SELECT 'all' AS "set", language, identifier, md5(text) AS code, len(string_split(text, ' '))::INTEGER AS n_tokens FROM docs
UNION ALL
SELECT 'train', language, identifier, NULL, len(string_split(text, ' '))::INTEGER FROM docs""",
    "corpus_size": f"""
WITH {DOCS} SELECT language, count(*) AS n FROM docs GROUP BY language ORDER BY language""",
    "languages_by_sets": f"""
WITH {DOCS}
SELECT DISTINCT language, s AS "set"
FROM docs, (SELECT unnest(['train', 'valid', 'test', 'all']) AS s)""",
}
