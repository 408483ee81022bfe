"""Text, path and hash expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions import text as T
from quarry.suite.common import (
    DOCS, documents, joined, quote, sql_code_tokens, sql_docstring_tokens, sql_is_comment,
    sql_joined, sql_normal_code, sql_query_tokens, sql_strip, sql_sub_tokens, sql_summary, table,
)


def docstring_tokens(spark, folder):
    tokens = T.docstring_tokens(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", "text").select(
        "doc_id", F.size(tokens).alias("n_tokens"), joined(tokens).alias("tokens")
    )


def docstring_summary(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", T.docstring_summary(F.col("text")).alias("summary")
    )


def _as_comment(text):
    return F.concat(F.lit("/**\n * "), F.replace(text, F.lit("\n"), F.lit("\n * ")), F.lit("\n */"))


def strip_comments(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", T.strip_comment_delimiters(_as_comment(F.col("text"))).alias("comment")
    )


def line_comment_join(spark, folder):
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit(" ## "), x, F.lit(" #")))
    return table(spark, folder, "documents").select(
        "doc_id", T.join_line_comments(lines).alias("docstring")
    )


def sub_tokens(spark, folder):
    """Every distinct word, bare and glued into an identifier."""
    word = F.col("word")
    words = table(spark, folder, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    words = words.distinct()
    glued = F.concat(F.lit("get_"), F.lower(word), F.lit("X"), word, F.lit(".x"), word)
    tokens = words.select(F.explode(F.array(word, glued)).alias("token")).distinct()
    return tokens.select("token", joined(T.sub_tokens(F.col("token"))).alias("sub_tokens"))


def _commented(text):
    return F.replace(text, F.lit(" "), F.lit(" /* a\nb */ // c\n# d\n"))


def comment_tokens(spark, folder):
    docs = documents(spark, folder)
    language = F.col("language")
    lexed = docs.select("doc_id", "language", T.code_tokens(language, _commented(F.col("text"))).alias("all"))
    parted = lexed.select("doc_id", "all", T.without_comments(language, F.col("all")).alias("kept"))
    # The lexer gives no null token, so those that are not kept are comments.
    comments = F.when(F.col("all").isNull(), F.size("all")).otherwise(F.size("all") - F.size("kept"))
    return parted.select(
        "doc_id",
        F.size("all").alias("n_tokens"),
        comments.alias("n_comments"),
        F.md5(joined(F.col("kept"))).alias("kept"),
    )


def normalize_code(spark, folder):
    language = F.col("language")
    return documents(spark, folder).select(
        "doc_id",
        joined(T.normalised_code_tokens(language, T.code_tokens(language, F.col("text")))).alias("tokens"),
    )


def query_tokens(spark, folder):
    """Short documents have no docstring and fall back on the identifier."""
    docstring = F.when(F.col("n_chars") < 500, "").otherwise(T.docstring_summary(F.col("text")))
    tokens = T.query_tokens(T.docstring_tokens(docstring), F.col("identifier"))
    return documents(spark, folder).select("doc_id", joined(tokens).alias("tokens"))


def code_lex(spark, folder):
    tokens = T.code_tokens(F.col("language"), F.col("text"))
    return documents(spark, folder).select("doc_id", "language", "text").select(
        "doc_id", F.size(tokens).alias("n_tokens"), joined(tokens).alias("tokens")
    )


def string_clean(spark, folder):
    literal = F.concat(F.lit('  """\''), F.col("text"), F.lit('\'""" \n'))
    return table(spark, folder, "documents").select(
        "doc_id", T.clean_quoted_docstring(literal).alias("docstring")
    )


def qualified_identifier(spark, folder):
    scope = F.when(F.col("p_type") != "SMALL", F.col("p_type"))
    identifier = T.qualified_identifier(scope, F.col("p_name"))
    return table(spark, folder, "part").select(
        "p_partkey", identifier.alias("identifier"), T.bare_identifier(identifier).alias("name")
    )


def basename_ext_language(spark, folder):
    paths = documents(spark, folder).select("path").unionByName(
        table(spark, folder, "pages").select(F.col("url").alias("path"))
    )
    path = F.col("path")
    return paths.select(
        "path", T.basename(path).alias("filename"), T.language_of_file(path).alias("language")
    )


def capitalize(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", T.capitalised(F.col("p_name")).alias("name")
    )


def doc_label(spark, folder):
    identifier = F.when(F.col("n_chars") < 500, "").otherwise(F.col("identifier"))
    return documents(spark, folder).select(
        "doc_id", T.document_label(F.col("language"), identifier, F.col("text")).alias("label")
    )


def code_hash(spark, folder):
    return documents(spark, folder).select(
        "doc_id",
        F.sha1("text").alias("code_hash"),
        T.cache_key("query", F.lit("org"), F.col("repo"), F.col("text")).alias("query_key"),
        T.cache_key("similar_code_documents", F.lit("org"), F.col("repo"), F.sha1("text")).alias("similar_key"),
    )


def doc_url(spark, folder):
    lines = F.size(F.split("text", "\n"))
    return documents(spark, folder).select(
        "doc_id",
        T.source_url(
            F.lit("org"), F.col("repo"), F.substring(F.sha1("repo"), 1, 7), F.col("path"), F.lit(1), lines
        ).alias("url"),
    )


def _filtered_query():
    n = F.length("text") % 3
    tail = F.when(n == 0, " +language=Python,go").when(n == 1, " +language=Ruby").otherwise("")
    return F.concat("text", tail)


def language_filter(spark, folder):
    query = _filtered_query()
    return table(spark, folder, "benchmark").select(
        "item_id",
        F.array_join(T.filter_languages(query), ",").alias("languages"),
        T.without_filter(query).alias("query"),
    )


QUERIES = {
    f.__name__: f
    for f in [
        docstring_tokens, docstring_summary, strip_comments, line_comment_join, sub_tokens,
        comment_tokens, normalize_code, query_tokens, code_lex, string_clean, qualified_identifier,
        basename_ext_language, capitalize, doc_label, code_hash, doc_url, language_filter,
    ]
}

_COMMENT = r"'/**' || chr(10) || ' * ' || replace(text, chr(10), chr(10) || ' * ') || chr(10) || ' */'"
_COMMENTED = (
    "replace(text, ' ', ' /* a' || chr(10) || 'b */ // c' || chr(10) || '# d' || chr(10))"
)
_EXTENSION = "string_split(string_split(path, '/')[-1], '.')[-1]"
_FILTERED = (
    "text || CASE length(text) % 3 WHEN 0 THEN ' +language=Python,go' "
    "WHEN 1 THEN ' +language=Ruby' ELSE '' END"
)

SQL = {
    "docstring_tokens": f"""
SELECT doc_id, len(t)::INTEGER AS n_tokens, {sql_joined('t')} AS tokens
FROM (SELECT doc_id, {sql_docstring_tokens('text')} AS t FROM documents)""",
    "docstring_summary": f"SELECT doc_id, {sql_summary('text')} AS summary FROM documents",
    "strip_comments": f"""
SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(
    string_split({_COMMENT}, chr(10)),
    lambda x: regexp_replace(regexp_replace({sql_strip('x')}, '\\*/\\z', ''), {quote(C.COMMENT_OPENING)}, '')),
    lambda x: length(x) > 0), lambda x: {sql_strip('x')}), chr(10)) AS comment
FROM documents""",
    "line_comment_join": f"""
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
    lambda x: trim({sql_strip("' ## ' || x || ' #'")}, '#')), chr(10)) AS docstring
FROM documents""",
    "sub_tokens": f"""
WITH words AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents),
tokens AS (
  SELECT word AS token FROM words
  UNION SELECT 'get_' || lower(word) || 'X' || word || '.x' || word FROM words)
SELECT token, {sql_joined(sql_sub_tokens('token'))} AS sub_tokens FROM tokens""",
    "comment_tokens": f"""
WITH {DOCS},
lexed AS (SELECT doc_id, language, {sql_code_tokens('language', _COMMENTED)} AS t FROM docs)
SELECT doc_id, len(t)::INTEGER AS n_tokens,
  len(list_filter(t, lambda x: {sql_is_comment('language', 'x')}))::INTEGER AS n_comments,
  md5({sql_joined(f"list_filter(t, lambda x: NOT {sql_is_comment('language', 'x')})")}) AS kept
FROM lexed""",
    "normalize_code": f"""
WITH {DOCS},
lexed AS (SELECT doc_id, language, {sql_code_tokens('language', 'text')} AS t FROM docs)
SELECT doc_id, {sql_joined(sql_normal_code('language', 't'))} AS tokens FROM lexed""",
    "query_tokens": f"""
WITH {DOCS},
found AS (SELECT doc_id, identifier,
  {sql_docstring_tokens(f"CASE WHEN n_chars < 500 THEN '' ELSE {sql_summary('text')} END")} AS t FROM docs)
SELECT doc_id, {sql_joined(sql_query_tokens('t', 'identifier'))} AS tokens FROM found""",
    "code_lex": f"""
WITH {DOCS}
SELECT doc_id, len(t)::INTEGER AS n_tokens, {sql_joined('t')} AS tokens
FROM (SELECT doc_id, {sql_code_tokens('language', 'text')} AS t FROM docs)""",
    "string_clean": f"""
SELECT doc_id, trim(trim({sql_strip("'  " + '"""' + "''' || text || '''" + '"""' + " ' || chr(10)")}, '"'), '''') AS docstring
FROM documents""",
    "qualified_identifier": """
SELECT p_partkey, concat_ws('.', nullif(p_type, 'SMALL'), p_name) AS identifier,
  string_split(p_name, '.')[-1] AS name FROM part""",
    "basename_ext_language": f"""
WITH {DOCS},
paths AS (SELECT path FROM docs UNION ALL SELECT url FROM pages)
SELECT path, string_split(path, '/')[-1] AS filename,
  CASE {_EXTENSION} WHEN 'py' THEN 'python' WHEN 'rb' THEN 'ruby' WHEN 'go' THEN 'go'
    WHEN 'php' THEN 'php' WHEN 'java' THEN 'java' WHEN 'js' THEN 'javascript' END AS language
FROM paths""",
    "capitalize": """
SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS name FROM part""",
    "doc_label": f"""
WITH {DOCS}
SELECT doc_id, '(' || language || ') ' ||
  CASE WHEN n_chars < 500 THEN substr(text, 1, 32) ELSE identifier END AS label FROM docs""",
    "code_hash": f"""
WITH {DOCS}
SELECT doc_id, sha1(text) AS code_hash, sha1('query:org:' || repo || ':' || text) AS query_key,
  sha1('similar_code_documents:org:' || repo || ':' || sha1(text)) AS similar_key FROM docs""",
    "doc_url": f"""
WITH {DOCS}
SELECT doc_id, 'https://github.com/org/' || repo || '/blob/' || substr(sha1(repo), 1, 7) || '/' ||
  path || '#L1-L' || len(string_split(text, chr(10))) AS url FROM docs""",
    "language_filter": f"""
WITH q AS (SELECT item_id, {_FILTERED} AS query FROM benchmark)
SELECT item_id, CASE WHEN regexp_matches(query, '\\+language=(\\S+)')
    THEN lower(regexp_extract(query, '\\+language=(\\S+)', 1)) END AS languages,
  {sql_strip("regexp_replace(query, '" + C.LANGUAGE_FILTER + "', '', 'g')")} AS query
FROM q""",
}
