"""Test tables in their roles, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry import constants as C
from quarry.functions import text as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(names: list[str]) -> str:
    return "(" + ", ".join(quote(name) for name in names) + ")"


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, "|")


def sql_joined(tokens: str) -> str:
    return f"array_to_string({tokens}, '|')"


def rounded(value: Column, digits: int = 6) -> Column:
    return F.round(value, digits) + F.lit(0.0)


# --- Documents as code documents ---------------------------------------------

LANGUAGE_OF = {"en": "python", "fr": "java", "de": "go", "es": "php"}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    lang = F.col("lang")
    language = F.when(lang == "en", "python").when(lang == "fr", "java").when(lang == "de", "go")
    extension = F.when(lang == "en", "py").when(lang == "fr", "java").when(lang == "de", "go")
    return table(spark, folder, "documents").select(
        "doc_id",
        F.col("source").alias("repo"),
        language.otherwise("php").alias("language"),
        F.format_string("%s/%s/Doc%d.%s", "source", "lang", "doc_id", extension.otherwise("php"))
        .alias("path"),
        F.format_string("%sDoc_%s%d", "source", "lang", "doc_id").alias("identifier"),
        "text",
        "n_chars",
    )


DOCS = """docs AS (
  SELECT doc_id, source AS repo, text, n_chars,
    CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'java' WHEN 'de' THEN 'go' ELSE 'php' END
      AS language,
    source || '/' || lang || '/Doc' || doc_id || '.' ||
      CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'java' WHEN 'de' THEN 'go' ELSE 'php' END AS path,
    source || 'Doc_' || lang || doc_id AS identifier
  FROM documents)"""


# --- Text expressions in SQL --------------------------------------------------


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, {quote(rf'\A{C.BLANK}+|{C.BLANK}+\z')}, '', 'g')"


def sql_docstring_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {quote(C.DOCSTRING_TOKEN)})"


def sql_summary(x: str) -> str:
    return (
        f"CASE WHEN contains({x}, chr(10) || chr(10)) THEN split_part({x}, chr(10) || chr(10), 1) "
        f"ELSE split_part({x}, '@', 1) END"
    )


def sql_code_tokens(language: str, code: str) -> str:
    tail = [C.LEX_STRING, C.LEX_WORD, C.LEX_NUMBER, C.LEX_SYMBOL]
    both = quote("|".join([C.LEX_HASH_COMMENT, C.LEX_SLASH_COMMENT, *tail]))
    hashed = quote("|".join([C.LEX_HASH_COMMENT, *tail]))
    slashed = quote("|".join([C.LEX_SLASH_COMMENT, *tail]))
    return (
        f"CASE {language} WHEN 'php' THEN regexp_extract_all({code}, {both}) "
        f"WHEN 'python' THEN regexp_extract_all({code}, {hashed}) "
        f"ELSE regexp_extract_all({code}, {slashed}) END"
    )


def sql_is_comment(language: str, token: str) -> str:
    return (
        f"(({language} IN {listed(C.HASH_COMMENT_LANGUAGES)} AND starts_with({token}, '#')) OR "
        f"({language} IN {listed(C.SLASH_COMMENT_LANGUAGES)} AND "
        f"(starts_with({token}, '//') OR starts_with({token}, '/*'))))"
    )


def sql_normal_code(language: str, tokens: str) -> str:
    return (
        f"list_transform(list_filter({tokens}, lambda t: NOT {sql_is_comment(language, 't')}), "
        f"lambda t: {sql_strip('lower(t)')})"
    )


def sql_normal_query(tokens: str) -> str:
    return f"list_transform({tokens}, lambda t: {sql_strip('lower(t)')})"


def sql_sub_tokens(token: str) -> str:
    humps = r"regexp_replace(p, '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    parts = (
        f"flatten(list_transform(regexp_split_to_array({token}, '[._]'), lambda p: "
        f"CASE WHEN regexp_matches(p, '^[_a-zA-Z]') THEN string_split({humps}, ' ') ELSE [p] END))"
    )
    return (
        f"CASE WHEN regexp_matches({token}, {quote('^[rf]?[' + chr(39) + chr(34) + ']')}) "
        f"THEN [{token}] ELSE "
        f"list_filter(list_transform({parts}, lambda p: {sql_strip('p')}), lambda p: length(p) > 0) END"
    )


def sql_query_tokens(tokens: str, identifier: str) -> str:
    return (
        f"CASE WHEN len({tokens}) > 0 THEN {sql_normal_query(tokens)} "
        f"WHEN length({identifier}) >= {C.MIN_IDENTIFIER_QUERY_LENGTH} "
        f"THEN {sql_sub_tokens(identifier)} ELSE [] END"
    )


# --- Code tokens of documents and tokens of text queries -----------------------


def code_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, scope (the language) and normalised code tokens."""
    docs = documents(spark, folder).select("doc_id", "language", "text")
    tokens = T.normalised_code_tokens(
        F.col("language"), T.code_tokens(F.col("language"), F.col("text"))
    )
    return docs.select("doc_id", "language", F.col("language").alias("scope"), tokens.alias("tokens"))


def text_queries(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, scope ``query`` and normalised tokens of the benchmark texts."""
    tokens = T.normalised_query_tokens(T.text_query_tokens(F.col("text")))
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("query").alias("scope"), tokens.alias("tokens")
    )


CODE_DOCS = (
    DOCS
    + f""",
code_docs AS (
  SELECT doc_id, language, language AS scope,
    {sql_normal_code('language', 'lexed')} AS tokens
  FROM (SELECT doc_id, language, {sql_code_tokens('language', 'text')} AS lexed FROM docs))"""
)

TEXT_QUERIES = f"""text_queries AS (
  SELECT item_id AS query_id, 'query' AS scope,
    {sql_normal_query("string_split(text, ' ')")} AS tokens
  FROM benchmark)"""
