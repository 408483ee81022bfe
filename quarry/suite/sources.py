"""Sources and sinks: a given table written, read back and compared with SQL over it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry import constants as C
from quarry.operators import corpus as O, encoding
from quarry.session import materialise, shared_folder
from quarry.sources import catalogue as K, files as S
from quarry.suite.common import DOCS, LANGUAGE_OF, documents, joined, sql_code_tokens, sql_strip, table
from quarry.suite.publication import repository_files, whole_files

DOCUMENT = "doc_id long, text string, lang string"


def _place(spark, name):
    return f"{shared_folder(spark)}/quarry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _round_trip(format_, schema=None):
    def query(spark, folder):
        path = _place(spark, "corpus")
        S.save(table(spark, folder, "documents").select("doc_id", "text", "lang"), format_, path)
        return S.load(spark, format_, path, schema).select("doc_id", "lang", F.md5(F.col("text")).alias("text"))

    return query


def roundtrip_matrix(spark, folder):
    path = _place(spark, "matrix")
    S.save(table(spark, folder, "embeddings").select("vec_id", "embedding"), "matrix", path)
    back = S.load(spark, "matrix", path)
    return back.select("vec_id", F.size("embedding").alias("width"), F.element_at("embedding", 1).alias("first"))


def load_shards(spark, folder):
    """The documents of each language as one set of shards."""
    base = _place(spark, "shards")
    docs = table(spark, folder, "documents")
    for lang in LANGUAGE_OF:
        own = docs.filter(F.col("lang") == lang).select(F.col("text").alias("func_name"), F.col("doc_id").cast("string").alias("url"))
        own.write.option("compression", "gzip").json(f"{base}/{lang}/final/jsonl/train")
    found = S.load_shards(spark, base, "train")
    return found.select(F.col("url").cast("long").alias("doc_id"), "language", "set", F.md5("func_name").alias("text"))


def replace_documents(spark, folder):
    """All documents published by source; then those of one source again, changed."""
    path = _place(spark, "documents")
    docs = table(spark, folder, "documents").select(
        F.lit("org").alias("organization"), F.col("source").alias("name"), "doc_id",
        F.col("lang").alias("language"), F.sha1("text").alias("code_hash"), F.lit(1).alias("version"),
    )
    K.replace_documents(docs, path)
    K.replace_documents(docs.filter("name = 'src3' AND language = 'en'").withColumn("version", F.lit(2)), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("organization", "name", "version").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def register_repositories(spark, folder):
    """Suppliers with the kinds of their lines as languages, in the two stored tables."""
    path = _place(spark, "repositories")
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.array_sort(F.collect_set("l_returnflag")).alias("languages")
    )
    named = table(spark, folder, "supplier").join(lines, "s_suppkey").select(
        F.col("s_nationkey").cast("string").alias("organization"), F.col("s_name").alias("name"), "languages"
    )
    K.register_repositories(named, path)
    repositories = spark.read.parquet(f"{path}/repository").select("organization", "name", "update_status")
    return repositories.join(spark.read.parquet(f"{path}/repository_language"), ["organization", "name"])


def log_queries(spark, folder):
    path = _place(spark, "log")
    queries = table(spark, folder, "benchmark").select(F.col("text").alias("query"))
    for _ in range(2):
        K.log_queries(queries, path)
    return spark.read.parquet(path).groupBy(F.md5("query").alias("query")).agg(F.count("created_at").alias("n"))


def save_predictions(spark, folder):
    path = _place(spark, "predictions")
    docs = table(spark, folder, "documents")
    S.save_predictions(
        docs.select(
            F.col("source").alias("query"), F.col("lang").alias("language"),
            F.concat(F.lit('a "name", '), F.col("doc_id").cast("string")).alias("identifier"), F.col("doc_id").alias("url"),
        ),
        path,
    )
    schema = "query string, language string, identifier string, url long"
    return spark.read.option("header", True).option("escape", "\\").schema(schema).csv(path)


def dedupe_same_line(spark, folder):
    """First copies where many contents stand at one position."""
    docs = table(spark, folder, "documents").select(
        "source", F.lit("one path").alias("path"), (F.col("doc_id") % 7).alias("line"), F.col("text").alias("code")
    )
    firsts = O.first_copies(docs, ["source"], "code", ["path", "line"])
    return firsts.select("source", "line", F.md5("code").alias("code"))


def encode_no_pieces(spark, folder):
    """A vocabulary of words alone: unknown words become marks and unknown ids."""
    docs = table(spark, folder, "documents").select(
        "doc_id", F.lit("s").alias("scope"),
        F.concat(F.split("text", " "), F.array("lang")).alias("tokens"),
    )
    words = table(spark, folder, "documents").groupBy("lang").count().select(
        F.lit("s").alias("scope"), F.lit("word").alias("kind"), F.col("lang").alias("token"),
        (F.ascii("lang") + 10).alias("id"), "count",
    )
    words = materialise(words, "words")
    return encoding.encode(docs, ["doc_id"], words, 300).select("doc_id", joined(F.col("ids")).alias("ids"))


def evaluation_list(spark, folder):
    """The benchmark texts as a list of queries: a header, then one a line."""
    path = _place(spark, "queries")
    texts = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("n"), F.regexp_replace("text", r"[\r\n]+", " ").alias("value")
    )
    header = texts.limit(1).select(F.lit(-1).cast("long").alias("n"), F.lit("query").alias("value"))
    # One list is one file.
    header.unionByName(texts).orderBy("n").coalesce(1).select("value").write.text(path)
    return S.evaluation_queries(spark, path).select("query_id", F.md5("query").alias("query"))


def _shipped(spark, folder):
    """Suppliers as repositories with the kinds of their lines as languages."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.array_sort(F.collect_set("l_returnflag")).alias("languages")
    )
    return table(spark, folder, "supplier").join(lines, "s_suppkey").select(
        "s_suppkey", F.concat(F.lit("nation, "), F.col("s_nationkey").cast("string")).alias("organization"),
        F.col("s_name").alias("name"), "languages",
    )


def repository_list(spark, folder):
    """A list of repositories in CSV, whose organizations hold commas."""
    path = _place(spark, "list")
    rows = _shipped(spark, folder).select(
        "organization", "name", F.lit('a "quoted" text').alias("description"), F.lit(None).cast("string").alias("commit_hash"),
        F.array_join("languages", "|").alias("languages"),
    )
    rows.write.option("header", True).csv(path)
    return S.repository_list(spark, path).select(
        "organization", "name", F.explode("languages").alias("language"), F.col("commit_hash").isNull().alias("fresh")
    )


def register_one(spark, folder):
    """All repositories but the first are registered together, that one by itself."""
    path = _place(spark, "repositories")
    shipped = materialise(_shipped(spark, folder), "shipped")
    first = shipped.orderBy("s_suppkey").first()
    others = shipped.where(F.col("s_suppkey") != first["s_suppkey"]).drop("s_suppkey")
    texts = {"description": F.lit("text"), "commit_hash": F.lit(None).cast("string")}
    K.register_repositories(others.withColumns(texts), path)
    single = K.one_repository(spark, first["organization"], first["name"], ",".join(first["languages"]), "text")
    K.register_repositories(single, path)
    known = spark.read.parquet(f"{path}/repository").select("organization", "name", "description", "update_status")
    return known.join(K.repository_languages(spark.read.parquet(f"{path}/repository_language")), ["organization", "name"]).withColumn(
        "languages", joined(F.col("languages"))
    )


def relevance_list(spark, folder):
    """Documents as annotations, nested by language, query and url, an object a line."""
    path = _place(spark, "annotations")
    scores = table(spark, folder, "documents").select(
        "lang", "source", F.col("doc_id").cast("string").alias("url"), (F.col("n_chars") % 4).cast("double").alias("score"),
        F.expr("doc_id div 64").alias("line"),
    )
    urls = F.map_from_entries(F.collect_list(F.struct("url", "score")))
    nested = scores.groupBy("lang", "source", "line").agg(urls.alias("urls"))
    nested.select(F.to_json(F.create_map("lang", F.create_map("source", "urls")))).write.text(path)
    return S.relevance_annotations(spark, path, lines=True)


def language_table(spark, folder):
    """The table of languages, written twice, with the documents of each."""
    path = _place(spark, "languages")
    for _ in range(2):
        K.refresh_languages(spark, path)
    counted = documents(spark, folder).groupBy(F.col("language").alias("name")).agg(F.count("*").alias("n"))
    return spark.read.parquet(path).join(counted, "name", "left")


def cleared_cache(spark, folder):
    """Lengths of all texts through a cache, which is cleared; then of every second document, twice."""
    path, schema = _place(spark, "cache"), "cache_key string, n_chars long"
    K.clear_cache(spark, path, schema)
    keyed = table(spark, folder, "documents").select("doc_id", F.sha1("text").alias("cache_key"), F.length("text").alias("n_chars"))

    def compute(misses):
        return misses.select("cache_key", F.col("n_chars").cast("long")).distinct()

    K.with_cache(keyed, path, schema, compute)
    K.clear_cache(spark, path, schema)
    for _ in range(2):
        K.with_cache(keyed.where("doc_id % 2 = 0"), path, schema, compute)
    return spark.read.schema(schema).parquet(path).groupBy("cache_key").agg(
        F.min("n_chars").alias("n_chars"), F.count("*").alias("rows")
    )


def extract_documents(spark, folder):
    """All documents as files of their repositories, each file one definition."""
    files = repository_files(spark, folder).withColumn("commit_hash", F.lit("c"))
    found = O.extract(files.drop("number", "doc_id"), whole_files, ["organization", "name", "commit_hash"])
    return found.select("name", "language", "path", "start_line", F.sha1("code").alias("code_hash"))


QUERIES = {
    **{
        f.__name__: f
        for f in [
            evaluation_list, repository_list, register_one, relevance_list, language_table, cleared_cache, extract_documents,
        ]
    },
    "roundtrip_jsonl": _round_trip("jsonl", DOCUMENT),
    "roundtrip_jsonl_gzip": _round_trip("jsonl-gzip", DOCUMENT),
    "roundtrip_table": _round_trip("table"),
    "roundtrip_matrix": roundtrip_matrix,
    "load_shards": load_shards,
    "replace_documents": replace_documents,
    "register_repositories": register_repositories,
    "log_queries": log_queries,
    "save_predictions": save_predictions,
    "dedupe_same_line": dedupe_same_line,
    "encode_no_pieces": encode_no_pieces,
}

_DOCUMENTS = "SELECT doc_id, lang, md5(text) AS text FROM documents"
_SHIPPED = """SELECT DISTINCT 'nation, ' || s_nationkey AS organization, s_name AS name, l_returnflag AS language
FROM supplier JOIN lineitem ON l_suppkey = s_suppkey"""
_LANGUAGES = ", ".join(f"({i}, '{name}')" for i, name in enumerate(C.LANGUAGES, 1))
SQL = {
    "evaluation_list": """
SELECT (row_number() OVER (ORDER BY item_id) - 1)::INTEGER AS query_id,
  md5(trim(regexp_replace(text, '[\r\n]+', ' ', 'g'), ' ')) AS query FROM benchmark""",
    "repository_list": f"SELECT *, true AS fresh FROM ({_SHIPPED})",
    "register_one": f"""
SELECT organization, name, 'text' AS description, 0 AS update_status, string_agg(language, '|' ORDER BY language) AS languages
FROM ({_SHIPPED}) GROUP BY ALL""",
    "relevance_list": """
SELECT lang AS language, source AS query, doc_id::VARCHAR AS url, (n_chars % 4)::DOUBLE AS relevance FROM documents""",
    "language_table": f"""
WITH {DOCS}, counted AS (SELECT language AS name, count(*) AS n FROM docs GROUP BY ALL)
SELECT l.id, l.name, n FROM (VALUES {_LANGUAGES}) AS l(id, name) LEFT JOIN counted c ON c.name = l.name""",
    "cleared_cache": """
SELECT sha1(text) AS cache_key, any_value(length(text)) AS n_chars, 1::BIGINT AS rows
FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL GROUP BY text""",
    "extract_documents": f"""
WITH {DOCS},
files AS (
  SELECT repo AS name, CASE language WHEN 'python' THEN 'python' ELSE 'go' END AS language, text,
    regexp_replace(path, '[.][A-Za-z]+$', '') || CASE language WHEN 'python' THEN '.py' ELSE '.go' END AS path FROM docs),
lexed AS (
  SELECT name, language, path, {sql_strip('text')} AS code FROM files
  WHERE length(text) <= {C.MAX_FILE_CHARS} AND len({sql_code_tokens('language', 'text')}) > 1)
SELECT name, language, min(path) AS path, 1 AS start_line, sha1(code) AS code_hash FROM lexed GROUP BY name, language, code""",
    "roundtrip_jsonl": _DOCUMENTS,
    "roundtrip_jsonl_gzip": _DOCUMENTS,
    "roundtrip_table": _DOCUMENTS,
    "roundtrip_matrix": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width, embedding[1] AS first FROM embeddings",
    "load_shards": "SELECT doc_id, lang AS language, 'train' AS set, md5(text) AS text FROM documents",
    "replace_documents": """
WITH again AS (SELECT * FROM documents WHERE source = 'src3' AND lang = 'en')
SELECT 'org' AS organization, source AS name, 1 AS version, count(*) AS n, min(doc_id) AS first
FROM documents WHERE source <> 'src3' OR NOT EXISTS (SELECT * FROM again) GROUP BY source
UNION ALL
SELECT 'org', source, 2, count(*), min(doc_id) FROM again GROUP BY source""",
    "register_repositories": """
SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS organization, s_name AS name, 0 AS update_status, l_returnflag AS language
FROM supplier JOIN lineitem ON l_suppkey = s_suppkey""",
    "log_queries": "SELECT md5(text) AS query, 2 * count(*) AS n FROM benchmark GROUP BY text",
    "save_predictions": """
SELECT source AS query, lang AS language, 'a "name", ' || doc_id AS identifier, doc_id AS url FROM documents""",
    "dedupe_same_line": """
SELECT source, min(doc_id % 7) AS line, md5(text) AS code FROM documents GROUP BY source, text""",
    "encode_no_pieces": """
WITH known AS (SELECT DISTINCT lang AS word, ascii(lang) + 10 AS id FROM documents),
words AS (
  SELECT doc_id, unnest(list_append(string_split(text, ' '), lang)) AS word,
    generate_subscripts(list_append(string_split(text, ' '), lang), 1) AS p FROM documents),
cut AS (
  SELECT doc_id, p, CASE WHEN id IS NULL THEN list_resize([]::INTEGER[], length(w.word) + 2, 1) ELSE [id] END AS ids
  FROM words w LEFT JOIN known k ON k.word = w.word)
SELECT doc_id, array_to_string(list_resize(flatten(list(ids ORDER BY p)), 300, 0), '|') AS ids
FROM cut GROUP BY doc_id""",
}
