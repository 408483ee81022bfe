"""File formats: corpora, evaluation lists, annotations, source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quarry import constants as C

STRINGS = T.ArrayType(T.StringType())
DEDUPLICATED_SCHEMA = (
    "identifier string, url string, docstring_tokens array<string>, "
    "function string, function_tokens array<string>"
)
SET_SCHEMA = (
    "func_name string, url string, docstring_tokens array<string>, code_tokens array<string>"
)
DOCUMENT_SCHEMA = (
    "language string, path string, identifier string, docstring string, "
    "docstring_summary string, docstring_tokens array<string>, code string, "
    "code_tokens array<string>, start_line int, end_line int"
)
PREPROCESSED_SCHEMA = (
    "identifier string, url string, query_tokens array<string>, code_tokens array<string>"
)

# Known formats and the Spark source and options behind each.
FORMATS = {
    "jsonl": ("json", {}),
    "jsonl-gzip": ("json", {"compression": "gzip"}),
    "matrix": ("parquet", {}),
    "table": ("parquet", {}),
}
EXTENSIONS = {"jsonl": "jsonl", "jsonl-gzip": "jsonl.gz", "matrix": "parquet", "table": "parquet"}


def _format(name: str) -> tuple[str, dict]:
    if name not in FORMATS:
        raise ValueError(f"{name} is not a known format; use one of {', '.join(FORMATS)}")
    return FORMATS[name]


def with_extension(format_: str, path: str) -> str:
    _format(format_)
    return f"{path}.{EXTENSIONS[format_]}"


def save(df: DataFrame, format_: str, path: str, mode: str = "overwrite") -> None:
    source, options = _format(format_)
    target = with_extension(format_, path)
    df.write.format(source).options(**options).mode(mode).save(target)


def load(spark: SparkSession, format_: str, path: str, schema=None) -> DataFrame:
    """Read one format; JSON wants its schema, so that no pass infers it."""
    source, _ = _format(format_)
    reader = spark.read.format(source)
    if schema is not None:
        reader = reader.schema(schema)
    elif source == "json":
        raise ValueError("a JSON corpus needs its schema")
    return reader.load(with_extension(format_, path))


def load_shards(spark: SparkSession, base: str, set_name: str, schema: str = SET_SCHEMA) -> DataFrame:
    """All shards of one set for all languages, as they are distributed:
    ``base/<language>/final/jsonl/<set>/<language>_<set>_<i>.jsonl.gz``, or
    without the two folders between.

    A gzip file is one split, so a corpus read more than once should be
    saved as a table first.
    """
    language = F.regexp_extract(
        F.input_file_name(), rf"([^/]+)/(?:final/jsonl/)?{set_name}/[^/]+$", 1
    )
    return (
        spark.read.schema(schema)
        .json(f"{base}/*/{{{set_name},final/jsonl/{set_name}}}/*")
        .withColumn("language", language)
        .withColumn("set", F.lit(set_name))
    )


def evaluation_queries(spark: SparkSession, path: str) -> DataFrame:
    """One query per line after the header; commas and quotes are kept.

    The list is one small file read as one text value, so that lines keep
    their order.
    """
    lines = F.split(F.regexp_replace("value", r"\n\z", ""), "\n")
    return (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(lines).alias("query_id", "query"))
        .filter(F.col("query_id") > 0)
        .select((F.col("query_id") - 1).alias("query_id"), F.trim("query").alias("query"))
    )


def repository_list(spark: SparkSession, path: str) -> DataFrame:
    """Repositories from CSV with a header; languages are split at bars."""
    schema = (
        "organization string, name string, description string, commit_hash string, languages string"
    )
    header = spark.read.option("header", True).csv(path)
    return header.select(
        *[F.col(field.name).cast(field.dataType) for field in T._parse_datatype_string(schema)]
    ).withColumn("languages", F.split("languages", r"\|"))


def relevance_annotations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested language → query → url → score JSON as flat rows.

    One object is read whole; with ``lines`` every line is an object of its
    own, so that a large list is split like any text.
    """
    nested = "map<string, map<string, map<string, double>>>"
    return (
        spark.read.text(path, wholetext=not lines)
        .select(F.from_json("value", nested).alias("by_language"))
        .select(F.explode("by_language").alias("language", "by_query"))
        .select("language", F.explode("by_query").alias("query", "by_url"))
        .select("language", "query", F.explode("by_url").alias("url", "relevance"))
    )


def save_predictions(predictions: DataFrame, path: str) -> None:
    predictions.select("query", "language", "identifier", "url").write.option("header", True).mode(
        "overwrite"
    ).csv(path)


def source_tree(spark: SparkSession, root: str, language: str | None = None) -> DataFrame:
    """Every source file below ``root``: path relative to it, text, language.

    Files that vanish or are not valid UTF-8 are skipped.
    """
    extensions = [C.EXTENSIONS[language]] if language else sorted(C.EXTENSIONS.values())
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .option("ignoreMissingFiles", True)
        .load(root)
    )
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    # The qualified root is a prefix of every path; what follows its slash is relative.
    below = F.substring(F.col("path"), len(base.rstrip("/")) + 2, 1 << 20)
    return files.filter(F.is_valid_utf8(F.col("content").cast("string"))).select(
        below.alias("path"), F.col("content").cast("string").alias("text")
    )
