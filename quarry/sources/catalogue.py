"""Stored tables: languages, repositories, documents, query log, results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry import constants as C
from quarry.functions import text as T
from quarry.operators.embedding import Model
from quarry.session import materialise
from quarry.sources.keyed import read_keyed, save_keyed

REPOSITORY = ["organization", "name"]


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def save_model(model: Model, path: str) -> None:
    for part, table in model._asdict().items():
        save_table(table, f"{path}/{part}")


def load_model(spark: SparkSession, path: str) -> Model:
    return Model(*[spark.read.parquet(f"{path}/{part}") for part in Model._fields])


def refresh_languages(spark: SparkSession, path: str) -> None:
    rows = ", ".join(f"({i}, '{name}')" for i, name in enumerate(C.LANGUAGES, 1))
    save_table(spark.sql(f"SELECT * FROM VALUES {rows} AS t(id, name)"), path)


def register_repositories(repositories: DataFrame, path: str) -> None:
    """Append repositories and their languages (an array column) as two tables."""
    known = repositories.withColumns(
        {
            "update_status": F.lit(C.UPDATE_IN_PROGRESS),
            "created_at": F.current_timestamp(),
        }
    )
    save_table(known.drop("languages"), f"{path}/repository", "append")
    bridge = repositories.select(*REPOSITORY, F.explode("languages").alias("language"))
    save_table(bridge, f"{path}/repository_language", "append")


def one_repository(
    spark: SparkSession, organization: str, name: str, languages: str, description: str
) -> DataFrame:
    """A single repository; its languages are split at commas."""
    return spark.createDataFrame(
        [(organization, name, description, None, languages.split(","))],
        "organization string, name string, description string, commit_hash string, "
        "languages array<string>",
    )


def stored_documents(documents: DataFrame) -> DataFrame:
    """Extracted documents as stored: source url and content hash added."""
    return documents.select(
        *REPOSITORY,
        "language",
        "path",
        "identifier",
        "code",
        "row_index",
        F.sha1("code").alias("code_hash"),
        T.source_url(
            F.col("organization"), F.col("name"), F.col("commit_hash"),
            F.col("path"), F.col("start_line"), F.col("end_line"),
        ).alias("url"),
    )


def replace_documents(documents: DataFrame, path: str) -> None:
    """Publish whole repositories: each one present in ``documents`` replaces
    its stored rows, the others stay.

    Rebalanced by repository (a large one gets many files) and sorted so that
    language and hash lookups skip row groups.
    """
    (
        documents.hint("rebalance", *REPOSITORY)
        .sortWithinPartitions(*REPOSITORY, "language", "code_hash")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*REPOSITORY)
        .parquet(path)
    )


def log_queries(queries: DataFrame, path: str) -> None:
    save_table(
        queries.select("query", F.current_timestamp().alias("created_at")), path, "append"
    )


def queries_per_day(log: DataFrame, days: int | None = 5, ts: str = "created_at") -> DataFrame:
    """Queries per calendar day, newest first; the report shows five days."""
    counted = (
        log.groupBy(F.date_trunc("day", ts).alias("day"))
        .agg(F.count("*").alias("n_logs"))
        .orderBy(F.col("day").desc())
    )
    return counted if days is None else counted.limit(days)


# --- Repository lookups -------------------------------------------------------


def finished(repositories: DataFrame) -> DataFrame:
    return repositories.filter(F.col("update_status") == C.UPDATE_FINISHED)


def not_in_error(repositories: DataFrame) -> DataFrame:
    return repositories.filter(F.col("update_status") != C.UPDATE_ERROR)


def named_repositories(repositories: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Repositories listed as ``organization/name`` in column ``repository``;
    all of them when there is no list."""
    if names is None:
        return repositories
    parts = F.split("repository", "/")
    wanted = names.select(parts[0].alias("organization"), parts[1].alias("name")).distinct()
    return repositories.join(wanted, REPOSITORY, "left_semi")


def matching_repositories(repositories: DataFrame, needle) -> DataFrame:
    """Needle contained in the lower-cased name or organization; the needle
    is taken as typed and an empty one matches all."""
    return repositories.filter(
        F.contains(F.lower("name"), needle) | F.contains(F.lower("organization"), needle)
    )


def repository_languages(repository_language: DataFrame) -> DataFrame:
    return repository_language.groupBy(*REPOSITORY).agg(
        F.array_sort(F.collect_set("language")).alias("languages")
    )


def repository_listing(repositories: DataFrame, repository_language: DataFrame) -> DataFrame:
    """Finished repositories with their sorted languages."""
    return finished(repositories).join(
        repository_languages(repository_language), REPOSITORY, "left"
    )


def documents_by_hash(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """All stored documents with a wanted (repository, code_hash)."""
    return documents.join(wanted, [*REPOSITORY, "code_hash"])


#: What the index on content hashes holds of a document: where it is.
HASH_INDEX = "organization string, name string, code_hash string, language string, row_index long"


def save_hash_index(documents: DataFrame, path: str) -> None:
    """The second index of stored documents: by content hash, next to their
    own layout by repository. A hash that many documents share is cut into
    files by their places."""
    places = documents.select(*REPOSITORY, "code_hash", "language", F.col("row_index").cast("long"))
    save_keyed(places, "code_hash", path, [*REPOSITORY, "language", "row_index"])


def places_by_hash(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Places of all documents with a wanted code_hash, in all repositories or,
    if ``wanted`` names them, in its own; reads the folders of these hashes."""
    wanted = materialise(wanted.distinct(), "wanted")
    by = [c for c in [*REPOSITORY, "code_hash"] if c in wanted.columns]
    return read_keyed(spark, path, HASH_INDEX, "code_hash", wanted).join(wanted.select(by), by, "left_semi")


# --- Result cache -------------------------------------------------------------


def with_cache(
    requests: DataFrame,
    path: str,
    schema: str,
    compute: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Results of ``requests`` by ``cache_key``: stored ones are read, only
    the others are computed, and those are appended. Nothing expires. A
    request without results is kept as a row with its key alone; one without
    a key is computed each time. Only the folders of the asked keys are read."""
    spark = requests.sparkSession
    stored = read_keyed(spark, path, schema, "cache_key", requests)
    values = [F.col(c).isNotNull() for c in stored.columns if c != "cache_key"]
    known = stored.select("cache_key").distinct()
    misses = requests.join(known, "cache_key", "left_anti")
    fresh = materialise(compute(misses).select(stored.columns), "fresh")
    filled = stored.where(F.array_contains(F.array(*values), True))
    hits = materialise(filled.join(requests, "cache_key", "left_semi"), "hits")
    answered = misses.select("cache_key").distinct().join(fresh, "cache_key", "left")
    answered = materialise(answered.select(stored.columns), "answered")
    save_keyed(answered, "cache_key", path, mode="append")
    return hits.unionByName(fresh)


def compact_cache(spark: SparkSession, path: str, schema: str) -> None:
    """Gather the files that batches have appended, each answer once.

    Not for a time when searches run: readers would miss their files. Answers
    lost by a failure on the way are computed again when they are asked for.
    """
    stored = materialise(spark.read.schema(schema).parquet(path).distinct(), "cache")
    save_keyed(stored, "cache_key", path)


def clear_cache(spark: SparkSession, path: str, schema: str) -> None:
    """An empty cache, whatever was stored."""
    save_keyed(spark.createDataFrame([], schema), "cache_key", path)
