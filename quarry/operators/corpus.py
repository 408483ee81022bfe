"""From files and function definitions to a search corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry import constants as C
from quarry.functions import text as T
from quarry.operators.ranking import row_numbers


def _literal_rows(spark: SparkSession, columns: str, rows: list[str]) -> DataFrame:
    """A constant table Catalyst knows the size of."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({columns})")


def language_metadata(spark: SparkSession) -> DataFrame:
    rows = [
        "('{}', '{}', array({}))".format(
            name,
            C.EXTENSIONS[name],
            ", ".join(f"'{part}'" for part in C.IGNORED_PATH_PARTS[name]),
        )
        for name in C.LANGUAGES
    ]
    return _literal_rows(spark, "language, extension, ignored", rows)


def blacklist(spark: SparkSession) -> DataFrame:
    rows = [
        f"('{language}', '{name}')"
        for language, names in C.BLACKLISTED_IDENTIFIERS.items()
        for name in names
    ]
    return _literal_rows(spark, "language, bare_name", rows)


def source_files(files: DataFrame) -> DataFrame:
    """Files of a known language outside ignored paths, with ``language``.

    One small join resolves the extension and brings the ignored parts.
    """
    metadata = language_metadata(files.sparkSession)
    extension = F.substring_index(F.col("path"), ".", -1)
    return (
        files.withColumn("extension", F.when(F.col("path").contains("."), extension))
        .join(metadata, "extension")
        .filter(
            ~F.exists("ignored", lambda part: F.contains(F.lower(F.col("path")), part))
        )
        .drop("ignored", "extension")
    )


def within_size(files: DataFrame, text: str = "text") -> DataFrame:
    return files.filter(F.length(text) <= C.MAX_FILE_CHARS)


def with_body(definitions: DataFrame) -> DataFrame:
    """Definitions with more than one code token."""
    return definitions.filter(F.size("code_tokens") > 1)


def without_blacklisted(definitions: DataFrame) -> DataFrame:
    listed = blacklist(definitions.sparkSession)
    return (
        definitions.withColumn("bare_name", T.bare_identifier(F.col("identifier")))
        .join(listed, ["language", "bare_name"], "left_anti")
        .drop("bare_name")
    )


def code_documents(definitions: DataFrame) -> DataFrame:
    """The stored shape of extracted definitions.

    Expects language, path, identifier, docstring, docstring_summary, code,
    code_tokens and 0-based start_row / end_row; other columns are kept.
    """
    return definitions.withColumns(
        {
            "docstring_tokens": T.docstring_tokens(F.col("docstring_summary")),
            "docstring": T.strip_blank(F.col("docstring")),
            "docstring_summary": T.strip_blank(F.col("docstring_summary")),
            "code": T.strip_blank(F.col("code")),
            "start_line": F.col("start_row") + 1,
            "end_line": F.col("end_row") + 1,
        }
    ).drop("start_row", "end_row")


def extract(files: DataFrame, extractor, keys: list[str]) -> DataFrame:
    """Files to deduplicated code documents.

    ``extractor`` is a ``DataFrame -> DataFrame`` function that turns files
    (``keys``, language, path, text) into definitions; everything around it
    is done here.
    """
    return first_copies(extracted(files, extractor), [*keys, "language"], "code", ["path", "start_line"])


def extracted(files: DataFrame, extractor) -> DataFrame:
    """What :func:`extract` finds before copies are taken out."""
    definitions = extractor(within_size(source_files(files)))
    return code_documents(without_blacklisted(with_body(definitions)))


def first_copies(df: DataFrame, by: list[str], content: str, order: list[str]) -> DataFrame:
    """Keep the first row, by ``order``, of every equal content in a group.

    The first position per content hash is an aggregate, combined before the
    shuffle, so a content copied into a third of the rows costs one small
    buffer per task; the wide rows are matched back on position and content.
    Several contents may stand at one position (two definitions on one line);
    equal contents at one position are one row more than once, and one is kept.
    """
    hashed = df.withColumn("_hash", F.sha1(content))
    keys = [*by, *order, "_hash"]
    return hashed.join(first_places(hashed, by, "_hash", order), keys, "left_semi").dropDuplicates(keys).drop("_hash")


def first_places(df: DataFrame, by: list[str], content_hash: str, order: list[str]) -> DataFrame:
    """Where every content of a group stands first, by ``order``."""
    return (
        df.select(*by, content_hash, F.struct(*order).alias("_at"))
        .groupBy(*by, content_hash)
        .agg(F.min("_at").alias("_at"))
        .select(*by, content_hash, *[F.col(f"_at.{name}").alias(name) for name in order])
    )


def with_row_index(df: DataFrame, by: list[str], order: list[str], keys: list[str]) -> DataFrame:
    """Attach each document's 0-based position in its corpus.

    Only the key columns are sorted; the wide rows meet their number by key.
    """
    narrow = df.select(*dict.fromkeys([*by, *order, *keys]))
    numbers = row_numbers(narrow, by, order).select(*keys, "row_index")
    return df.join(numbers, keys)


def preprocess(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Normalised query and code tokens of every document."""
    url = F.col("url") if "url" in documents.columns else F.lit(None).cast("string")
    return documents.select(
        *(keep or []),
        "language",
        "identifier",
        url.alias("url"),
        T.query_tokens(F.col("docstring_tokens"), F.col("identifier")).alias("query_tokens"),
        T.normalised_code_tokens(F.col("language"), F.col("code_tokens")).alias("code_tokens"),
    )


def valid_training_documents(preprocessed: DataFrame) -> DataFrame:
    return preprocessed.filter(F.size("query_tokens") > 0)


def split_set(key: Column, seed: int = 0, shares: dict[str, float] | None = None) -> Column:
    """train / valid / test by a hash of a stable key: the same row lands in
    the same set whatever the order or partitioning."""
    shares = shares or C.SPLIT_SHARES
    share = T.hash_share(seed, key)
    names = list(shares)
    cut, chosen = 0.0, None
    for name in names[:-1]:
        cut = round(cut + shares[name], 12)
        chosen = F.when(share < cut, name) if chosen is None else chosen.when(share < cut, name)
    return F.lit(names[-1]) if chosen is None else chosen.otherwise(names[-1])


def split_into_sets(documents: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return documents.withColumn("set", split_set(F.col(key), seed))


def sample_gate(
    documents: DataFrame, repository: list[str], minimum: int = C.MIN_SAMPLES_PER_LANGUAGE
) -> DataFrame:
    """Repository status: error if any of its languages has too few documents."""
    per_language = documents.groupBy(*repository, "language").agg(F.count("*").alias("n"))
    enough = F.bool_and(F.col("n") >= minimum)
    return per_language.groupBy(*repository).agg(
        F.min("n").alias("fewest"),
        F.when(enough, C.UPDATE_FINISHED).otherwise(C.UPDATE_ERROR).alias("update_status"),
    )


def import_deduplicated(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed({"function": "code", "function_tokens": "code_tokens"}).withColumn(
        "set", F.lit("all")
    )


def import_set(raw: DataFrame, set_name: str) -> DataFrame:
    return raw.withColumnRenamed("func_name", "identifier").withColumn("set", F.lit(set_name))


def union_corpora(corpora: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), corpora)


def work_list(documents: DataFrame) -> DataFrame:
    """Every language with every set, by exploding a constant list."""
    sets = F.array(*[F.lit(name) for name in [*C.SPLIT_SHARES, "all"]])
    return documents.select("language").distinct().select("language", F.explode(sets).alias("set"))
