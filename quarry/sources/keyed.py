"""Tables that are looked up by a hash, such as results by cache key and documents by content.

Rows lie in folders by the first digits of a hash of the key, in order of the
key within a folder's files, with Parquet Bloom filters on it. A lookup reads
the folders of the keys that it asks for, and in them, for a few keys, only
the row groups that may hold one. The number of folders is bounded by the
number of digits, whatever the keys; a key that owns a third of the rows lies
in several files, as the files are cut by the whole order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

DIGITS = 2
#: Keys that are handed to the scan itself; Parquet tests up to ten values one by one.
POINTS = 10
FOLDER = "key_prefix"


def key_prefix(key: Column) -> Column:
    return F.substring(F.sha1(key), 1, DIGITS)


def save_keyed(df: DataFrame, key: str, path: str, order: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write ``df`` laid out by ``key``, a string column; ``order`` names the
    columns that cut the rows of one key into files. Rows without a key are
    found by no lookup and are left out."""
    (
        df.filter(F.col(key).isNotNull())
        .withColumn(FOLDER, key_prefix(F.col(key)))
        .orderBy(FOLDER, key, *(order or []))
        .write.mode(mode)
        .partitionBy(FOLDER)
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .parquet(path)
    )


def read_keyed(spark: SparkSession, path: str, schema: str | T.StructType, key: str, wanted: DataFrame) -> DataFrame:
    """Stored rows of the keys in ``wanted[key]`` and perhaps others of their
    folders: what remains is for the caller's join. At most as many prefixes
    as there are folders, and ten keys, come to the driver."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*fields.fields, T.StructField(FOLDER, T.StringType())])
    stored = spark.read.schema(whole).parquet(path)
    asked = wanted.select(F.col(key)).filter(F.col(key).isNotNull())
    folders = [r[0] for r in asked.select(key_prefix(F.col(key))).distinct().collect()]
    stored = stored.filter(F.col(FOLDER).isin(folders))
    points = [r[0] for r in asked.distinct().limit(POINTS + 1).collect()]
    if len(points) <= POINTS:
        stored = stored.filter(F.col(key).isin(points))
    return stored.drop(FOLDER)
