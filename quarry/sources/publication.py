"""Publishing several tables of many repositories as one version.

Below a target folder every refresh writes its repositories' rows of each table
into folders of its own, ``<table>/data_version=<v>/organization=<o>/name=<n>``,
which never change afterwards. The manifest says for each repository its status
and the folder that holds its rows now; repositories that a refresh did not touch
keep theirs, so nothing of them is read or written. A version begins when its
commit, one small file that names the manifest, is moved to its number; the move
fails if another refresh has taken the number, and is then tried again on top of
that one. A reader holds one version and sees it whole, whatever comes later.
"""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarry import constants as C
from quarry.session import materialise

REPOSITORY = ["organization", "name"]
MANIFEST = (
    "organization string, name string, update_status int, commit_hash string, data_version string, updated_at timestamp"
)
#: How often a commit is tried again after others.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another refresh has committed the same version."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, name: str, text: str) -> None:
    """Write a file whole or not at all; raises Conflict where there is one."""
    target, beside = _path(spark, name), _path(spark, f"{name}.{uuid.uuid4().hex}")
    out = _files(spark, target).create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _files(spark, target).getUri(), spark._jsc.hadoopConfiguration()
    )
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        context.rename(beside, target, options)
    except Exception as error:
        _files(spark, target).delete(beside, False)
        if "FileAlreadyExistsException" in str(error):
            raise Conflict(name) from error
        raise


def _get(spark: SparkSession, name: str) -> str:
    path = _path(spark, name)
    stream = _files(spark, path).open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of all versions, rising."""
    folder = _path(spark, f"{target}/_commits")
    files = _files(spark, folder)
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(name) for name in names if re.fullmatch(r"\d{10}", name))


class Snapshot:
    """One version: its manifest, and the tables as they are in it."""

    def __init__(self, spark: SparkSession, target: str, version: int):
        self.spark, self.target, self.version = spark, target, version
        commit = json.loads(_get(spark, f"{target}/_commits/{version:010d}")) if version else {"manifest": None, "schemas": {}}
        self.schemas = {name: StructType.fromJson(schema) for name, schema in commit["schemas"].items()}
        if commit["manifest"]:
            self.manifest = spark.read.schema(MANIFEST).parquet(f"{target}/_manifests/{commit['manifest']}")
        else:
            self.manifest = spark.createDataFrame([], MANIFEST)

    @staticmethod
    def current(spark: SparkSession, target: str) -> Snapshot:
        """The last version; version 0, without repositories, where there is none."""
        return Snapshot(spark, target, ([0] + versions(spark, target))[-1])

    def table(self, name: str) -> DataFrame:
        """Rows of all repositories that have been published. Only folders that the
        manifest names are read."""
        schema = self.schemas[name]
        held = self.manifest.where("data_version is not null").select(*REPOSITORY, "data_version")
        # One number for each refresh of which a repository is still current.
        found = [r[0] for r in held.select("data_version").distinct().collect()]
        if not found:
            return self.spark.createDataFrame([], schema)
        whole = StructType([*schema.fields, StructField("data_version", StringType())])
        rows = self.spark.read.schema(whole).option("basePath", f"{self.target}/{name}").parquet(
            *[f"{self.target}/{name}/data_version={v}" for v in found]
        )
        return rows.join(held, [*REPOSITORY, "data_version"], "left_semi").select(*schema.names)


def _commit(spark: SparkSession, target: str, changes: DataFrame, schemas: dict[str, StructType]) -> Snapshot:
    """Put ``changes`` (manifest rows; a null data_version keeps the folder) over the
    last version's manifest, as the next version."""
    fields = [f.name for f in spark.createDataFrame([], MANIFEST).schema]
    changes = materialise(changes.select(*fields), "changes")
    for _ in range(ATTEMPTS):
        last = Snapshot.current(spark, target)
        new, old = changes.alias("new"), last.manifest.alias("old")
        both = old.join(new, [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in REPOSITORY], "full")
        pick = lambda c: F.when(F.col("new.update_status").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
        keep = lambda c: F.coalesce(f"new.{c}", f"old.{c}").alias(c)
        merged = both.select(*[keep(c) if c in (*REPOSITORY, "commit_hash", "data_version") else pick(c) for c in fields])
        manifest = uuid.uuid4().hex
        merged.write.parquet(f"{target}/_manifests/{manifest}")
        every = {**last.schemas, **schemas}
        body = {"manifest": manifest, "schemas": {name: schema.jsonValue() for name, schema in every.items()}}
        number = last.version + 1
        try:
            _put(spark, f"{target}/_commits/{number:010d}", json.dumps(body))
        except Conflict:
            continue
        return Snapshot(spark, target, number)
    raise Conflict(f"{target}: no version could be committed in {ATTEMPTS} attempts")


def mark(spark: SparkSession, target: str, repositories: DataFrame, status: int) -> Snapshot:
    """Set the status of repositories; their published rows stay."""
    return _commit(spark, target, repositories.select(*REPOSITORY).distinct().select(
        *REPOSITORY, F.lit(status).alias("update_status"), F.lit(None).cast("string").alias("commit_hash"),
        F.lit(None).cast("string").alias("data_version"), F.current_timestamp().alias("updated_at"),
    ), {})


def publish(
    spark: SparkSession, target: str, tables: dict[str, DataFrame], status: DataFrame,
    layout: dict[str, list[str]] | None = None,
) -> Snapshot:
    """Publish the finished repositories of ``status`` (organization, name,
    update_status, commit_hash) in all tables at once.

    Every table has the repository's columns. A repository that is not finished
    gets its status and keeps what it had; one that is in no row of ``status``
    is not touched. ``layout`` names further columns to lay tables out by.
    """
    version = uuid.uuid4().hex
    status = materialise(status.select(*REPOSITORY, "update_status", "commit_hash"), "status")
    finished = status.where(F.col("update_status") == C.UPDATE_FINISHED)

    def write(name: str) -> None:
        by = [*REPOSITORY, *(layout or {}).get(name, [])]
        kept = tables[name].join(finished.select(*REPOSITORY), REPOSITORY, "left_semi")
        kept.hint("rebalance", *by).write.option("compression", "zstd").partitionBy(*by).parquet(f"{target}/{name}/data_version={version}")

    # The tables do not depend on each other; their jobs share the cluster.
    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(write, tables))
    done = F.col("update_status") == C.UPDATE_FINISHED
    changes = status.select(
        *REPOSITORY, "update_status", F.when(done, F.col("commit_hash")).alias("commit_hash"),
        F.when(done, F.lit(version)).alias("data_version"), F.current_timestamp().alias("updated_at"),
    )
    return _commit(spark, target, changes, {name: df.schema for name, df in tables.items()})


def vacuum(spark: SparkSession, target: str, keep: int = 2) -> list[str]:
    """Delete the folders that none of the last ``keep`` versions names, and older
    commits. For times without a refresh on its way; returns what went."""
    numbers = versions(spark, target)
    gone = numbers[:-keep] if keep else []
    snapshots = [Snapshot(spark, target, n) for n in numbers[-keep:]]
    live = {r[0] for s in snapshots for r in s.manifest.select("data_version").distinct().collect()}
    manifests = {json.loads(_get(spark, f"{target}/_commits/{s.version:010d}"))["manifest"] for s in snapshots}
    deleted = []

    def drop(name: str) -> None:
        path = _path(spark, name)
        _files(spark, path).delete(path, True)
        deleted.append(name)

    for number in gone:
        drop(f"{target}/_commits/{number:010d}")
    names = {name for s in snapshots for name in s.schemas}
    for folder, wanted, cut in [(f"{target}/_manifests", manifests, ""), *((f"{target}/{n}", live, "data_version=") for n in sorted(names))]:
        path = _path(spark, folder)
        for status in _files(spark, path).listStatus(path) if _files(spark, path).exists(path) else []:
            own = status.getPath().getName()
            if own.startswith(cut) and own.removeprefix(cut) not in wanted:
                drop(f"{folder}/{own}")
    return deleted
