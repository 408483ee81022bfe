"""Session set-up and the one way this package cuts lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quarry", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster leave ``master`` unset so that spark-submit decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names in
    ``spark.checkpoint.dir``, or, where that is unset, one in the warehouse.

    A warehouse on a machine's own disk serves a local session only; on a
    cluster the executors would each write to theirs, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        scheme = path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
        if scheme == "file" and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths of the tables that this driver has written, in order.
WRITTEN: list[str] = []


def materialise(df: DataFrame, name: str = "table", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a plan is read by several branches or where its size must be
    known: the written table survives the loss of an executor, keeps column
    pruning and filter pushdown, and gives Catalyst a real size, so that it
    alone decides whether a join side is small enough to broadcast. With ``by``
    it is laid out by these columns, so that a filter on them reads its part only.
    """
    spark = df.sparkSession
    run = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/quarry-{run}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    writer = df.hint("rebalance", *by).write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    return written.select(df.columns) if by else written


def materialise_by(df: DataFrame, key: str, name: str = "table") -> DataFrame:
    """As :func:`materialise`, with the rows in buckets of ``key``: joins and groups
    by it read them where they are, so wide rows are written once and not shuffled.

    Each task writes its rows to their buckets itself. There are as many buckets
    as shuffle partitions, as Spark shuffles tables of fewer ones again.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/quarry-{spark.sparkContext.applicationId}/{table}"
    WRITTEN.append(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables this application wrote with :func:`materialise`: all, or
    those at ``paths``.

    For the end of a job; DataFrames that read them are void afterwards.
    """
    if paths is None:
        paths = [f"{shared_folder(spark)}/quarry-{spark.sparkContext.applicationId}"]
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
