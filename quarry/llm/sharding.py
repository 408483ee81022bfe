"""Sharding: two-pass external shuffle, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.session import materialise

#: Bytes and rows that one bucket holds in memory, on average. A swap of a
#: column expression copies the bucket's numbers, which bounds the rows.
BUCKET_BYTES, BUCKET_ROWS = 8 << 20, 512
#: Bytes of records that one task of the second pass reads, on average.
TASK_BYTES = 64 << 20


def shard_of(key: Column, shards: int, seed: int = 0) -> Column:
    """Rendezvous hashing: the shard with the highest hash of (seed, key, shard).

    Depends on the key and the number of shards alone. With one more shard a
    key either stays or goes to the new one. A null key is a key like others.
    """
    rated = [
        F.struct(F.xxhash64(F.lit(seed), key, F.lit(i)).alias("h"), F.lit(i).alias("shard"))
        for i in range(shards)
    ]
    return F.greatest(*rated)["shard"] if shards > 1 else F.lit(0)


def fisher_yates(n: Column, *seeds: Column) -> Column:
    """The numbers from 0 to ``n - 1`` in an order drawn by Fisher and Yates, whose
    draw for place i is the hash of the seeds and i: equal seeds and n give the
    same order wherever and however often it is computed."""

    def draw(i: Column) -> Column:
        return F.struct(i.alias("i"), F.pmod(F.xxhash64(*seeds, i), i + 1).cast("int").alias("j"))

    def swap(order: Column, at: Column) -> Column:
        i, j = at["i"], at["j"]
        return F.transform(
            order, lambda x, k: F.when(k == i, F.get(order, j)).when(k == j, F.get(order, i)).otherwise(x)
        )

    nothing = F.array().cast("array<int>")
    places = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(nothing)
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(nothing)
    return F.aggregate(F.transform(places, draw), numbers, swap)


def shuffled_shards(
    df: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """All rows of ``df`` with ``shard``, ``slot`` and ``grown_shard`` besides.

    First pass: a seeded hash scatters the records of each shard uniformly over
    as many buckets as keep one near ``bucket_bytes`` and ``bucket_rows``.
    Second pass: each bucket is put in order of its rows, shuffled by
    :func:`fisher_yates` with draws from (seed, shard, bucket), and read out;
    ``slot`` is the place in the bucket after all rows of the shard's earlier
    buckets, so slots are gapless from 0. Shards, buckets and the order in a
    bucket depend on the rows alone, so a task that runs again, after the loss
    of an executor or with other partitions, gives every row its slot again.

    The scatter hashes the id and the text, so copies of a text spread as well
    as other rows. Rows that are equal in both share a bucket; if more of them
    are than ``bucket_rows``, their places in the scan spread them (only for
    these do slots depend on how ``df`` is partitioned). The law is ``key``: id
    and number of shards decide. Null ids all go to one shard (the id decides)
    but their texts spread them over its buckets. Null text: no bytes. Rows are
    never dropped or merged; an empty table gives an empty one. Columns named
    like the new ones are replaced.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot", "grown_shard")
    names = df.columns
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, -(-total // (bucket_bytes * shards)), -(-n // (bucket_rows * shards)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))

    own = df.select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.struct(*names).alias("_row"),
        F.monotonically_increasing_id().alias("_place"),
    )
    many = own.groupBy("_id", "_h").count().where(F.col("count") > bucket_rows).select("_id", "_h")
    many = materialise(many.toDF("_id2", "_h2"), "many")
    copy = F.lit(0).cast("long")
    if not many.isEmpty():
        same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2"))
        own = own.join(many, same, "left")
        copy = F.when(F.col("_h2").isNotNull(), F.col("_place")).otherwise(copy)
    first = own.select(
        shard_of(F.col("_id"), shards, seed).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), "_id", "_h", copy), F.lit(buckets)).alias("bucket"),
        F.struct("_id", "_h", copy.alias("_copy"), "_row").alias("row"),
    )
    counts = (
        first.groupBy("shard", "bucket")
        .count()
        .withColumn(
            "before",
            F.sum("count").over(
                Window.partitionBy("shard").orderBy("bucket")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select("shard", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    second = (
        first.repartition(tasks, "shard", "bucket")
        .groupBy("shard", "bucket")
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
        .withColumn("order", fisher_yates(F.size("rows"), F.lit(seed), F.col("shard"), F.col("bucket")))
    )
    shuffled = F.transform("order", lambda i: F.get("rows", i))
    placed = second.join(counts, ["shard", "bucket"]).select(
        "shard", "before", F.posexplode(shuffled).alias("at", "row")
    )
    return placed.select(
        *[F.col("row._row")[name].alias(name) for name in names],
        "shard",
        (F.col("before") + F.col("at")).alias("slot"),
    ).withColumn("grown_shard", shard_of(F.col(id_col), shards + 1, seed))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard; files keep slots in order within each bucket."""
    sharded.write.mode("overwrite").partitionBy("shard").parquet(path)
