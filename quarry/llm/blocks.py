"""Documents packed into blocks that stay where they are over several rounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import words
from quarry.session import WRITTEN, shared_folder

#: Bytes of text in a block and in one row of it.
BLOCK_BYTES, ROW_BYTES = 8 << 20, 1 << 20
#: Above so many blocks several of them share a bucket, and so a file.
MAX_BUCKETS = 50_000


def numbered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """``block, rows``: batches of about ROW_BYTES of one text column with the
    number of the block that they belong to. Numbers are a task's own."""
    task = TaskContext.get()
    first = (task.partitionId() if task else 0) << 24
    held, block = 0, first
    for batch in words.byte_batches(batches, column, ROW_BYTES):
        n = len(words.text_bytes(batch.column(column))[0])
        if held and held + n > BLOCK_BYTES:
            held, block = 0, block + 1
        held += n
        yield block, batch


def written(spark: SparkSession, df: DataFrame, blocks: int, name: str) -> DataFrame:
    """``df`` as a table bucketed by ``block``, so that rounds which group by block
    do not move it. A task has whole blocks, so nothing is shuffled for it and
    a file holds one block; only beyond MAX_BUCKETS are blocks brought together."""
    buckets = max(1, min(MAX_BUCKETS, blocks))
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/quarry-{spark.sparkContext.applicationId}/{name}"
    WRITTEN.append(path)
    df = df.repartition(buckets, "block") if blocks > MAX_BUCKETS else df
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    table = spark.table(name)
    # The plan keeps path and buckets; the files stay until they are released.
    spark.sql(f"DROP TABLE {name}")
    return table


def meet(left: DataFrame, right: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Blocks with what came back for them."""
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(function, schema)


def cuts(place: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """``part, indices`` of the entries of each part that has some."""
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange(parts + 1))
    for part in np.flatnonzero(np.diff(bounds)).tolist():
        yield part, order[bounds[part] : bounds[part + 1]]
