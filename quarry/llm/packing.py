"""Best-fit packing of token sequences in bulk-synchronous sweeps."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm import words
from quarry.session import materialise

#: Groups, at least, into which the ranking of one length is dealt, and pieces of
#: all lengths for which there is one group more.
SALTS, SALT_ROWS = 64, 1_000_000
#: Bytes of text of which a worker holds slices and ids at once.
BATCH_BYTES = 2 << 20


def token_pieces(
    df: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``id_col, piece, start, length,
    ids_crc32`` and ``ids`` on request.

    A document is its ids and ``end_id`` (a null or empty text: ``end_id``
    alone). Only longer ones are cut, into full pieces and a rest.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.byte_batches(batches, 1, BATCH_BYTES):
            n, ids = words.encoded(batch.column(1), tokenizer, keep_ids=True)
            place = np.cumsum(n)
            whole = np.insert(ids, place, end_id).astype("<u4")
            n = n + 1
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            number = words.ragged(np.zeros(len(n), np.int64), pieces)
            start = number * capacity
            length = np.minimum(n[row] - start, capacity)
            at = (np.cumsum(n) - n)[row] + start
            view = memoryview(whole.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())]
            columns = [
                batch.column(0).take(pa.array(row)), pa.array(number, pa.int32()),
                pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
            ]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                bounds = np.concatenate([[0], np.cumsum(length)])
                columns.append(pa.LargeListArray.from_arrays(bounds, pa.array(whole.astype(np.int32)))
                               .cast(pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    return df.select(id_col, text_col).mapInArrow(cut, schema + (", ids array<int>" if keep_ids else ""))


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first_rank, last_rank, first_sequence, offset)``.

    Items of one length and sequences of one gap are runs, so a round matches
    whole runs: lengths fall, and the items of a length go to the smallest
    gaps that hold them, rank for rank; what is left opens new sequences; the
    gaps are updated and the next round begins. There are at most ``capacity``
    lengths and gaps, whatever the number of documents.
    """
    runs, gaps, opened = [], {}, 0  # gaps: size -> [(first sequence, number)]
    sizes: list[int] = []

    def put(gap: int, first: int, number: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(sizes, gap)
        gaps[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect.bisect_left(sizes, length)
            if i == len(sizes):
                fresh = -(-left // (capacity // length))
                put(capacity, opened, fresh)
                opened += fresh
                continue
            gap = sizes[i]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[i]
            taken = min(left, number)
            if taken < number:
                put(gap, first + taken, number - taken)
            if gap > length:
                put(gap - length, first, taken)
            runs.append((length, rank, rank + taken - 1, first, capacity - gap))
            rank, left = rank + taken, left - taken
    return runs


def best_fit(pieces: DataFrame, capacity: int = 2048, order: list[str] | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (gapless from 0).

    Pieces need ``length`` from 1 to ``capacity``; other columns are carried.
    Documents and gaps are sorted by size as runs of equal ones; each sweep
    gives the successor gap of a run of documents, and a document's rank in its
    run decides which sequence of the run of gaps it gets. Ranks are counted in
    Spark over (length, salt), so a length that a third of all pieces have is
    dealt to ``SALTS`` groups or more. Ties and repeated rows each get a place of their
    own. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    order = order or [c for c in pieces.columns if c != "length"]
    written = materialise(pieces, "pieces")
    # A salt's share of one length fits a task however many pieces there are.
    salts = max(SALTS, written.count() // SALT_ROWS)
    pieces = written.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    groups = pieces.groupBy("length", "_salt").count()
    # At most capacity rows: one for each length.
    counts = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("count")).toLocalIterator()}
    runs = spark.createDataFrame(
        sweep(counts, capacity),
        "length long, first_rank long, last_rank long, first_sequence long, offset long",
    )
    before = groups.select(
        "length", "_salt",
        F.coalesce(
            F.sum("count").over(
                Window.partitionBy("length").orderBy("_salt")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
    )
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))
    ranked = (
        pieces.withColumn("_own", own)
        .join(before, ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    )
    return ranked.join(
        runs,
        (ranked["length"] == runs["length"])
        & (ranked["_rank"] >= runs["first_rank"])
        & (ranked["_rank"] <= runs["last_rank"]),
    ).select(
        *[ranked[c] for c in pieces.columns if c != "_salt"],
        (runs["first_sequence"] + ranked["_rank"] - runs["first_rank"]).alias("sequence_id"),
        runs["offset"],
    )
