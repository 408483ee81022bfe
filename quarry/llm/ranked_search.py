"""Ranked lexical search by sequential reads of impact-sorted lists (NRA).

Documents become segments of an inverted index over the terms of the queries. In
each segment the lists of a query's terms are read side by side, highest impact
first. What has been read gives each document a lower score bound, the last
impact read in each list where it was not seen yet an upper one. Reading goes on
until the best k are certain: no other document can reach them or break a tie,
and both bounds of each are its score. The best of a task's segments so far are
the bar for its next one; the best of all tasks are ranked last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm import blocks, words
from quarry.llm.suffix_dedup import planes, values
from quarry.operators.ranking import top_k
from quarry.session import materialise

#: Bytes of text in a segment, and of queries that are answered in one pass.
SEGMENT_BYTES, QUERY_BYTES = 16 << 20, 4 << 20
#: Entries read of each list at first; each further read goes twice as deep.
FIRST_READ = 64
#: Weights of the score: share of the length in percent, and saturation.
LENGTH_SHARE, SATURATION = 75, 8

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LAST = (1 << 63) - 1
_SEGMENT = "n_docs long, n_terms long, ids binary, lengths binary, doc binary, term binary, tf binary"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """For the terms of texts, one after the other: the number of each, the distinct
    ones, and how many each text has. Only A-Z are lower-cased."""
    data = words._LOWER[data]
    solid = _TERM[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begin[heads] = solid[heads]
    starts = np.flatnonzero(begin)
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.int64), [], counts
    total = np.cumsum(solid)
    index, distinct = words.distinct_slices(data[solid], np.append(total[starts] - 1, total[-1]))
    return index, distinct, counts


def _segments(df: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """A row for each segment: ids and term counts of its documents, and the
    (document, term, occurrences) of the terms in the vocabulary."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held, size, docs = [], 0, 0

        def segment() -> pa.RecordBatch:
            ids, lengths, doc, term, tf = (np.concatenate(x) for x in zip(*held))
            fields = (ids, lengths, doc.astype(np.uint32), term.astype(np.uint32), tf)
            row = [[int((lengths > 0).sum())], [int(lengths.sum())], *([planes(x)] for x in fields)]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(row, [pa.int64()] * 2 + [pa.binary()] * 5)],
                ["n_docs", "n_terms", "ids", "lengths", "doc", "term", "tf"])

        for batch in words.byte_batches(batches, 1, blocks.ROW_BYTES):
            data, offsets = words.text_bytes(batch.column(1))
            index, distinct, lengths = terms(data, offsets)
            number = np.fromiter((known.get(t, -1) for t in distinct), np.int64, len(distinct))[index]
            found = number >= 0
            doc = np.repeat(np.arange(len(lengths)), lengths)[found]
            key, tf = np.unique(doc * max(1, len(known)) + number[found], return_counts=True)
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            held.append((ids, lengths.astype(np.int64), key // max(1, len(known)) + docs, key % max(1, len(known)), tf.astype(np.int64)))
            size, docs = size + len(data), docs + len(lengths)
            if size >= SEGMENT_BYTES:
                yield segment()
                held, size, docs = [], 0, 0
        if held:
            yield segment()

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, _SEGMENT)


def _document_counts(segments: DataFrame) -> DataFrame:
    """``term, df``: how many documents have each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                term, df = np.unique(values(blob, np.uint32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(df)], ["term", "df"])

    return segments.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _length_parts(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """100 - 75 + (75 * length * n) div total of each document, exactly."""
    if LENGTH_SHARE * int(lengths.max(initial=0)) * n < 1 << 63:
        return 100 - LENGTH_SHARE + LENGTH_SHARE * lengths * n // max(1, total)
    exact = [100 - LENGTH_SHARE + LENGTH_SHARE * x * n // total for x in lengths.tolist()]
    return np.array(exact, np.int64)


class Segment:
    """Lists of one segment, each by falling impact."""

    def __init__(self, row: dict, n: int, total: int, n_lists: int):
        self.ids = values(row["ids"], np.int64)
        doc, term = values(row["doc"], np.uint32).astype(np.int64), values(row["term"], np.uint32).astype(np.int64)
        tf = values(row["tf"], np.int64)
        part = _length_parts(values(row["lengths"], np.int64), n, total)
        impact = 1_000_000_000 * tf // (1000 * tf + SATURATION * part[doc])
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.bounds = np.searchsorted(term[order], np.arange(n_lists + 1))

    def best(self, lists: np.ndarray, weights: np.ndarray, k: int, bar: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the best k by (score, id). ``weights`` are those of
        the query's distinct terms, times their repeats. Documents that come after
        ``bar`` (score, id) may be left out."""
        begin, end = self.bounds[lists], self.bounds[lists + 1]
        some = (end > begin) & (weights > 0)
        begin, end, weights = begin[some], end[some], weights[some]
        none = np.zeros(0, np.int64)
        if not len(begin):
            return none, none
        low = np.zeros(len(self.ids), np.int64)
        seen = np.zeros((len(begin), len(self.ids)), bool)
        left = np.arange(len(self.ids))
        read, depth = begin.copy(), FIRST_READ
        while True:
            upto = np.minimum(begin + depth, end)
            for i in range(len(begin)):
                own = slice(read[i], upto[i])
                # A document stands in a list once.
                low[self.doc[own]] += weights[i] * self.impact[own]
                seen[i, self.doc[own]] = True
            read = upto
            # Nothing is left of a list at its end; before it, the last impact bounds the rest.
            rest = np.where(read < end, weights * self.impact[read - 1], 0)
            high = low[left] + (rest.sum() - rest @ seen[:, left])
            # The best k so far by lower bound, and the last of them as the bar.
            own = low[left]
            top = left[np.lexsort((self.ids[left], -own))[:k]] if len(left) <= 4 * k else self._first(left, k, low)
            at = bar
            if len(top) == k:
                at = max(bar, (int(low[top[-1]]), -int(self.ids[top[-1]])))
            keep = (high > at[0]) | ((high == at[0]) & (-self.ids[left] >= at[1]))
            keep &= high > 0
            left, high = left[keep], high[keep]
            # Certain: as many candidates as places at most, and each one's bounds are equal.
            if not rest.any() or (len(left) <= k and (high == low[left]).all()):
                left = left[low[left] > 0]
                order = np.lexsort((self.ids[left], -low[left]))[:k]
                return left[order], low[left[order]]
            depth *= 2

    def _first(self, left: np.ndarray, k: int, low: np.ndarray) -> np.ndarray:
        cut = np.partition(low[left], len(left) - k)[len(left) - k]
        left = left[low[left] >= cut]
        return left[np.lexsort((self.ids[left], -low[left]))[:k]]


def _search_block(docs: DataFrame, queries: pa.Table, k: int, id_col: str, text_col: str) -> DataFrame:
    """``number, id, score`` of each task's best k of every query of one block."""
    data, offsets = words.text_bytes(queries.column("text").combine_chunks() if len(queries) else pa.array([], pa.string()))
    index, distinct, counts = terms(data, offsets)
    segments = materialise(_segments(docs, {t: i for i, t in enumerate(distinct)}, id_col, text_col), "segments")
    n, total = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    # No more rows than the queries of the block have terms.
    df = {r["term"]: r["df"] for r in _document_counts(segments).collect()}
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(distinct))], np.int64)
    asked, at = [], 0
    for number, count in zip(queries.column("number").to_pylist(), counts.tolist()):
        own, times = np.unique(index[at : at + count], return_counts=True)
        at += count
        asked.append((number, own, weight[own] * times if count else own))
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in shared.value]
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, n, total, len(distinct))
                for i, (_, lists, weights) in enumerate(shared.value):
                    ids, scores = best[i]
                    bar = (int(scores[-1]), -int(ids[-1])) if len(ids) == k else (0, -_LAST)
                    found, own = segment.best(lists, weights, k, bar)
                    ids, scores = np.append(ids, segment.ids[found]), np.append(scores, own)
                    order = np.lexsort((ids, -scores))[:k]
                    best[i] = ids[order], scores[order]
        for (number, _, _), (ids, scores) in zip(shared.value, best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), number)), pa.array(ids, mask=ids == _LAST), pa.array(scores)],
                ["number", "doc", "score"])

    return segments.select("ids", "lengths", "doc", "term", "tf").mapInArrow(run, "number long, doc long, score long")


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    query_id: str = "item_id", query_col: str = "text",
) -> DataFrame:
    """``query_id, rank, id_col, score``: the best ``k`` documents of each query, by
    falling score and rising id; fewer where fewer have a score above zero.

    Terms are runs of ASCII letters and digits and of all other characters than
    ASCII. A null text has no terms: such a document counts in no statistic, such a
    query has no result. Every row is a document and a query of its own, so
    repeated rows of documents take a place each and those of queries give
    repeated results; documents without an id come after others of the same
    score. Empty tables give an empty result. Ids of documents are integers;
    other columns are not read.

    Queries are answered in blocks of QUERY_BYTES, so that what is sent to the
    tasks is bounded; each block reads the documents once and shuffles only
    counts and each task's best.
    """
    spark = docs.sparkSession
    numbered = materialise(
        queries.select(F.col(query_id).alias("id"), F.col(query_col).alias("text")).withColumn("number", F.monotonically_increasing_id()),
        "queries",
    )
    size = numbered.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    n_blocks = math.ceil(size / QUERY_BYTES) or 1
    kind = queries.schema[query_id].dataType.simpleString()
    found = spark.createDataFrame([], "number long, doc long, score long")
    for block in range(n_blocks):
        own = numbered.where(F.pmod(F.xxhash64("number"), F.lit(n_blocks)) == block)
        part = own.where("text is not null").select("number", "text").toArrow()
        found = found.union(_search_block(docs, part, k, id_col, text_col))
    order = [F.desc("score"), F.asc_nulls_last("doc"), F.asc("place")]
    placed = found.withColumn("place", F.monotonically_increasing_id())
    best = top_k(placed, ["number"], order, k, ["place"])
    return best.join(numbered.select("number", "id"), "number").select(
        F.col("id").cast(kind).alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score"
    )
