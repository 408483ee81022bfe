"""Removal of long repeated passages by distributed prefix doubling.

Byte positions are ranked by growing prefixes, 8, 16, 25 and 50 bytes, each
rank a pair of shorter ranks at an offset; a position whose rank no other
document has is dropped. One row for a byte would be many times the text, so a rank is
a fingerprint, positions travel as packed sorted arrays (a row is one block's
share of one range of ranks), and each round asks only about positions that
the rounds before have left open:

1. Content-defined chunks: what repeats as a whole chunk is settled at once.
2. Ranks of 25 bytes, at the positions where a window of 50 bytes has its
   smallest rank: equal windows have equal ones, so a window is open only if
   some other document has its smallest rank too.
3. Ranks of 50 bytes of the windows still open, from pairs at an offset of 25.

In rounds 1 and 3 a rank goes to the smallest document id that has it; the
windows of all others are removed.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.session import WRITTEN, materialise, shared_folder

#: Bytes of the documents of one block, and of what is ranked at a time: ranks of
#: a part are eight times as large and should stay in a core's cache.
BLOCK_BYTES, PART_BYTES = 6 << 20, 1 << 16
#: Bytes of one partition of the table of blocks, and its most partitions.
BUCKET_BYTES, MAX_BUCKETS = 32 << 20, 50_000
#: Entries that one task sorts.
RANGE_ENTRIES = 1 << 20
#: The mean length of a chunk.
CHUNK = 96

_U = np.uint64
_ENTRY = "range long, block long, key binary, ext binary, doc binary, pos binary, len binary"
_SPAN = "block long, doc binary, pos binary, len binary"
_NAMES = ["range", "block", "key", "ext", "doc", "pos", "len"]


def pair(a: np.ndarray, b: np.ndarray, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """The rank of a string whose halves have the ranks a and b."""
    h = a * _U(seed)
    h ^= h >> _U(32)
    h += b
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    return h


def first_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the prefixes of ``length`` bytes (8 or more) at each position, by
    doubling from words of 8 bytes; the last pair overlaps."""
    n = len(data) - 7
    ranks, reach = np.ndarray((n,), "<u8", np.ascontiguousarray(data).data, strides=(1,)), 8
    while reach < length:
        offset = min(reach, length - reach)
        ranks = pair(ranks[:-offset], ranks[offset:])
        reach += offset
    return ranks


def planes(values: np.ndarray) -> bytes:
    """The bytes of all values by significance, which compress better."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def values(blob: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def smallest(ranks: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    low, reach = ranks, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def older(key: np.ndarray, ext: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same rank."""
    order = np.argsort(key)
    k, e = key[order], ext[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    if (~head[1:] & (e[1:] != e[:-1])).any():
        # Two ranks with equal keys, which the sort has not told apart.
        order = np.lexsort((ext, key))
        k, e = key[order], ext[order]
        head[1:] = (k[1:] != k[:-1]) | (e[1:] != e[:-1])
    out = np.zeros(len(k), bool)
    if len(k):
        d = doc[order]
        first = np.minimum.reduceat(d, np.flatnonzero(head))[np.cumsum(head) - 1]
        out[order] = d > first
    return out


def among(some: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of some values are in a sorted array."""
    if not len(known):
        return np.zeros(len(some), bool)
    return known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some


class Block:
    """The rows of one block in order of id and text, and their bytes."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int):
        ids = table.column(id_col).to_pylist()
        texts = [t.encode() if t else b"" for t in table.column(text_col).to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.data = np.frombuffer(b"".join(texts[i] for i in self.order), np.uint8)
        self.ends = np.cumsum([len(texts[i]) for i in self.order], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        row_doc = np.array([ids[i] for i in self.order], np.int64)
        # Rows of one document share one numbering of positions.
        self.docs, first, self.doc_of_row = np.unique(row_doc, return_index=True, return_inverse=True)
        self.doc_starts = self.starts[first]
        self.window = window

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``start, bytes, open``: parts of the bytes with all windows that begin
        in them; open where a window lies within one row."""
        for at in range(0, len(self.data), PART_BYTES):
            part = self.data[at : at + PART_BYTES + self.window - 1]
            n = len(part) - self.window + 1
            if n <= 0:
                return
            edge = np.zeros(n + 1, np.int32)
            own = slice(np.searchsorted(self.ends, at), np.searchsorted(self.starts, at + len(part), "right"))
            starts, ends = self.starts[own] - at, self.ends[own] - at
            a, b = np.clip(ends - self.window + 1, 0, n), np.clip(ends, 0, n)
            a = np.maximum(a, np.clip(starts, 0, n))
            np.add.at(edge, a, 1)
            np.add.at(edge, b, -1)
            yield at, part, np.cumsum(edge[:-1]) == 0

    def doc_at(self, place: np.ndarray) -> np.ndarray:
        """Number of the document at each place."""
        return self.doc_of_row[np.searchsorted(self.ends, place, side="right")]

    def covered(self, spans: pa.Table) -> np.ndarray:
        """Where windows begin that spans of earlier rounds cover."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        for doc, pos, size in zip(*(spans.column(c).to_pylist() for c in ("doc", "pos", "len"))):
            if not doc:
                continue
            number = np.searchsorted(self.docs, values(doc, np.int64))
            a = self.doc_starts[number] + values(pos, np.uint32)
            np.add.at(edge, a, 1)
            np.add.at(edge, a + values(size, np.uint32), -1)
        return np.cumsum(edge[:-1], out=edge[:-1]) > 0


def _place(key: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each rank; rises with it."""
    return ((key >> _U(32)) * _U(ranges)) >> _U(32)


def _rows(ranges: int, block: int, key, ext, doc, pos, size) -> list[tuple]:
    """One row for each range of ranks."""
    place = _place(key, ranges)
    order = np.argsort(key)
    cuts = np.searchsorted(place[order], np.arange(ranges + 1))
    out = []
    for r in range(ranges):
        own = order[cuts[r] : cuts[r + 1]]
        if len(own):
            out.append((r, block, *(planes(x[own]) for x in (key, ext, doc, pos, size))))
    return out


def _table(rows: list[tuple], names: list[str] = _NAMES) -> pa.Table:
    kinds = {"range": pa.int64(), "block": pa.int64()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, kinds.get(n, pa.binary())) for n, c in zip(names, columns)], names)


def _sifted(ranges: int, block: int, key, ext, doc, pos, size) -> list[tuple]:
    """Entries for the other blocks, and under a negative range of its own what
    this block settles."""
    old = older(key, ext, doc)
    rows = _rows(ranges, block, *(x[~old] for x in (key, ext, doc, pos, size)))
    if old.any():
        rows.append((-1 - block, block, b"", b"", planes(doc[old]), planes(pos[old]), planes(size[old])))
    return rows


def _chunks(block: Block, number: int, ranges: int) -> list[tuple]:
    """Entries of round 1: a chunk is the windows between two cuts, and the bytes
    they cover."""
    digests, begin, sizes = [], [], []
    view = memoryview(block.data)
    for at, part, open_ in block.parts():
        ranks = first_ranks(part, block.window // 2)[: len(open_)]
        cut = ranks < _U((1 << 64) // CHUNK)
        cut[0] = True
        inside = block.starts[(block.starts >= at) & (block.starts < at + len(open_))] - at
        cut[inside] = True
        cut = np.flatnonzero(cut)
        total = np.concatenate([[0], np.cumsum(open_)])
        windows = total[np.append(cut[1:], len(open_))] - total[cut]
        some = windows > 0  # the open windows of a chunk are its first ones
        a = cut[some] + at
        n = windows[some]
        digests += [
            hashlib.blake2b(view[x:y], digest_size=12).digest()
            for x, y in zip(a.tolist(), (a + n + block.window - 1).tolist())
        ]
        begin.append(a)
        sizes.append(n)
    if not digests:
        return []
    names = np.frombuffer(b"".join(digests), [("key", "<u8"), ("ext", "<u4")])
    begin, doc = np.concatenate(begin), block.doc_at(np.concatenate(begin))
    return _sifted(
        ranges, number, names["key"].copy(), names["ext"].copy(), block.docs[doc],
        (begin - block.doc_starts[doc]).astype(np.uint32), np.concatenate(sizes).astype(np.uint32),
    )


def _leaders(block: Block, covered: np.ndarray) -> Iterator[tuple]:
    """``start, ranks, places, smallest ranks, heads`` of the windows still open, by
    part. Neighbours mostly have the same smallest rank; heads are the first
    windows of runs that share it within a row."""
    for at, part, open_ in block.parts():
        ranks = first_ranks(part, block.window // 2)
        place = np.flatnonzero(open_ & ~covered[at : at + len(open_)])
        low = smallest(ranks, block.window - block.window // 2 + 1)[place]
        change = np.ones(len(low) + 1, bool)
        change[1:-1] = low[1:] != low[:-1]
        own = slice(np.searchsorted(block.ends, at), np.searchsorted(block.ends, at + len(open_), "right"))
        change[np.searchsorted(place, block.ends[own] - at)] = True
        yield at, ranks, place, low, np.flatnonzero(change[:-1])


def _distinct(block: Block, leaders: Iterator[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct smallest ranks, and whether two documents of the block have each."""
    keys, docs = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for at, _, place, low, heads in leaders:
        keys.append(low[heads] >> _U(16) << _U(16))
        docs.append(block.doc_at(place[heads] + at))
    keys, docs = np.concatenate(keys), np.concatenate(docs)
    # Documents rise with their places, so a stable sort keeps them in order.
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    last = np.append(start[1:], len(keys))[: len(start)] - 1
    return keys[start], docs[start] != docs[last]


def _pack(keys: np.ndarray) -> bytes:
    """The leading six bytes of ranks: what travels of the first ones."""
    return planes(keys)[2 * len(keys) :]


def _unpack(blob: bytes) -> np.ndarray:
    return values(bytes(len(blob) // 3) + blob, _U)


def _windows(block: Block, number: int, ranges: int, covered: np.ndarray, shared: np.ndarray) -> list[tuple]:
    """Entries of round 3: the windows whose smallest rank another document has."""
    own, several = _distinct(block, _leaders(block, covered))
    shared = np.union1d(own[several], shared)
    key, ext, begin = [], [], []
    step = block.window - block.window // 2
    for at, ranks, place, low, heads in _leaders(block, covered):
        hit = among(low[heads] >> _U(16) << _U(16), shared)
        place = place[np.repeat(hit, np.diff(heads, append=len(low)))]
        # Two prefixes of half the window, at the offset that is left, give it.
        halves = ranks[place], ranks[place + step]
        key.append(pair(*halves))
        ext.append((pair(*halves, 0xC2B2AE3D27D4EB4F) >> _U(32)).astype(np.uint32))
        begin.append(place + at)
    if not key:
        return []
    key, ext, begin = np.concatenate(key), np.concatenate(ext), np.concatenate(begin)
    doc = block.doc_at(begin)
    return _sifted(
        ranges, number, key, ext, block.docs[doc],
        (begin - block.doc_starts[doc]).astype(np.uint32), np.ones(len(begin), np.uint32),
    )


def _settle(table: pa.Table) -> pa.Table:
    """Of all entries of a range: those of which a smaller document has the rank,
    back to their blocks."""
    part = {c: table.column(c).to_pylist() for c in _NAMES}
    if part["range"][0] < 0:
        return table.select(["block", "doc", "pos", "len"])
    kinds = {"key": _U, "ext": np.uint32, "doc": np.int64, "pos": np.uint32, "len": np.uint32}
    each = {c: [values(b, kind) for b in part[c]] for c, kind in kinds.items()}
    old = older(*(np.concatenate(each[c]) for c in ("key", "ext", "doc")))
    rows, at = [], 0
    for i, block in enumerate(part["block"]):
        n = len(each["key"][i])
        own = old[at : at + n]
        at += n
        if own.any():
            rows.append((block, *(planes(each[c][i][own]) for c in ("doc", "pos", "len"))))
    return _table(rows, ["block", "doc", "pos", "len"])


def _leader_rows(ranges: int, block: int, keys: np.ndarray) -> list[tuple]:
    """``range, block, key`` of sorted smallest ranks. The smallest of many ranks is
    near zero, so ranges of them would have most entries in the first few: their
    products with an odd number are spread evenly."""
    place = _place(keys * _U(0x9E3779B97F4A7C15), ranges)
    # Small numbers are sorted digit by digit.
    order = np.argsort(place.astype(np.uint16 if ranges <= 1 << 16 else _U), kind="stable")
    cuts = np.searchsorted(place[order], np.arange(ranges + 1))
    return [
        (r, block, _pack(keys[order[a:b]])) for r, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if a < b
    ]


def _share(table: pa.Table) -> pa.Table:
    """Of all first ranks of a range: those that several blocks have, back to them."""
    blocks, blobs = table.column("block").to_pylist(), table.column("key").to_pylist()
    each = [_unpack(b) for b in blobs]
    keys, counts = np.unique(np.concatenate(each), return_counts=True)
    several = keys[counts > 1]
    rows = []
    for block, own in zip(blocks, each):
        back = own[among(own, several)]
        if len(back):
            rows.append((block, _pack(back)))
    return _table(rows, ["block", "key"])


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, carry: bool = False
) -> DataFrame:
    """``id_col, n_bytes, n_removed, span_starts, span_ends, kept`` of every row,
    with the other columns of ``df`` if ``carry``.

    A byte goes if it lies in a string of ``window`` bytes (16 to 2000) that
    also starts in a document with a smaller id; strings are judged on the
    input. ``kept`` is binary, as a cut may lie inside a character. A null text
    is empty. Rows without an id lose nothing and make others lose nothing.
    Rows with equal ids are one document: they don't count as smaller than each
    other. An empty table gives an empty one. Ids are integers. Clashing
    columns of ``df`` are replaced by the results.

    The documents are written once as a table bucketed by block, so all rounds
    meet their answers without moving the texts again. A rank leaves a block at
    most once for rounds 1 and 2, so one that a third of all documents have
    puts no more than one entry for each block into a task.
    """
    if not 16 <= window <= 2000:
        raise ValueError("window must be from 16 to 2000 bytes")
    spark = df.sparkSession
    new = ["n_bytes", "n_removed", "span_starts", "span_ends", "kept"]
    names = [c for c in df.columns if c not in new] if carry else [id_col, text_col]
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = math.ceil(total / BLOCK_BYTES) or 1
    buckets = min(MAX_BUCKETS, math.ceil(total / BUCKET_BYTES)) or 1
    share = lambda per_byte: math.ceil(total * per_byte / RANGE_ENTRIES) or 1
    chunk_ranges, leader_ranges, window_ranges = share(1 / CHUNK), share(0.07), share(0.12)

    dealt = df.select(*names).withColumns({
        "_id": F.col(id_col).cast("long"),
        "_block": F.pmod(F.xxhash64(F.lit(3), id_col, F.when(F.col(id_col).isNull(), F.col(text_col))), F.lit(blocks)),
    })
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/quarry-{spark.sparkContext.applicationId}/{name}"
    WRITTEN.append(path)
    dealt.repartition(buckets, "_block").write.option("path", path).option("compression", "zstd").bucketBy(
        buckets, "_block"
    ).saveAsTable(name)
    table = spark.table(name)
    known = table.where("_id is not null").select("_block", "_id", F.col(text_col).alias("_text"))

    def of(group: pa.Table) -> tuple[Block, int]:
        return Block(group, "_id", "_text", window), group.column("_block")[0].as_py()

    def round_1(group: pa.Table) -> pa.Table:
        block, number = of(group)
        return _table(_chunks(block, number, chunk_ranges))

    def round_2(group: pa.Table, spans: pa.Table) -> pa.Table:
        if not len(group):
            return _table([], ["range", "block", "key"])
        block, number = of(group)
        keys, _ = _distinct(block, _leaders(block, block.covered(spans)))
        return _table(_leader_rows(leader_ranges, number, keys), ["range", "block", "key"])

    def round_3(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(group):
            return _table([])
        block, number = of(group)
        shared = [_unpack(b) for b in answers.column("key").to_pylist() if b]
        shared = np.unique(np.concatenate(shared)) if shared else np.zeros(0, _U)
        return _table(_windows(block, number, window_ranges, block.covered(answers), shared))

    def finish(group: pa.Table, spans: pa.Table) -> pa.Table:
        block = Block(group.set_column(group.schema.get_field_index("_id"), "_id",
                                       group.column("_id").fill_null(-(1 << 63))), "_id", text_col, window)
        begins = np.flatnonzero(block.covered(spans))
        edge = np.zeros(len(block.data) + 1, np.int32)
        np.add.at(edge, begins, 1)
        np.add.at(edge, np.minimum(begins + window, len(block.data)), -1)
        gone = np.cumsum(edge[:-1], out=edge[:-1]) > 0
        del begins, edge
        out = group.select(names).take(pa.array(block.order))
        removed, starts, ends, kept = [], [], [], []
        for a, b in zip(block.starts.tolist(), block.ends.tolist()):
            mask = gone[a:b]
            step = np.diff(mask.astype(np.int8), prepend=0, append=0)
            removed.append(int(mask.sum()))
            starts.append(np.flatnonzero(step > 0))
            ends.append(np.flatnonzero(step < 0))
            kept.append(block.data[a:b][~mask].tobytes())
        for column, kind, values in (
            ("n_bytes", pa.int64(), block.ends - block.starts), ("n_removed", pa.int64(), removed),
            ("span_starts", pa.list_(pa.int64()), starts), ("span_ends", pa.list_(pa.int64()), ends),
            ("kept", pa.binary(), kept),
        ):
            out = out.append_column(column, pa.array(values, kind))
        return out

    def meet(left: DataFrame, right: DataFrame, function, schema: str) -> DataFrame:
        return left.groupBy("_block").cogroup(right.groupBy("block")).applyInArrow(function, schema)

    settled = materialise(
        known.groupBy("_block").applyInArrow(round_1, _ENTRY).groupBy("range").applyInArrow(_settle, _SPAN), "chunks"
    )
    shared = materialise(
        meet(known, settled, round_2, "range long, block long, key binary")
        .groupBy("range").applyInArrow(_share, "block long, key binary"), "ranks",
    )
    nothing = F.lit(None).cast("binary")
    answers = settled.select("block", nothing.alias("key"), "doc", "pos", "len").union(
        shared.select("block", "key", nothing, nothing, nothing)
    )
    repeats = meet(known, answers, round_3, _ENTRY).groupBy("range").applyInArrow(_settle, _SPAN)
    spans = materialise(repeats, "repeats").union(settled)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    schema = f"{fields}, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>, kept binary"
    found = meet(table, spans, finish, schema)
    return found if carry else found.drop(text_col)
