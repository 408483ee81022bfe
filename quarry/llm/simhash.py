"""SimHash near-duplicates by vantage-point trees over the fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.components import components, forest
from quarry.llm.words import byte_batches, text_bytes
from quarry.session import materialise

#: Fingerprints of which the tree that deals out the shards is made.
SAMPLE = 8192
#: Fingerprints that a shard should hold, and the most shards.
SHARD_ROWS, MAX_SHARDS = 20_000, 4096
#: Below so many fingerprints all pairs of a leaf are compared.
LEAF_ROWS = 256
#: Bytes of one text that are split into words at a time.
TEXT_BYTES = 4 << 20
_SPACE = b" \t\n\r\x0b\x0c"


def _blocks(text: bytes) -> Iterator[bytes]:
    """The text in blocks that end at white space."""
    at = 0
    while len(text) - at > TEXT_BYTES:
        end = at + TEXT_BYTES
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    tail: list[bytes] = []
    some = False
    for block in _blocks(text):
        # lower() and split() of bytes know A-Z and ASCII white space only.
        words = tail + block.lower().split()
        if len(words) < width:
            tail = words
            continue
        some = True
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        parts = [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
        yield np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts))
        tail = words[len(words) - width + 1 :]
    if not some and tail:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), 42)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of the word shingles of a UTF-8 text."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes(text, width):
        ones += _ones(hashes)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id_col, fingerprint`` (a long with the 64 bits). No words, empty or
    null text: fingerprint zero."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, 1):
            data, offsets = text_bytes(batch.column(1))
            whole, at = data.tobytes(), offsets.tolist()
            prints = [fingerprint(whole[a:b], width) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))],
                [id_col, "fingerprint"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(compute, f"`{id_col}` {kind}, fingerprint long")


def _split(points: np.ndarray, radius: int, seed: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a distance that split the points well, or None."""
    best, found = 0.9 * len(points), None
    step = max(1, len(points) // 4096)
    for vantage in points[np.random.default_rng(seed).integers(0, len(points), 3)]:
        count = np.bincount(np.bitwise_count(points[::step] ^ vantage), minlength=65)
        upto = np.cumsum(count) * step
        inner = np.concatenate([upto[radius:], np.repeat(upto[-1], radius)])
        cost = np.maximum(inner, upto[-1] - upto)
        mu = int(cost.argmin())
        if cost[mu] < best:
            best, found = cost[mu], (vantage, mu)
    return found


def plant(points: np.ndarray, radius: int, leaves: int) -> list:
    """A tree as nested lists ``[vantage, mu, inner, outer]``; leaves are numbers."""
    number = iter(range(1 << 30))

    def grow(points: np.ndarray, leaves: float, seed: int):
        cut = _split(points, radius, seed) if leaves > 1 and len(points) >= 16 else None
        if cut is None:
            return next(number)
        d = np.bitwise_count(points ^ cut[0])
        # An overlap makes each side about 0.6 of the whole, so leaves fall by that.
        return [int(cut[0]), cut[1], grow(points[d <= cut[1] + radius], leaves * 0.6, 2 * seed + 1),
                grow(points[d > cut[1]], leaves * 0.6, 2 * seed + 2)]

    return grow(points, leaves, 0) if len(points) else 0


def route(tree, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """``leaf, indices``. Two points within the radius share a leaf: if one has a
    distance to the vantage point of at most mu, the triangle inequality gives
    the other at most mu + radius, and both go in; else both go out."""
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, index = stack.pop()
        if not len(index):
            continue
        if isinstance(node, int):
            yield node, index
            continue
        d = np.bitwise_count(points[index] ^ np.uint64(node[0]))
        stack.append((node[2], index[d <= node[1] + radius]))
        stack.append((node[3], index[d > node[1]]))


def near_pairs(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the components of all pairs within the radius, at most n - 1."""
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    stack = [(np.arange(len(points)), 0)]
    while stack:
        index, seed = stack.pop()
        own = points[index]
        cut = _split(own, radius, seed) if len(index) > LEAF_ROWS else None
        if cut is not None:
            d = np.bitwise_count(own ^ cut[0])
            stack.append((index[d <= cut[1] + radius], 2 * seed % 1_000_003 + 1))
            stack.append((index[d > cut[1]], 2 * seed % 1_000_003 + 2))
            continue
        for i in range(0, len(own), 256):
            near = np.bitwise_count(own[i : i + 256, None] ^ own[None, i:]) <= radius
            x, y = np.nonzero(near)
            keep = x < y
            ends.append((index[i + x[keep]], index[i + y[keep]]))
            held += len(ends[-1][0])
            if held > 1 << 20:
                ends = [forest(*map(np.concatenate, zip(*ends)), len(points))]
                held = len(ends[0][0])
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(*map(np.concatenate, zip(*ends)), len(points))


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints within the radius, enough of
    them for the same components.

    A tree made of a bounded sample deals the fingerprints to shards; one near
    a boundary goes to both sides, so every pair meets in some shard, and each
    shard is searched exactly by a tree of its own. The tree that is sent to the
    tasks has at most ``MAX_SHARDS`` leaves, whatever the number of rows.
    """
    n = prints.count()
    sample = [r[0] for r in prints.select("fingerprint").orderBy(F.xxhash64("fingerprint")).limit(SAMPLE).collect()]
    leaves = min(MAX_SHARDS, math.ceil(n / SHARD_ROWS))
    tree = plant(np.array(sample, np.int64).view(np.uint64), radius, leaves)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch["fingerprint"].to_numpy().view(np.uint64)
            for leaf, index in route(tree, points, radius):
                yield batch.iloc[index].assign(shard=leaf)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        points = group["fingerprint"].to_numpy()
        a, b = near_pairs(points.view(np.uint64), radius)
        return pd.DataFrame({"a": points[a], "b": points[b]})

    dealt = prints.select("fingerprint").mapInPandas(deal, "fingerprint long, shard long")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(
    df: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, fingerprint, component_id`` of every row of ``df``.

    Rows link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id reachable by links. Equal fingerprints
    are reduced to one (aggregated before the shuffle), so any number of copies
    costs one point. Texts without words, empty and null texts have fingerprint
    zero and link like others. Rows without an id take part and get the
    smallest id of their component, null if it has none; repeated rows are each
    returned. An empty table gives an empty one. Ids are integers; other
    columns are not read.
    """
    own = materialise(
        fingerprints(df, width, id_col, text_col).withColumn(id_col, F.col(id_col).cast("long")),
        "fingerprints",
    )
    distinct = own.groupBy("fingerprint").agg(F.min(id_col).alias("rep"))
    named = materialise(distinct, "distinct")
    found = components(links(named, radius))
    # Links are between fingerprints, so those that only rows without an id have
    # take part; the smallest id of a component is found afterwards.
    root = F.coalesce("component", "fingerprint").alias("root")
    rooted = named.join(found, named["fingerprint"] == found["node"], "left").select("fingerprint", "rep", root)
    rooted = materialise(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = rooted.join(least, "root").select("fingerprint", "component_id")
    return own.join(of, "fingerprint").select(id_col, "fingerprint", "component_id")
