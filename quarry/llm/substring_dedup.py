"""Removal of repeated word passages by prefix-partitioned suffix trees.

A suffix is the words from a place to the end of its document. Of the windows of
``window`` words that a document has, each is found from its anchor, the place
in it where a string of half the window has the smallest rank; equal windows
have equal anchors at the same distance, so only suffixes at anchors, and the
few words before them, need to meet:

1. Blocks of documents settle what repeats inside them, ask which anchors other
   blocks have too, and count the prefixes of suffixes.
2. Prefixes of 1, 2, 3, 5, ... words split the suffixes at shared anchors into
   groups: a prefix with too many suffixes for one group is told apart by more
   words, at last by all words of each window. Words travel as symbols of 48 bits.
3. Each group sorts its suffixes into a tree, given by the words that neighbours
   have in common. The leaves below a node of depth ``window - d``, split by the
   d words before them, are the places of one window that begins d words
   earlier; all but the first of them are repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm import blocks, words
from quarry.llm.suffix_dedup import pair, planes, smallest, values
from quarry.session import materialise

#: Suffixes that a group should hold, and keys that one task compares.
GROUP_SUFFIXES, RANGE_KEYS = 1 << 17, 1 << 20
#: Lengths of prefixes in words; half a window is the last.
PREFIXES = (1, 2, 3, 5, 8, 13, 20, 40)
#: Bits of a word's symbol; zero stands for no word.
SYMBOL = np.uint64((1 << 48) - 1)

_U = np.uint64
_ROWS = "block long, ids binary, ends binary, text binary"
_MISSING = -(1 << 63)


def _packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of about a megabyte of text: ids (the least long: none), ends, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in blocks.numbered(batches, 1):
            data, offsets = words.text_bytes(batch.column(1))
            ids = batch.column(0).fill_null(_MISSING).to_numpy(zero_copy_only=False).astype(np.int64)
            row = [[block], [ids.tobytes()], [offsets[1:].tobytes()], [data.tobytes()]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(row, (pa.int64(), *[pa.binary()] * 3))], ["block", "ids", "ends", "text"]
            )

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, _ROWS)


class Block:
    """The documents of one block in order of id, and their words."""

    def __init__(self, table: pa.Table, window: int):
        self.number = table.column("block")[0].as_py()
        ids, texts = [], []
        for row in table.to_pylist():
            ends = np.frombuffer(row["ends"], np.int64)
            ids.append(np.frombuffer(row["ids"], np.int64))
            begins = np.concatenate([[0], ends[:-1]])
            texts += [row["text"][a:b] for a, b in zip(begins.tolist(), ends.tolist())]
        ids = np.concatenate(ids)
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.data = np.frombuffer(b"".join(texts[i] for i in order.tolist()), np.uint8)
        self.ends = np.cumsum([len(texts[i]) for i in order.tolist()], dtype=np.int64)
        solid = ~words._SPACE[self.data]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        heads = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        heads = heads[heads < len(self.data)]
        begin[heads] = solid[heads]
        #: Byte at which each word begins, and the first word of each document.
        self.starts = np.flatnonzero(begin)
        upto = np.concatenate([[0], self.ends]).astype(np.int64)
        self.first = np.searchsorted(self.starts, upto)
        self.solid = solid
        self.window = window

    def symbols(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, _U)
        total = np.cumsum(self.solid)
        bounds = np.append(total[self.starts] - 1, total[-1])
        index, distinct = words.distinct_slices(self.data[self.solid], bounds)
        each = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), _U, len(distinct)) & SYMBOL
        return np.maximum(each, _U(1))[index]

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        """Number of the document that a word belongs to."""
        return np.searchsorted(self.first, place, side="right") - 1

    def windows(self, symbols: np.ndarray) -> np.ndarray:
        """Whether a window of a document with an id begins at each word."""
        n = max(0, len(symbols) - self.window + 1)
        edge = np.zeros(n + 1, np.int32)
        known = self.ids != _MISSING
        a, b = self.first[:-1][known], self.first[1:][known] - self.window + 1
        some = b > a
        np.add.at(edge, a[some], 1)
        np.add.at(edge, b[some], -1)
        return np.cumsum(edge[:-1]) > 0

    def order_of(self, place: np.ndarray) -> np.ndarray:
        """Order of windows inside the block: id, then start; rows with one id tie."""
        doc = self.doc_of(place)
        rank = np.searchsorted(self.ids, self.ids[doc])
        return rank << 32 | place - self.first[doc]


def _names(symbols: np.ndarray, length: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Ranks of the strings of ``length`` words at each place, by doubling."""
    ranks, reach = pair(symbols, symbols, seed), 1
    while reach < length:
        offset = min(reach, length - reach)
        ranks = pair(ranks[:-offset], ranks[offset:], seed)
        reach += offset
    return ranks


def _repeated(key: np.ndarray, more: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether the same key has a smaller order."""
    by = np.lexsort((order, more, key))
    k, m, o = key[by], more[by], order[by]
    head = np.ones(len(by), bool)
    head[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    out = np.zeros(len(by), bool)
    out[by] = o > o[head][np.cumsum(head) - 1] if len(by) else False
    return out


class Anchors:
    """The windows that a block cannot settle alone, by anchor."""

    def __init__(self, block: Block):
        window, self.block = block.window, block
        self.symbols = block.symbols()
        place = np.flatnonzero(block.windows(self.symbols))
        self.settled = np.zeros(0, np.int64)
        self.anchor = self.shift = self.at = np.zeros(0, np.int64)
        self.keys = np.zeros(0, _U)
        if not len(place):
            return
        own = _names(self.symbols, window)[place]
        more = _names(self.symbols, window, 0xC2B2AE3D27D4EB4F)[place]
        old = _repeated(own, more, block.order_of(place))
        self.settled, place = place[old], place[~old]
        half = window // 2
        ranks = _names(self.symbols, half)
        low = smallest(ranks, window - half + 1)[place]
        anchor = np.zeros(len(place), np.int64)
        for d in range(window - half, -1, -1):  # the leftmost of equal ones stays
            anchor = np.where(ranks[place + d] == low, place + d, anchor)
        #: Distinct anchors; number of its anchor and distance to it of each window.
        self.anchor, self.at = np.unique(anchor, return_inverse=True)
        self.shift = anchor - place
        self.keys = ranks[self.anchor] >> _U(16)

    def prefixes(self, some: np.ndarray) -> Iterator[np.ndarray]:
        """Names of the first 1, 2, 3, 5, ... words at some anchors, up to half a
        window: so many words all windows of an anchor have from it on."""
        block, place = self.block, self.anchor[some]
        half = block.window // 2
        end = block.first[block.doc_of(place) + 1]
        name, done = np.zeros(len(place), _U), 0
        for length in (*(p for p in PREFIXES if p < half), half):
            for k in range(done, length):
                inside = place + k < end
                name = pair(name, np.where(inside, self.symbols[np.where(inside, place + k, 0)], _U(0)))
            done = length
            yield name

    def whole(self, by_shift: list[np.ndarray]) -> list[np.ndarray]:
        """Names of whole windows, given some anchors for each distance."""
        if not any(map(len, by_shift)):
            return []
        names = _names(self.symbols, self.block.window)
        return [names[self.anchor[some] - d] for d, some in enumerate(by_shift)]

    def context(self, some: np.ndarray) -> np.ndarray:
        """Symbols at some anchors: the window's words from it on, then the words
        before it, nearest first; zero outside of the document."""
        block, place = self.block, self.anchor[some]
        doc = block.doc_of(place)
        a, b = block.first[doc], block.first[doc + 1]
        before = block.window - block.window // 2
        out = np.zeros((block.window + before, len(place)), _U)
        for i, k in enumerate((*range(block.window), *range(-1, -1 - before, -1))):
            inside = (place + k >= a) & (place + k < b)
            out[i, inside] = self.symbols[place[inside] + k]
        return out


def _six(x: np.ndarray) -> bytes:
    """The lower six bytes of each value, by significance."""
    return planes(x)[: 6 * len(x)]


def _of_six(blob: bytes) -> np.ndarray:
    return values(blob + bytes(len(blob) // 3), _U)


def _heavy(anchors: Anchors, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``level, names, counts`` of prefixes that at least ``least`` suffixes have."""
    some = np.arange(len(anchors.anchor))
    for level, name in enumerate(anchors.prefixes(some)):
        distinct, n = np.unique(name, return_counts=True)
        many = n >= least
        if not many.any():
            return
        yield level, distinct[many], n[many]


def _subtree(symbols: np.ndarray, mask: np.ndarray, doc: np.ndarray, pos: np.ndarray, window: int) -> np.ndarray:
    """Of each suffix the windows, by distance as bits, of which a smaller place
    (id, then position) has the same words."""
    n = len(mask)
    before = window - window // 2
    right, left = symbols[:window], symbols[window:]

    def tree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves in order, and how many words each shares with the one before."""
        order = np.lexsort(rows[::-1])
        common, equal = np.zeros(n, np.int32), np.ones(n, bool)
        equal[:1] = False
        for row in rows:
            own = row[order]
            equal[1:] &= own[1:] == own[:-1]
            common += equal
        return order, common

    def node(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
        """Number of the node of that depth above each leaf."""
        out = np.zeros(n, np.int64)
        out[order] = np.cumsum(common < depth)
        return out

    by_right, by_left = tree(right), tree(left)
    place = np.lexsort((pos, doc))
    rank = np.zeros(n, np.int64)
    step = np.ones(n, bool)
    step[1:] = (doc[place][1:] != doc[place][:-1]) | (pos[place][1:] != pos[place][:-1])
    rank[place] = np.cumsum(step)
    gone = np.zeros(n, mask.dtype)
    for d in range(before + 1):
        bit = mask.dtype.type(1 << d)
        some = np.flatnonzero(mask & bit)
        deep, back = node(*by_right, window - d)[some], node(*by_left, d)[some]
        old = _repeated(deep, back, rank[some])
        gone[some[old]] |= bit
    return gone


_KEYS = "kind int, range long, block long, key binary, n binary"
_SHARED = "kind int, block long, key binary"
_SUFFIXES = "grp long, block long, doc binary, pos binary, at binary, mask binary, symbols binary"


def _settle(table: pa.Table) -> pa.Table:
    """Kind 0: the anchors of a range that several blocks have, back to them. Kind
    1 and more: the prefixes of a level with more suffixes than a group holds."""
    kind = table.column("kind")[0].as_py()
    numbers = table.column("block").to_pylist()
    each = [values(b, _U) for b in table.column("key").to_pylist()] if kind else [
        _of_six(b) for b in table.column("key").to_pylist()]
    rows = []
    if kind:
        n = np.concatenate([values(b, np.int64) for b in table.column("n").to_pylist()])
        names, at = np.unique(np.concatenate(each), return_inverse=True)
        large = names[np.bincount(at, n) > GROUP_SUFFIXES]
        rows = [(kind, None, large.tobytes())] if len(large) else []
    else:
        keys, counts = np.unique(np.concatenate(each), return_counts=True)
        several = keys[counts > 1]
        for number, own in zip(numbers, each):
            back = own[np.isin(own, several, assume_unique=True)]
            if len(back):
                rows.append((0, number, _six(back)))
    columns = list(zip(*rows)) if rows else [()] * 3
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary()))], ["kind", "block", "key"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """``id_col, n_words, n_removed, span_starts, span_ends, kept`` of every row.

    Words are runs of other bytes than ASCII white space. A word goes if it is in
    ``window`` consecutive words (4 to 120) that also start earlier: in a document
    with a smaller id, or before in the same one. Windows are judged on the
    input. Spans are the maximal runs of removed words, by number; ``kept`` is
    the words that stay, joined by one space.

    A null text has no words. Rows without an id lose nothing and make others
    lose nothing. Rows with equal ids are one document: equal places in them are
    not earlier than each other, so repeated rows give repeated results. An
    empty table gives an empty one. Ids are integers (long in the result); other
    columns are not read, whatever their names.

    What many documents share is settled inside the blocks first, so it travels
    once for each block; a group takes one place of it for each block.
    """
    if not 4 <= window <= 120:
        raise ValueError("window must be from 4 to 120 words")
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_blocks = math.ceil(total / blocks.BLOCK_BYTES) or 1
    ranges = math.ceil(total / 30 / RANGE_KEYS) or 1
    # A prefix that is too large has at least this many suffixes in some block.
    least = max(2, GROUP_SUFFIXES // (2 * n_blocks))
    bits = window - window // 2 + 1
    mask_type = np.dtype(np.uint16 if bits <= 16 else np.uint64)
    table = blocks.written(spark, _packed(df, id_col, text_col), n_blocks, "passages")

    def round_1(group: pa.Table) -> pa.Table:
        block = Block(group, window)
        anchors = Anchors(block)
        keys = np.unique(anchors.keys)
        rows = [(0, part, block.number, _six(keys[own]), None)
                for part, own in blocks.cuts((keys % _U(ranges)).astype(np.int64), ranges)]
        for level, names, counts in _heavy(anchors, least):
            for part, own in blocks.cuts((names % _U(ranges)).astype(np.int64), ranges):
                rows.append((1 + level, part, block.number, planes(names[own]), planes(counts[own])))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "range", "block", "key", "n"])

    asked = table.groupBy("block").applyInArrow(round_1, _KEYS).repartition(max(ranges, 2), "kind", "range")
    answers = materialise(asked.groupBy("kind", "range").applyInArrow(_settle, _SHARED), "anchors")
    # At most a prefix for each GROUP_SUFFIXES suffixes and level.
    large: dict[int, np.ndarray] = {}
    for row in answers.where("kind > 0").collect():
        large[row["kind"] - 1] = np.append(large.get(row["kind"] - 1, np.zeros(0, _U)), np.frombuffer(row["key"], _U))
    shared = answers.where("kind = 0").select("block", "key")
    suffixes = shared.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    groups = math.ceil(suffixes / 6 / GROUP_SUFFIXES * 2) or 1

    def round_2(group: pa.Table, keys: pa.Table) -> pa.Table:
        rows = []
        wanted = [_of_six(b) for b in keys.column("key").to_pylist()]
        if len(group) and wanted:
            block = Block(group, window)
            anchors = Anchors(block)
            some = np.flatnonzero(np.isin(anchors.keys, np.concatenate(wanted)))
            mask = np.zeros(len(anchors.anchor), mask_type)
            np.bitwise_or.at(mask, anchors.at, mask_type.type(1) << anchors.shift.astype(mask_type))
            code, open_ = np.zeros(len(some), _U), np.ones(len(some), bool)
            for level, name in enumerate(anchors.prefixes(some)):
                code = np.where(open_, name, code)
                open_ &= np.isin(name, large.get(level, np.zeros(0, _U)))
                if not open_.any():
                    break
            # The windows of a prefix that is too large even so go by all their words.
            whole = [np.flatnonzero(open_ & (mask[some] & mask_type.type(1 << d) > 0)) for d in range(bits)]
            code = [code[~open_], *anchors.whole([some[own] for own in whole])]
            own_mask = [mask[some][~open_], *(np.full(len(own), 1 << d, mask_type) for d, own in enumerate(whole))]
            some = np.concatenate([some[~open_], *(some[own] for own in whole)])
            code, own_mask = np.concatenate(code), np.concatenate(own_mask)
            place = anchors.anchor[some]
            doc = block.doc_of(place)
            fields = (block.ids[doc], (place - block.first[doc]).astype(np.uint32), place.astype(np.uint32), own_mask)
            for part, own in blocks.cuts((code % _U(groups)).astype(np.int64), groups):
                symbols = b"".join(_six(x) for x in anchors.context(some[own]))
                rows.append((part, block.number, *(planes(x[own]) for x in fields), symbols))
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)],
                        ["grp", "block", "doc", "pos", "at", "mask", "symbols"])

    def subtree(group: pa.Table) -> pa.Table:
        part = group.to_pydict()
        each = {c: [values(b, k) for b in part[c]] for c, k in
                (("doc", np.int64), ("pos", np.uint32), ("at", np.uint32), ("mask", mask_type))}
        rows = window + window - window // 2
        symbols = np.concatenate([
            np.stack([_of_six(b[i * len(b) // rows : (i + 1) * len(b) // rows]) for i in range(rows)])
            for b in part["symbols"]], axis=1)
        gone = _subtree(symbols, *(np.concatenate(each[c]) for c in ("mask", "doc", "pos")), window)
        out, at = [], 0
        for i, number in enumerate(part["block"]):
            own = gone[at : at + len(each["at"][i])]
            at += len(own)
            if own.any():
                out.append((number, planes(each["at"][i][own > 0]), planes(own[own > 0])))
        columns = list(zip(*out)) if out else [()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()))],
                        ["block", "at", "mask"])

    def finish(group: pa.Table, found: pa.Table) -> pa.Table:
        if not len(group):
            return _result([], [], [], [], np.zeros(0, bool), id_col)
        block = Block(group, window)
        edge = np.zeros(len(block.starts) + 1, np.int32)
        begins = [_settled(block)]
        for at, mask in zip(found.column("at").to_pylist(), found.column("mask").to_pylist()):
            at, mask = values(at, np.uint32).astype(np.int64), values(mask, mask_type)
            begins += [at[mask & mask_type.type(1 << d) > 0] - d for d in range(bits)]
        begins = np.concatenate(begins)
        np.add.at(edge, begins, 1)
        np.add.at(edge, begins + window, -1)
        return _kept(block, np.cumsum(edge[:-1]) > 0, id_col)

    sent = blocks.meet(table, shared, round_2, _SUFFIXES).repartition(max(groups, 2), "grp")
    repeats = materialise(sent.groupBy("grp").applyInArrow(subtree, "block long, at binary, mask binary"), "repeats")
    schema = f"`{id_col}` long, n_words long, n_removed long, span_starts array<long>, span_ends array<long>, kept string"
    return blocks.meet(table, repeats, finish, schema)


def _settled(block: Block) -> np.ndarray:
    """Places of the windows that are repeats inside the block."""
    symbols = block.symbols()
    place = np.flatnonzero(block.windows(symbols))
    if not len(place):
        return place
    key, more = (_names(symbols, block.window, seed)[place] for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
    return place[_repeated(key, more, block.order_of(place))]


def _kept(block: Block, gone: np.ndarray, id_col: str) -> pa.Table:
    """The result's rows of a block, of which some words are gone."""
    n = len(block.starts)
    keep = ~gone
    docs = len(block.ids)
    head = np.zeros(n + 1, bool)
    head[block.first[:-1]] = True
    head = head[:n]
    before = np.concatenate([[0], np.cumsum(keep)])
    # The number of kept words of the document before each word.
    led = before[:-1] - before[block.first[block.doc_of(np.arange(n))]] if n else np.zeros(0, np.int64)
    data = block.data.copy()
    word = np.cumsum(np.bincount(block.starts, minlength=len(data))) - 1 if len(data) else np.zeros(0, np.int64)
    mask = block.solid & keep[np.maximum(word, 0)] if n else np.zeros(len(data), bool)
    joint = block.starts[keep & (led > 0)] - 1
    mask[joint] = True
    data[joint] = 32
    ends = np.concatenate([[0], np.cumsum(mask)])[block.ends] if docs else np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate([[0], ends]))
    counts = np.diff(block.first)
    removed = counts - np.diff(before[block.first])
    begin = gone & (head | ~np.concatenate([[False], gone[:-1]])) if n else gone
    stop = gone & np.concatenate([head[1:] | ~gone[1:], [True]]) if n else gone
    base = block.first[block.doc_of(np.arange(n))] if n else np.zeros(0, np.int64)
    place = np.arange(n) - base
    bounds = np.concatenate([[0], np.cumsum(begin)])[block.first].astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int64()))
             for x in (place[begin], place[stop] + 1)]
    ids = pa.array(block.ids, pa.int64(), mask=block.ids == _MISSING)
    kept = words.binary_rows(data[mask], lengths).cast(pa.string())
    return pa.table([ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), *spans, kept],
                    [id_col, "n_words", "n_removed", "span_starts", "span_ends", "kept"])
