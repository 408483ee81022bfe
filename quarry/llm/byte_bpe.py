"""Byte-level BPE: boundaries by a parallel scan of a small automaton, then cached merging."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import words

#: Characters of a scan row, and bytes that are scanned together.
ROW, SCAN_BYTES = 512, 1 << 20
#: Bytes of text in a batch, and distinct slices whose ids a worker keeps.
BATCH_BYTES, CACHED = 2 << 20, 200_000

# Symbols of characters, with what follows already looked at: letter, number,
# other, an apostrophe that one or two contraction letters follow, a space that
# the next token takes in, other white space. RESET + symbol begins a text.
LETTER, NUMBER, OTHER, SHORT, LONG, JOINED, BLANK = range(7)
RESET, SAME = 7, 14
# States: a token must begin; after a joined space; in letters, numbers, others;
# one or two letters of a contraction to come.
BEGIN, SPACE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE, TWO = range(7)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a token begins here" by [symbol, state]."""
    step = np.tile(np.arange(7, dtype=np.uint8), (15, 1))
    begins = np.zeros((15, 7), bool)
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS),
                        (SHORT, IN_OTHERS), (LONG, IN_OTHERS)):
        for state in (BEGIN, SPACE, IN_LETTERS, IN_NUMBERS, IN_OTHERS):
            step[symbol, state] = run
            begins[symbol, state] = state not in (SPACE, run)
            if symbol in (SHORT, LONG) and begins[symbol, state]:
                step[symbol, state] = ONE if symbol == SHORT else TWO
    step[LETTER, ONE], step[LETTER, TWO] = BEGIN, ONE
    step[JOINED], step[BLANK] = SPACE, BEGIN
    for symbol in range(7):
        step[RESET + symbol] = step[symbol, BEGIN]
        begins[RESET + symbol] = True
    return step, begins


STEP, BEGINS = _automaton()


def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK of every code point, by its properties."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    kinds = [(regex.compile(rf"\p{{{name}}}+"), symbol) for name, symbol in (("L", LETTER), ("N", NUMBER), ("White_Space", BLANK))]
    for at in range(0, 0x110000, 0x800):
        if at != 0xD800:  # surrogates are no characters
            part = "".join(map(chr, range(at, at + 0x800)))
            for kind, symbol in kinds:
                for found in kind.finditer(part):
                    table[at + found.start() : at + found.end()] = symbol
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and where each begins."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead].astype(np.int32)
    more = (first >= 0xC0).astype(np.int8) + (first >= 0xE0) + (first >= 0xF0)
    point = first & np.array([0x7F, 0x1F, 0x0F, 0x07])[more]
    for i in (1, 2, 3):
        far = np.flatnonzero(more >= i)
        point[far] = point[far] << 6 | (data[lead[far] + i] & 0x3F)
    return point, lead


def scan(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol. Transition functions compose associatively:
    each row of symbols becomes one function, the functions of all rows are
    composed by doubling, and the rows then run side by side from known states."""
    rows = -(-len(symbols) // ROW)
    grid = np.full(rows * ROW, SAME, np.uint8)
    grid[: len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, ROW).T)
    flat = STEP.ravel()
    whole = np.tile(np.arange(7, dtype=np.uint8), (rows, 1))
    for column in grid:
        whole = flat[column[:, None] * np.uint8(7) + whole]
    reach = 1
    while reach < rows:
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].astype(np.int64), axis=1)
        reach *= 2
    state = np.full(rows, BEGIN, np.uint8)
    state[1:] = whole[:-1, BEGIN]
    before = np.empty_like(grid)
    for i, column in enumerate(grid):
        before[i] = state
        state = flat[column * np.uint8(7) + state]
    return np.ascontiguousarray(before.T).ravel()[: len(symbols)]


def token_slices(data: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens begin; ``first`` marks the first byte of texts."""
    point, lead = code_points(data)
    n = len(point)
    kind, starts = classes[point], first[lead]
    blank = kind == BLANK
    ends = np.append(starts[1:], True)
    after = np.append(point[1:], 0)
    after[ends] = 0
    after2 = np.append(after[1:], 0)
    after2[ends] = 0
    solid_next = ~ends & ~np.append(blank[1:], False)
    symbol = kind.copy()
    mark = point == ord("'")
    symbol[mark & np.isin(after, [ord(c) for c in "stmd"])] = SHORT
    pair = after * 0x110000 + after2.astype(np.int64) if n else after
    symbol[mark & np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])] = LONG
    symbol[(point == 32) & solid_next] = JOINED
    symbol[starts] += RESET
    cut = BEGINS[symbol, scan(symbol)]
    blank_before = np.append(False, blank[:-1]) & ~starts
    cut = np.where(blank, ~blank_before | solid_next, cut)
    return lead[cut]


def scan_parts(data: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about SCAN_BYTES that end before a text's first byte or before a
    space between two ASCII letters, where a token always begins."""
    at = 0
    while at < len(data):
        end, look = min(len(data), at + SCAN_BYTES), 1 << 16
        while end < len(data):
            part = data[end - 1 : end + look + 1]
            letter = words._LETTER[part]
            safe = letter[:-2] & (part[1:-1] == 32) & letter[2:]
            safe |= first[end : end + len(safe)]
            hit = np.flatnonzero(safe)
            if len(hit):
                end += int(hit[0])
                break
            end = min(len(data), end + max(1, len(safe)))
        yield at, end
        at = end


def _rank_file(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as lines:
        return [(base64.b64decode(token), int(rank)) for token, rank in (line.split() for line in lines if line.strip())]


class Pieces:
    """The bytes of the ids of a rank file."""

    def __init__(self, path: str):
        pairs = _rank_file(path)
        table = [b""] * (max((rank for _, rank in pairs), default=-1) + 1)
        for token, rank in pairs:
            table[rank] = token
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def placed(self, ids: np.ndarray, offsets: np.ndarray | None) -> np.ndarray:
        """The bytes of ids, each written where its offset says; without offsets one
        after the other."""
        lengths = self.lengths[ids]
        data = self.bytes[words.ragged(self.starts[ids], lengths)]
        if offsets is None:
            return data
        out = np.zeros(len(data), np.uint8)
        out[words.ragged(offsets, lengths)] = data
        return out


class Ranks(Pieces):
    """A rank file for merging of slices."""

    def __init__(self, path: str):
        super().__init__(path)
        self.rank = dict(_rank_file(path))
        self.classes = _classes()
        self.cache = words.SliceCache(self.encode, CACHED)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: of all neighbours the pair of lowest rank, leftmost
        first, is joined until none has a rank."""
        rank = self.rank
        if piece in rank:
            return [rank[piece]]
        n = len(piece)
        right, left = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j >= n or rank.get(piece[i : right[j]]) != r:
                continue
            k = right[j]
            gone[j] = 1
            right[i] = k
            if k < n:
                left[k] = i
                if (r := rank.get(piece[i : right[k]])) is not None:
                    heapq.heappush(heap, (r, i))
            h = left[i]
            if h >= 0 and (r := rank.get(piece[h : right[i]])) is not None:
                heapq.heappush(heap, (r, h))
        ids, i = [], 0
        while i < n:
            ids.append(rank[piece[i : right[i]]])
            i = right[i]
        return ids

    def encode(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.merge(s) for s in slices]
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and how many each text has."""
        data, offsets = words.text_bytes(texts)
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        first = first[:-1]
        ids, starts, counts = [], [], []
        for a, b in scan_parts(data, first):
            own = first[a:b].copy()
            own[:1] = True
            bounds = token_slices(data[a:b], own, self.classes)
            index, slices = words.distinct_slices(data[a:b], np.append(bounds, b - a))
            at, n = self.cache.look_up(slices)
            ids.append(self.cache.ids[words.ragged(at[index], n[index])])
            starts.append(bounds + a)
            counts.append(n[index])
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        edge = np.searchsorted(np.concatenate(starts), offsets)
        return np.concatenate(ids), total[edge[1:]] - total[edge[:-1]]


_OPEN: dict[tuple[type, str], Pieces] = {}


def _opened(kind: type, path: str) -> Pieces:
    """The worker's tables: those for merging serve for decoding too."""
    found = _OPEN.get((Ranks, path)) or _OPEN.get((kind, path))
    if found is None:
        found = _OPEN[kind, path] = kind(path)
    return found


def ranks(path: str) -> Ranks:
    return _opened(Ranks, path)


def id_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All packed ids of a binary column (null: none) and the number in each row."""
    data, offsets = words.text_bytes(column)
    return data.view("<u4") if len(data) else np.zeros(0, "<u4"), np.diff(offsets) // 4


def encode(
    df: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True,
    decoded: bool = False,
) -> DataFrame:
    """``id_col, ids`` and, unless switched off, ``offsets``: the byte of the text
    at which each id begins. ``ids`` is binary, four bytes (little end first) an
    id, as :func:`decode` takes them. With ``decoded`` the bytes that these ids
    and offsets give follow as a column: the round trip in one pass, so that a
    core holds one Python worker and one set of tables.

    A null or empty text has no ids; repeated rows give repeated results; an
    empty table gives an empty one. Other columns are not read. One scan and
    one Arrow function, no shuffle, in batches by bytes; long texts are cut
    where a token begins in any case.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "ids", *["offsets"] * offsets, *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(rank_file)
        for batch in words.byte_batches(batches, 1, BATCH_BYTES):
            ids, n = table.texts(batch.column(1))
            columns = [batch.column(0), words.binary_rows(ids.astype("<u4").view(np.uint8), 4 * n)]
            lengths = table.lengths[ids]
            place = np.cumsum(lengths) - lengths
            bounds = np.concatenate([[0], np.cumsum(n)])
            if offsets:
                text_start = np.repeat(np.append(place, 0)[bounds[:-1]], n)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place - text_start)))
            if decoded:
                total = np.append(place, lengths.sum())[bounds]
                columns.append(words.binary_rows(table.placed(ids, place), np.diff(total)))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, ids binary" + ", offsets array<long>" * offsets + ", decoded binary" * decoded
    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids", offsets_col: str | None = None) -> DataFrame:
    """``id_col, ids_col, decoded`` (binary) of packed ids. Null ids: no bytes. With
    ``offsets_col`` each id's bytes are written where its offset says."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _opened(Pieces, rank_file)
        for batch in words.byte_batches(batches, 1, BATCH_BYTES):
            ids, n = id_parts(batch.column(1))
            bounds = np.concatenate([[0], np.cumsum(n)])
            total = np.concatenate([[0], np.cumsum(table.lengths[ids])])[bounds]
            place = None
            if offsets_col:
                own = batch.column(2).flatten().to_numpy()
                place = own + np.repeat(total[:-1], n)
            data = words.binary_rows(table.placed(ids, place), np.diff(total))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], [id_col, ids_col, "decoded"])

    columns = [id_col, ids_col, *[offsets_col] * bool(offsets_col)]
    return df.select(*columns).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` binary, decoded binary")
