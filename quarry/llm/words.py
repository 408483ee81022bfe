"""Whole texts as slices at safe boundaries, and their token ids by a tokenizer file.

A boundary is safe when no token, added special string, normaliser or
pre-tokeniser rule of the vocabulary reaches over it: before white space that
follows other text, and between an ASCII letter and sentence punctuation.
Equal slices are encoded once per worker; the cache is bounded and only saves
time. A text of any length is just more slices.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa

#: Bytes of text that are encoded together.
CHUNK_BYTES = 16 << 20
#: Slices whose ids are gathered at once.
GATHERED = 1 << 16
#: Distinct slices a worker keeps; beyond it the cache starts again.
CACHE_SLICES = 400_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array (null: empty) and its n + 1 offsets."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_rows(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data`` as a binary array."""
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    body = pa.py_buffer(np.ascontiguousarray(data))
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), body])
    return whole.cast(pa.binary())


def byte_batches(batches: Iterator[pa.RecordBatch], column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` again, in batches of about ``limit`` bytes of one
    string column (at least a row each)."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def slice_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where slices start: every text's first byte and every safe boundary."""
    cut = np.zeros(len(data), bool)
    space = _SPACE[data]
    cut[1:] = (space[1:] & ~space[:-1]) | (_STOP[data[1:]] & _LETTER[data[:-1]])
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 of all i, in order."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def gathered(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``ids[ragged(starts, lengths)]``, of which only a part has its indices, which
    are four times the ids and more, at a time."""
    out = np.empty(int(lengths.sum()), ids.dtype)
    end = 0
    for i in range(0, len(starts), GATHERED):
        own = ragged(starts[i : i + GATHERED], lengths[i : i + GATHERED])
        out[end : end + len(own)] = ids[own]
        end += len(own)
    return out


class SliceCache:
    """Token ids of distinct slices; ``encode`` is called once per new slice.

    A full cache drops the slices that only one call asked for, and of the
    others the less asked half if there are too many: most slices are seen
    once, and those that come again should not be encoded again.
    """

    def __init__(self, encode, most: int = CACHE_SLICES):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.asked = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Keeps at most half of ``most`` slices, each of which was asked for again."""
        kept = np.flatnonzero(self.asked > 1)
        half = self.most // 2
        if len(kept) > half:
            kept = np.sort(kept[np.argpartition(-self.asked[kept], half)[:half]])
        counts = self.starts[kept + 1] - self.starts[kept]
        ids = self.ids[ragged(self.starts[kept], counts)]
        stays = np.zeros(len(self.asked), bool)
        stays[kept] = True
        slices = list(compress(self.place, stays.tolist()))
        # What was asked for long ago weighs less, but stays for another round.
        asked = np.maximum(self.asked[kept] // 2, 1)
        # The old table goes before there is a new one.
        self.clear()
        self._room(len(ids))
        self.ids[: len(ids)] = ids
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.place, self.asked = dict(zip(slices, range(len(slices)))), asked

    def _room(self, n: int) -> None:
        if n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(n, len(self.ids)), np.uint32)])

    def _places(self, slices: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, slices, repeat(-1)), np.int64, len(slices))

    def look_up(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Start in ``self.ids`` and number of ids of each slice."""
        at = self._places(slices)
        self.asked[at[at >= 0]] += 1
        if len(self.place) + np.count_nonzero(at < 0) > self.most:
            self._shrink()
            at = self._places(slices)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            fresh = [slices[i] for i in unknown.tolist()]
            ids, counts = self.encode(fresh)
            used, n = self.starts[-1], len(self.asked)
            self._room(int(used) + len(ids))
            self.ids[used : used + len(ids)] = ids
            self.starts = np.concatenate([self.starts, used + np.cumsum(counts)])
            self.place.update(zip(fresh, range(n, n + len(fresh))))
            self.asked = np.concatenate([self.asked, np.ones(len(fresh), np.int64)])
            at[unknown] = np.arange(n, n + len(fresh))
        return self.starts[at], self.starts[at + 1] - self.starts[at]


def chunks(starts: np.ndarray, end: int) -> Iterator[tuple[int, int]]:
    """Runs of slices with about CHUNK_BYTES bytes each."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK_BYTES)))
        yield i, j
        i = j


def distinct_slices(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For slices between ``bounds``: each one's number and the distinct slices."""
    offsets = np.ascontiguousarray(bounds - bounds[0], np.int64)
    body = np.ascontiguousarray(data[bounds[0] : bounds[-1]])
    array = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)]
    )
    coded = array.dictionary_encode()
    data, ends = text_bytes(coded.dictionary)
    data, ends = data.tobytes(), ends.tolist()
    return coded.indices.to_numpy(), [data[a:b] for a, b in zip(ends, ends[1:])]


_OPEN: dict[str, SliceCache] = {}


def tokenizer_cache(path: str) -> SliceCache:
    """The worker's cache for a tokenizers file. Special strings inside a text are
    handled as the library does by default; none are added at the ends."""
    if path not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def encode(slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids, counts = [], []
            for i in range(0, len(slices), 1024):
                part = [s.decode() for s in slices[i : i + 1024]]
                out = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                ids.append(np.array(out.ids, np.uint32))
                counts.append(np.bincount(np.array(out.word_ids, np.int64), minlength=len(part)))
            return np.concatenate(ids), np.concatenate(counts)

        _OPEN[path] = SliceCache(encode)
    return _OPEN[path]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def folded(data: np.ndarray) -> np.ndarray:
    """ASCII capitals in lower case, for vocabularies whose normaliser lowers;
    left alone where an added special string may stand."""
    return data if b"<|" in data.tobytes() else _LOWER[data]


def encoded(
    texts: pa.Array, path: str, keep_ids: bool, lower: bool = True
) -> tuple[np.ndarray, np.ndarray | None]:
    """Tokens per text, and all ids one after the other if ``keep_ids``."""
    data, offsets = text_bytes(texts)
    cache = tokenizer_cache(path)
    starts = slice_starts(data, offsets)
    counts = np.zeros(len(starts), np.int64)
    ids = []
    for i, j in chunks(starts, len(data)):
        end = starts[j] if j < len(starts) else len(data)
        part = data[starts[i] : end]
        part = folded(part) if lower else part
        bounds = np.append(starts[i:j], end) - starts[i]
        index, slices = distinct_slices(part, bounds)
        at, n = cache.look_up(slices)
        counts[i:j] = n[index]
        if keep_ids:
            ids.append(gathered(cache.ids, at[index], n[index]))
    total = np.concatenate([[0], np.cumsum(counts)])
    edge = np.searchsorted(starts, offsets)
    per_text = total[edge[1:]] - total[edge[:-1]]
    return per_text, (np.concatenate(ids) if ids else np.zeros(0, np.uint32)) if keep_ids else None
