"""Language ID by cross-parsing: the language whose text covers a document in the
fewest phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.words import byte_batches, text_bytes
from quarry.operators.ranking import top_k

#: Bounds of what is learned: normalised bytes of text for each language, and
#: texts for each language from which they are taken.
TRAIN_BYTES, TRAIN_TEXTS = 48_000, 400
#: Normalised bytes in which a text is parsed; phrases end with a block.
BLOCK = 1024
#: Blocks that are parsed side by side.
WAVE = 1 << 13
_MISS = 1 << 30

_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True
_ASCII = np.zeros(256, bool)
_ASCII[97:123] = _ASCII[65:91] = True


def _counted(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marked bytes of every text."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.add.reduceat(marks, offsets[:-1][some], dtype=np.int32)
    return out


def normalise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes of all texts with every run of other ASCII characters as
    one space, and the offsets of the texts."""
    data, offsets = text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    letter = _LETTERS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    keep = letter.copy()
    # The first of a run of others stays as a space.
    keep[1:] |= letter[:-1] & ~letter[1:]
    keep |= first[:-1]
    out = np.where(letter, data, np.uint8(32))[keep]
    return out, np.concatenate([[0], np.cumsum(_counted(keep, offsets))])


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text (null: no) holds a letter of any script."""
    data, offsets = text_bytes(texts)
    found = _counted(_ASCII[data], offsets) > 0
    for i in np.flatnonzero(~found & (offsets[1:] > offsets[:-1])):
        found[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    return found


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings (Blumer et al., 1985)."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and symbol not in moves[state]:
            moves[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = moves[state][symbol]
            if length[state] + 1 == length[target]:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[state] + 1)
                link.append(link[target])
                while state >= 0 and moves[state].get(symbol) == target:
                    moves[state][symbol] = copy
                    state = link[state]
                link[target] = link[new] = copy
        last = new
    return moves


class Automata:
    """Dense tables of all languages, and the parsing of blocks by them."""

    def __init__(self, model: list[tuple[str, int, bytes]]):
        self.languages = [name for name, _, _ in model]
        edges = [np.frombuffer(blob, np.int32).reshape(-1, 3) for _, _, blob in model]
        symbols = np.unique(np.concatenate([e[:, 1] for e in edges])) if edges else np.zeros(0, int)
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[symbols] = np.arange(1, len(symbols) + 1)
        self.width = len(symbols) + 1
        self.bits = [np.log2(size + 1) for _, size, _ in model]
        self.tables = []
        for e in edges:
            table = np.full((int(e[:, [0, 2]].max()) + 1, self.width), -1, np.int32)
            table[e[:, 0], self.symbol[e[:, 1]]] = e[:, 2] * self.width
            # Where a phrase ends, the next begins with the same symbol at the root.
            root = np.where(table[0] < 0, 0, table[0]) | _MISS
            self.tables.append(np.where(table < 0, root, table).ravel())

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of every text by every language; phrases end with blocks."""
        lengths = np.diff(offsets)
        blocks = -(-lengths // BLOCK)
        text = np.repeat(np.arange(len(lengths)), blocks)
        number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offsets[:-1][text] + number * BLOCK
        size = np.minimum(offsets[1:][text] - start, BLOCK)
        order = np.argsort(-size, kind="stable")
        out = np.zeros((len(lengths), len(self.tables)))
        coded = np.append(self.symbol[data], np.zeros(BLOCK, np.uint8))
        for i in range(0, len(order), WAVE):
            wave = order[i : i + WAVE]
            grid = np.ascontiguousarray(coded[start[wave][:, None] + np.arange(size[wave[0]])].T)
            alive = len(wave) - np.searchsorted(size[wave][::-1], np.arange(size[wave[0]]), side="right")
            for k, table in enumerate(self.tables):
                state, count = np.zeros(len(wave), np.int32), np.ones(len(wave), np.int32)
                for column, n in zip(grid, alive):
                    found = table[state[:n] + column[:n]]
                    count[:n] += found >> 30
                    state[:n] = found & (_MISS - 1)
                out[:, k] += np.bincount(text[wave], count, len(lengths))
        return out


def sample_blocks(data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, size: int) -> bytes:
    """At most ``size`` bytes of all texts together, each giving a block of the
    same length (or its whole text, if shorter) from a place that its seed decides."""
    lengths = np.diff(offsets)
    ascending = np.sort(lengths)
    # The block length if the i shortest texts are taken whole.
    level = (size - (np.cumsum(ascending) - ascending)) // np.arange(len(lengths), 0, -1)
    block = max(0, int(level[np.argmax(level < ascending)])) if (level < ascending).any() else int(lengths.max())
    parts = []
    for start, length, seed in zip(offsets.tolist(), lengths.tolist(), seeds.tolist()):
        start += seed % (length - block + 1) if length > block else 0
        parts.append(data[start : start + min(length, block)].tobytes())
    return b"".join(parts)


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, int, bytes]]:
    """``language, bytes learned from, transitions`` for every label of ``df``.

    Of each label the ``TRAIN_TEXTS`` distinct texts with the smallest hashes
    give ``TRAIN_BYTES`` normalised bytes, equal blocks of all of them; a text
    shorter than its block leaves the rest to the others. A block begins at a
    place of the text that its hash decides. The hashes are ranked in two levels
    before any text is moved, the automata are built in tasks, and only they
    come to the driver, bounded by the number of labels.
    """
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")
    )
    chosen = top_k(known.select("lang", "h").distinct(), ["lang"], [F.col("h")], TRAIN_TEXTS, ["h"])
    edge = chosen.groupBy("lang").agg(F.max("h").alias("edge"))
    texts = known.join(F.broadcast(edge), "lang").where("h <= edge").select("lang", "h", "text").distinct()

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "text"])
        data, offsets = normalise(pa.array(group["text"], pa.string()))
        text = sample_blocks(data, offsets, group["h"].to_numpy(), TRAIN_BYTES)
        moves = suffix_automaton(text)
        edges = np.array([(s, c, t) for s, m in enumerate(moves) for c, t in m.items()], np.int32)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "size": [len(text)], "edges": [edges.tobytes()]})

    model = texts.groupBy("lang").applyInPandas(build, "lang string, size long, edges binary")
    return sorted((r["lang"], r["size"], bytes(r["edges"])) for r in model.toLocalIterator())


_OPEN: dict[str, Automata] = {}


def identify(df: DataFrame, model: list[tuple[str, int, bytes]], text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``bits`` (replaced if it has them).

    The whole text is cut into blocks of ``BLOCK`` normalised bytes and parsed
    greedily into longest matches of each language's automaton; phrases times
    the log of the learned length, by the text's length, are ``bits`` for a
    byte. The language with the fewest wins, ties to the smaller name; ``score``
    is the second's share of the two best sums (0.5 to 1; one language: 1).
    A null text, one without a letter, or an empty model gives ``und``, score 0
    and null bits. Only the text is an input. Rows repeat as they are.
    """
    spark = df.sparkSession
    df = df.drop("lang_pred", "score", "bits")
    key = hashlib.sha256(repr(model).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(model)
    position = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = Automata(sent.value)
        automata = _OPEN[key]
        for batch in byte_batches(batches, position):
            texts = batch.column(position)
            fit = has_letter(texts) & bool(automata.tables)
            names = np.full(len(texts), "und", object)
            score, bits = np.zeros(len(texts)), np.full(len(texts), np.nan)
            if automata.tables:
                data, offsets = normalise(texts)
                cost = automata.phrases(data, offsets) * automata.bits / np.maximum(np.diff(offsets), 1)[:, None]
                order = np.sort(cost, axis=1)
                best = cost.argmin(axis=1)
                share = order[:, 1] / (order[:, 0] + order[:, 1]).clip(1e-300) if cost.shape[1] > 1 else np.ones(len(texts))
                names[fit] = np.array(automata.languages, object)[best[fit]]
                score[fit], bits[fit] = share[fit], order[fit, 0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(bits, from_pandas=True)],
                [*batch.schema.names, "lang_pred", "score", "bits"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, lang_pred string, score double, bits double")


def held_out(doc_id: Column) -> Column:
    """True where crc32(id as text) mod 4 is 2, and for rows without an id."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(True))
