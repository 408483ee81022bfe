"""Phrase collocations from sorted count streams.

Texts become blocks of word numbers, one language each. Level by level, the
n-grams of a block are pairs (a, b) of frequent (n-1)-grams, a without the last
and b without the first word; each block sorts and counts its own, a range of
pairs is merged from the sorted runs of all blocks, and those that are frequent
get an id that goes back to the blocks. An n-gram that is not frequent is in no
frequent one, so nothing is lost.

A level's stream ``id, a, b, f`` is then read in prefix order, merged on ``a``
with the ids of the level below, and in suffix order, merged on ``b``: one gives
the counts of all first parts, the other those of all rests, and the same two
orders give each shorter phrase the largest count of an extension by one word to
the right and to the left. All joins are sort-merge joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quarry.llm import blocks, words
from quarry.llm.suffix_dedup import planes, values
from quarry.operators.ranking import top_k
from quarry.session import materialise

#: Entries that one task merges.
RANGE_ENTRIES = 1 << 20
#: Characters that end a piece, and those between the words of a piece.
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _STOP.copy()
_GAP[[9, 32]] = True

_U = np.uint64
_OWNER = _U(1 << 63)
_BLOCK = "block long, lang string, n_words long, dictionary binary, ends binary, stream binary, breaks binary"
_ENTRY = "range int, block long, a binary, b binary, n binary"
_SETTLED = "block long, range int, ids binary, a binary, b binary, n binary, total long"


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """For the words of texts: the number of each, the distinct ones, and whether a
    piece begins at it."""
    data = words._LOWER[data]
    solid = ~_GAP[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | fresh[1:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.int64), [], np.zeros(0, bool)
    stops = np.cumsum(_STOP[data] | fresh[:-1])
    breaks = np.ones(len(starts), bool)
    breaks[1:] = np.diff(stops[starts]) > 0
    total = np.cumsum(solid)
    index, distinct = words.distinct_slices(data[solid], np.append(total[starts] - 1, total[-1]))
    return index, distinct, breaks


def _packed(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """One row for each block: its dictionary, the numbers of its words in order,
    and where pieces begin."""

    def row(number: int, lang: str, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes = np.concatenate([[0], np.cumsum([len(d) for d, _ in held])])
        offsets = np.unique(np.concatenate([o + s for (_, o), s in zip(held, sizes[:-1])]))
        index, distinct, breaks = _split(np.concatenate([d for d, _ in held]), offsets)
        ends = np.cumsum([len(w) for w in distinct], dtype=np.int64)
        fields = (b"".join(distinct), ends.tobytes(), planes(index.astype(np.uint32)), np.packbits(breaks).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([lang]), pa.array([len(index)]), *(pa.array([f], pa.binary()) for f in fields)],
            ["block", "lang", "n_words", "dictionary", "ends", "stream", "breaks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 24
        held: dict[str, list] = {}
        size: dict[str, int] = {}
        for batch in words.byte_batches(batches, 0, blocks.ROW_BYTES):
            coded = batch.column(1).dictionary_encode()
            of = coded.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(coded.dictionary.to_pylist()):
                part = words.text_bytes(batch.column(0).take(pa.array(np.flatnonzero(of == i))))
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part[0])
            full = [lang for lang in size if size[lang] >= blocks.BLOCK_BYTES]
            if sum(size.values()) >= 2 * blocks.BLOCK_BYTES:
                full = list(size)
            for lang in full:
                yield row(number, lang, held.pop(lang))
                number, _ = number + 1, size.pop(lang)
        for lang, parts in held.items():
            yield row(number, lang, parts)
            number += 1

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    return df.select(F.col(text_col).alias("text"), lang).mapInArrow(run, _BLOCK)


class Grams:
    """The n-grams of one block, level by level."""

    def __init__(self, row: dict, ranges: list[int]):
        self.number, self.ranges = row["block"], ranges
        ends = np.frombuffer(row["ends"], np.int64).tolist()
        text = row["dictionary"]
        self.words = [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        seed = xxhash.xxh64_intdigest(row["lang"].encode())
        digests = b"".join(xxhash.xxh3_128_digest(w, seed) for w in self.words)
        self.a, self.b = np.frombuffer(digests, "<u8").reshape(-1, 2).T.copy() if digests else np.zeros((2, 0), _U)
        if "stream" not in row:
            return
        #: Number of the n-gram at each place, below zero where there is none.
        self.at = values(row["stream"], np.uint32).astype(np.int64)
        self.breaks = np.unpackbits(np.frombuffer(row["breaks"], np.uint8), count=len(self.at)).astype(bool)
        self.n = np.bincount(self.at, minlength=len(self.words))

    def parts(self, level: int) -> Iterator[tuple[int, np.ndarray]]:
        mixed = (self.a ^ self.b >> _U(17)) * _U(0x9E3779B97F4A7C15) + self.b * _U(0xBF58476D1CE4E5B9)
        count = self.ranges[level - 1]
        return blocks.cuts(((mixed >> _U(33)) % _U(count)).astype(np.int64), count)

    def rows(self, level: int) -> list[tuple]:
        fields = (self.a, self.b, self.n.astype(np.int64))
        return [(part, self.number, *(planes(x[own]) for x in fields)) for part, own in self.parts(level)]

    def ids(self, level: int, answers: dict[int, bytes]) -> np.ndarray:
        """Ids of this level's n-grams, zero for those that are not frequent."""
        out = np.zeros(len(self.a), _U)
        for part, own in self.parts(level):
            if part in answers:
                out[own] = values(answers[part], _U)
        return out

    def extend(self, level: int, answers: dict[int, bytes]) -> None:
        """Go on to the n-grams of one word more."""
        ids = self.ids(level, answers) & ~_OWNER
        there = self.at >= 0
        there[there] = ids[self.at[there]] > 0
        pair = there[:-1] & there[1:]
        if level == 1:
            pair &= ~self.breaks[1:]
        place = np.flatnonzero(pair)
        first, second = self.at[place], self.at[place + 1]
        width = max(1, len(ids))
        key, index, self.n = np.unique(first * width + second, return_inverse=True, return_counts=True)
        self.a, self.b = ids[key // width], ids[key % width]
        self.at = np.full(max(0, len(self.at) - 1), -1)
        self.at[place] = index


def _settle(least: int) -> Callable[[pa.Table], pa.Table]:
    """Merge the runs of all blocks of a range: a row of ids for each block that has
    a frequent n-gram, and one with the frequent ones and their counts."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        runs = [[values(x, k) for x in table.column(c).to_pylist()] for c, k in (("a", _U), ("b", _U), ("n", np.int64))]
        a, b, n = (np.concatenate(x) for x in runs)
        order = np.lexsort((b, a))
        head = np.ones(len(order), bool)
        head[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        sums = np.add.reduceat(n[order], np.flatnonzero(head))
        many = sums >= least
        name = np.where(many, np.cumsum(many), 0).astype(_U)
        name[many] |= _U(number << 32)
        ids = np.zeros(len(order), _U)
        ids[order] = name[np.cumsum(head) - 1]
        lead = order[head][many]
        rows = []
        if len(lead):
            rows.append((None, number, planes(ids[lead]), planes(a[lead]), planes(b[lead]), planes(sums[many]), int(sums[many].sum())))
        ids[lead] |= _OWNER
        bounds = np.cumsum([0, *map(len, runs[0])])
        for block, x, y in zip(table.column("block").to_pylist(), bounds[:-1], bounds[1:]):
            if ids[x:y].any():
                rows.append((block, number, planes(ids[x:y]), None, None, None, None))
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)],
                        ["block", "range", "ids", "a", "b", "n", "total"])

    return run


def _stream(settled: DataFrame) -> DataFrame:
    """``id, a, b, f`` of the frequent n-grams of a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fields = [values(row[c], np.int64) for c in ("ids", "a", "b", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in fields], ["id", "a", "b", "f"])

    rows = settled.where("block is null").select("ids", "a", "b", "n")
    return rows.mapInArrow(run, "id long, a long, b long, f long")


def _answers(table: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for row in table.to_pylist():
        out.setdefault(row["level"], {})[row["range"]] = row["ids"]
    return out


def phrases(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 4, min_count: int = 30
) -> tuple[DataFrame, DataFrame]:
    """``lang, words, f, l, r, extension`` of every phrase of 2 to ``max_words``
    words that occurs ``min_count`` times in its language, and ``lang, n``.

    ``l`` and ``r`` are the counts of the first k words and of the rest, for k = 1,
    2, ...; ``extension`` is the largest count of a phrase with one word more at
    either end, null if none is frequent or longer ones are not counted.
    Texts are lower-cased in A-Z, cut at ``.,;:!?`` and line ends, and their
    words stand between spaces and tabs. A null text has no words, a null
    language is ``und``. Repeated rows count as often as they stand there; an
    empty table gives empty results. Other columns are not read.
    """
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    table = blocks.written(spark, _packed(df, text_col, lang_col), math.ceil(total / blocks.BLOCK_BYTES), "streams")
    ranges = [math.ceil(total / 30 / RANGE_ENTRIES) or 1]
    read = table.select("block", "lang", "dictionary", "ends", "stream", "breaks")

    def entries(rows: list[tuple]) -> pa.Table:
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["range", "block", "a", "b", "n"])

    def first(group: pa.Table) -> pa.Table:
        return entries([row for own in group.to_pylist() for row in Grams(own, ranges).rows(1)])

    def settled(asked: DataFrame, level: int) -> DataFrame:
        dealt = asked.repartitionById(ranges[level - 1], F.col("range"))
        return materialise(dealt.groupBy("range").applyInArrow(_settle(min_count), _SETTLED), f"grams_{level}")

    levels = [settled(read.groupBy("block").applyInArrow(first, _ENTRY), 1)]
    back = lambda level: levels[level - 1].where("block is not null").select("block", F.lit(level).alias("level"), "range", "ids")

    def owned(group: pa.Table, answers: pa.Table) -> pa.Table:
        names, found = [], np.zeros(0, _U)
        known = _answers(answers)
        lang = ""
        if len(group) and known:
            row = group.to_pylist()[0]
            grams, lang = Grams(row, ranges), row["lang"]
            ids = grams.ids(1, known[1])
            own = np.flatnonzero(ids & _OWNER)
            names, found = [grams.words[i] for i in own.tolist()], ids[own] & ~_OWNER
        return pa.table([pa.array(found.astype(np.int64)), pa.array([lang] * len(names), pa.string()),
                         pa.array(names, pa.binary()).cast(pa.string())], ["id", "lang", "word"])

    def extended(level: int, ranges: list[int]) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def extend(group: pa.Table, answers: pa.Table) -> pa.Table:
            known = _answers(answers)
            if not len(group) or not known:
                return entries([])
            own = Grams(group.to_pylist()[0], ranges)
            for below in range(1, level):
                own.extend(below, known.get(below, {}))
            return entries(own.rows(level))

        return extend

    spelled = blocks.meet(table.select("block", "lang", "dictionary", "ends"), back(1), owned, "id long, lang string, word string")
    none = F.array().cast("array<long>")
    grams = spelled.hint("merge").join(_stream(levels[0]).select("id", "f"), "id").select(
        "id", "lang", F.array("word").alias("words"), "f", none.alias("l"), none.alias("r")
    )
    grams = materialise(grams, "words")
    out = []
    for level in range(2, max_words + 1):
        # As many places as the frequent n-grams one word shorter have.
        open_places = levels[-1].agg(F.sum("total")).first()[0] or 0
        ranges.append(math.ceil(open_places / RANGE_ENTRIES) or 1)

        answers = back(1)
        for below in range(2, level):
            answers = answers.union(back(below))
        levels.append(settled(blocks.meet(read, answers, extended(level, list(ranges)), _ENTRY), level))
        stream = _stream(levels[-1])
        in_prefix_order = grams.select(F.col("id").alias("a"), "lang", F.col("words").alias("head"), F.col("f").alias("fa"), F.col("l").alias("la"))
        in_suffix_order = grams.select(F.col("id").alias("b"), F.col("words").alias("tail"), F.col("f").alias("fb"), F.col("r").alias("rb"))
        merged = stream.hint("merge").join(in_prefix_order, "a").hint("merge").join(in_suffix_order, "b")
        longer = materialise(merged.select(
            "id", "lang", F.concat("head", F.slice("tail", -1, 1)).alias("words"), "f",
            F.concat("la", F.array("fa")).alias("l"), F.concat(F.array("fb"), "rb").alias("r"), "a", "b",
        ), f"phrases_{level}")
        if level > 2:
            ends = longer.select(F.col("a").alias("id"), "f").union(longer.select("b", "f"))
            extension = ends.groupBy("id").agg(F.max("f").alias("extension"))
            out.append(grams.hint("merge").join(extension, "id", "left"))
        grams = longer.drop("a", "b")
    out.append(grams.withColumn("extension", F.lit(None).cast("long")))
    fields = ["lang", "words", "f", "l", "r", "extension"]
    found = out[0].select(*fields)
    for more in out[1:]:
        found = found.union(more.select(*fields))
    return found, table.groupBy("lang").agg(F.sum("n_words").alias("n"))


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 4, min_count: int = 30,
    top: int = 2000, absorbed: int = 80,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top``
    phrases by score, count, and phrase in byte order.

    Cut after k words, a phrase has the score floor(2,000,000 a / (l + r)), in
    exact arithmetic; its lowest cut counts, the first of equal ones. A phrase
    goes that lies in a longer one with at least ``absorbed`` percent of its
    count: then it lies in one of one word more. Otherwise as :func:`phrases`.
    """
    found, sizes = phrases(df, text_col, lang_col, max_words, min_count)
    wide = lambda c: c.cast("decimal(20,0)")
    percent = F.coalesce(F.lit(100).cast("decimal(3,0)") * wide(F.col("extension")) >= F.lit(absorbed) * wide(F.col("f")), F.lit(False))
    cut = F.zip_with("l", "r", lambda l, r: F.struct(l.alias("l"), r.alias("r")))
    scored = F.transform(cut, lambda x, k: F.struct(
        F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide(F.col("f")), wide(x["l"] + x["r"])).alias("score"),
        k.alias("k"), x["l"].alias("l"), x["r"].alias("r"),
    ))
    rows = found.where(~percent).withColumn("cut", F.array_min(scored)).select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r",
        F.col("cut.score").cast("long").alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_k(rows, ["lang"], order, top, ["phrase"])
    return best.hint("merge").join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
