"""Line dedup by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quarry.session import materialise

#: Distinct candidate lines whose ids are broadcast to fetch their texts (8 bytes
#: each); beyond it the texts are fetched by a shuffled join.
BROADCAST_LINES = 1 << 20
#: Lines that may share a segment's key before their digits are looked at too.
CROWD = 64
#: Reads of the lines that share the probe keys out: the code for all keys at once
#: is more than the JVM compiles (8,000 bytes a method).
PROBES = 3


def _segment(length: Column, parts: int, i: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i, which ends where the next begins."""
    start, end = [(length * k / parts).cast("int") if 0 < k < parts else length * (k // parts) for k in (i, i + 1)]
    return start, end - start


def _key(line: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(line, start + 1, size))


def index_keys(line: Column, edits: int) -> Column:
    """One key for each of the ``edits + 1`` segments of a line, null for empty ones
    after the first: if one is empty the first is too, and that one is met."""
    n = F.octet_length(line)
    keys = []
    for i in range(edits + 1):
        start, size = _segment(n, edits + 1, i)
        key = _key(line, n, i, start, size)
        keys.append(F.when(size > 0, key) if i else key)
    return F.array(*keys)


def _probe_keys(line: Column, edits: int, longer: int = 0) -> list[Column]:
    """Keys of the substrings that may equal a segment of a line at most ``edits``
    bytes shorter, or up to ``longer`` bytes longer. Segment i of a length may be
    moved by at most i bytes seen from the left and by at most edits - i seen
    from the right."""
    keys = []
    n = F.octet_length(line)
    for less in range(-longer, edits + 1):
        length = n - less
        for i in range(edits + 1):
            start, size = _segment(length, edits + 1, i)
            for move in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                key = _key(line, length, i, start + move, size)
                inside = (length >= 0) & (start + move >= 0) & (start + move + size <= n)
                keys.append(key if less == 0 and move == 0 else F.when(inside, key))
    return keys


def probe_keys(line: Column, edits: int, longer: int = 0) -> Column:
    """:func:`_probe_keys` as an array; nulls meet nothing."""
    return F.array(*_probe_keys(line, edits, longer))


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Edits of bytes between binary columns, null above ``edits``.

    Banded and bit-parallel: one long holds, for each number of errors, a field
    with a bit for every diagonal of the band that is reached. With each byte of
    ``a`` a match keeps a diagonal; from one error less, a substitution keeps
    it, a deletion lowers and an insertion raises it.
    """
    width = 2 * edits + 2
    repeated = lambda field: sum(field << width * e for e in range(edits + 1))
    band, lower, ones = repeated((1 << (2 * edits + 1)) - 1), repeated((1 << 2 * edits) - 1), repeated(1)
    long = lambda x: F.lit(x).cast("long")
    pad = F.lit(bytes(edits))
    padded = F.concat(pad, b, pad)

    def inserted(reached: Column) -> Column:
        out = reached
        for e in range(1, edits + 1):
            out = out.bitwiseOR(F.shiftleft(reached, e * (width + 1)))
        return out.bitwiseAND(long(band))

    def step(reached: Column, i: Column) -> Column:
        own = F.substring(a, i, F.lit(1))
        match = long(0)
        for d in range(2 * edits + 1):
            same = F.substring(padded, i + d, F.lit(1)) == own
            match = match + F.shiftleft(same.cast("long"), d)
        wrong = reached.bitwiseOR(F.shiftright(reached, 1).bitwiseAND(long(lower)))
        now = reached.bitwiseAND(match * long(ones)).bitwiseOR(F.shiftleft(wrong, width)).bitwiseAND(long(band))
        # An array of one, so that the value is computed once.
        return F.element_at(F.transform(F.array(now), inserted), 1)

    n = F.octet_length(a)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    # With e errors all diagonals from 0 to e are reached before the first byte.
    start = sum(((1 << edits + e + 1) - (1 << edits)) << width * e for e in range(edits + 1))
    last = F.aggregate(places, long(start), step)
    diagonal = F.octet_length(b) - n + edits
    at = F.when((diagonal >= 0) & (diagonal <= 2 * edits), diagonal)
    found = [F.when(F.getbit(last, at + width * e) == 1, F.lit(e)) for e in range(edits + 1)]
    return F.coalesce(*found)


#: Letters that are counted: frequent ones, as each costs a pass over the line.
LETTERS = "etaoinsrhldu"
#: The others, counted only where a segment is crowded.
OTHER_LETTERS = "bcfgjkmpqvwxyz"


def letter_counts(line: Column) -> Column:
    """Counts of LETTERS, modulo 16, in fields of four bits."""
    return _packed_counts(line.cast("string"), LETTERS)


def _packed_counts(text: Column, characters: str) -> Column:
    n = F.octet_length(text)
    packed = F.lit(0).cast("long")
    for i, character in enumerate(characters):
        count = n - F.octet_length(F.replace(text, F.lit(character), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft(F.pmod(count, F.lit(16)).cast("long"), 4 * i))
    return packed


def digit_counts(line: Column) -> Column:
    """Counts of the digits, modulo 16, in fields of four bits."""
    text = line.cast("string")
    return F.when(text.rlike("[0-9]"), _packed_counts(text, "0123456789")).otherwise(F.lit(0).cast("long"))


def counts_apart(a: Column, b: Column, fields: int = len(LETTERS)) -> Column:
    """A lower bound of how far the counts are apart; an edit adds two at most."""
    apart = F.lit(0)
    for i in range(fields):
        field = [F.shiftright(x, 4 * i).bitwiseAND(F.lit(15).cast("long")) for x in (a, b)]
        one = F.pmod(field[0] - field[1], F.lit(16))
        apart = apart + F.least(one, F.lit(16) - one)
    return apart


def _counts(line: Column, min_bytes: int, equal_bytes: int | None) -> Column:
    """Whether a line can go at all: it is long enough, and not blank where
    ``equal_bytes`` lets shorter lines in."""
    if equal_bytes is None:
        return F.octet_length(line) >= min_bytes
    n = F.octet_length(line)
    return (n >= min_bytes) | ((n >= equal_bytes) & line.rlike(r"[^\x09-\x0D\x20]"))


def _distinct_lines(df: DataFrame, id_col: str, text_col: str, min_bytes: int, equal_bytes: int | None) -> DataFrame:
    """``id, line, counts, first``: distinct lines that count, and where each stands
    first. Lines that only equal ones can take have no ``counts``."""
    lines = df.select(
        F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("h"),
        F.posexplode(F.split(text_col, "\n")).alias("number", "text"),
    ).where(_counts(F.col("text"), min_bytes, equal_bytes))
    first = F.min(F.struct("doc", "h", "number")).alias("first")
    # Sorted by a hash of the line, which is one long; lines often begin alike.
    lines = lines.select("*", F.xxhash64("text").alias("_hash"), F.col("text").cast("binary").alias("line"))
    distinct = lines.groupBy("_hash", "line").agg(first).drop("_hash")
    near = F.octet_length("line") >= min_bytes
    return distinct.withColumns({
        "id": F.monotonically_increasing_id(),
        "counts": F.when(near, letter_counts(F.col("line"))), "digits": F.when(near, digit_counts(F.col("line"))),
    })


def near_lines(lines: DataFrame, edits: int) -> DataFrame:
    """``a, b, edits``: all pairs of ``id`` whose ``line`` is within ``edits`` bytes;
    ``counts`` and ``digits`` are the line's :func:`letter_counts` and
    :func:`digit_counts`.

    A line is cut into ``edits + 1`` segments, so a near line holds one of them
    unchanged; keys of segments meet keys of the few substrings of lines of
    the same or slightly larger length. Variants of one long line meet in great
    numbers; the join's condition on letter and digit counts turns most of them
    away at once, and what is left is verified.

    A segment of more than CROWD lines, as a template has that is filled with
    dates or numbers, is not met alone: an edit of the line is one of its digits
    at most, so near lines share a segment of the string of their digits too. All
    letters are counted there, as lines without digits still meet.
    """
    spark = lines.sparkSession
    own = [F.octet_length("line"), F.col("counts"), F.col("digits"), F.col("line")]
    index = lines.select(F.explode(index_keys(F.col("line"), edits)).alias("key"), F.col("id").alias("a"),
                         *[c.alias(x) for c, x in zip(own, ("n", "p", "pd", "la"))])
    keys = _probe_keys(F.col("line"), edits)
    probe = reduce(DataFrame.union, [
        lines.select(F.explode(F.array(*keys[i::PROBES])).alias("key"), F.col("id").alias("b"),
                     *[c.alias(x) for c, x in zip(own, ("m", "q", "qd", "lb"))]).where("key is not null")
        for i in range(PROBES)
    ])
    order = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    apart = counts_apart(F.col("p"), F.col("q")) + counts_apart(F.col("pd"), F.col("qd"), 10)

    def meet(index: DataFrame, probe: DataFrame, apart: Column = apart) -> DataFrame:
        both = index.drop("la").join(probe.drop("lb"), (index["key"] == probe["key"]) & order & (apart <= 2 * edits))
        return both.select("a", "b")

    crowded = materialise(index.groupBy("key").count().where(F.col("count") > CROWD).select("key"), "crowded")
    if crowded.isEmpty():
        met = meet(index, probe)
    else:
        met = meet(index.join(crowded, "key", "left_anti"), probe.join(crowded, "key", "left_anti"))
        second = lambda keys: F.explode(F.transform(keys, lambda x: F.when(x.isNotNull(), F.xxhash64("key", x))))
        digits = lambda line: F.regexp_replace(F.col(line).cast("string"), "[^0-9]", "").cast("binary")
        left, right = index.join(crowded, "key", "left_semi"), probe.join(crowded, "key", "left_semi")
        others = lambda line: _packed_counts(F.col(line).cast("string"), OTHER_LETTERS)
        left, right = left.withColumn("po", others("la")), right.withColumn("qo", others("lb"))
        all_apart = apart + counts_apart(F.col("po"), F.col("qo"), len(OTHER_LETTERS))
        left = left.select(second(index_keys(digits("la"), edits)).alias("key2"), *left.columns).drop("key").withColumnRenamed("key2", "key")
        right = right.select(second(probe_keys(digits("lb"), edits, edits)).alias("key2"), *right.columns)
        met = met.union(meet(left, right.drop("key").withColumnRenamed("key2", "key").where("key is not null"), all_apart))
    pairs = materialise(met.select("a", "b").distinct(), "pairs")
    wanted = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    texts = materialise(lines.join(wanted, "id", "left_semi").select("id", "line"), "texts")
    left, right = texts.toDF("a", "line_a"), texts.toDF("b", "line_b")
    checked = pairs.join(left, "a").join(right, "b").hint("rebalance", "a", "b")
    distance = edit_distance(F.col("line_a"), F.col("line_b"), edits)
    return checked.select("a", "b", distance.alias("edits")).where("edits is not null")


def mark_repeats(
    df: DataFrame,
    edits: int = 2,
    min_bytes: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    equal_bytes: int | None = None,
) -> DataFrame:
    """``doc, h, kept``: for each document (id and hash of its text) the sorted
    numbers of the lines that stay, among those of at least ``min_bytes``.
    With ``equal_bytes`` shorter lines of that many bytes that are not blank are
    among them too; those go for an equal line only.

    A line goes if an equal line, or one within ``edits`` bytes, stands at an
    earlier place, in order of id and line number; documents without an id come
    first. Shorter lines than these always stay. A null text has no lines; documents that
    are equal in id and text share their places, so the lines of one stay or go
    with those of the other.
    """
    lines = materialise(_distinct_lines(df, id_col, text_col, min_bytes, equal_bytes), "lines")
    links = near_lines(lines.where("counts is not null"), edits)
    place = lines.select("id", "first")
    both = links.join(place.toDF("a", "first_a"), "a").join(place.toDF("b", "first_b"), "b")
    # Of a pair the later one goes.
    later = both.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("id"))
    stay = place.join(materialise(later.distinct(), "later"), "id", "left_anti")
    return stay.groupBy(F.col("first.doc").alias("doc"), F.col("first.h").alias("h")).agg(
        F.sort_array(F.collect_set("first.number")).alias("kept")
    )


def _with_marks(df: DataFrame, marks: DataFrame, id_col: str, hash_col: Column) -> DataFrame:
    marks = marks.toDF("_doc", "_h", *["_" + name for name in marks.columns[2:]])
    return df.join(marks, F.col(id_col).eqNullSafe(F.col("_doc")) & (hash_col == F.col("_h")), "left").drop("_doc", "_h")


def repeated_lines(
    df: DataFrame, edits: int = 2, min_bytes: int = 24, id_col: str = "doc_id", text_col: str = "text",
    equal_bytes: int | None = None,
) -> DataFrame:
    """``id_col, n_lines, removed``: the numbers (from 0) of the lines that go, by
    the rule of :func:`mark_repeats`, for every row of ``df``. No text is moved
    for it. A null text has 0 lines; an empty table gives an empty one."""
    lines = F.split(text_col, "\n")
    long_ones = F.filter(
        F.transform(lines, lambda x, i: F.when(_counts(x, min_bytes, equal_bytes), i)), lambda i: i.isNotNull()
    )
    own = df.select(
        F.col(id_col), F.xxhash64(text_col).alias("_own"),
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(long_ones, F.array().cast("array<int>")).alias("_long"),
    ).withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    kept = F.coalesce("_kept", F.array().cast("array<int>"))
    marked = _with_marks(own, mark_repeats(df, edits, min_bytes, id_col, text_col, equal_bytes), id_col, F.col("_own"))
    return marked.select(id_col, "n_lines", F.array_except("_long", kept).alias("removed"))


def earlier_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, h``: ids and hashes of the texts that a document with a smaller id
    holds byte for byte. Texts that a row without an id holds too are left out."""
    texts = df.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("h"), F.sha2(text_col, 256).alias("sha")
    )
    first = texts.groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count_if(F.isnull("doc")).alias("n"))
    # Written, so that a text with many copies can be dealt out in the join.
    first = materialise(first.where("n = 0 and first < last").select("sha", "first"), "firsts")
    return texts.join(first, "sha").where("doc > first").select("doc", "h").distinct()


def drop_repeats(
    df: DataFrame,
    edits: int = 2,
    min_bytes: int = 24,
    max_share: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    copies: DataFrame | None = None,
    equal_bytes: int | None = None,
) -> DataFrame:
    """``df`` with the repeated lines taken out of ``text_col``; other columns and
    the number of rows stay. ``equal_bytes`` as for :func:`mark_repeats`.

    Where lines that go hold more than ``max_share`` of a text's bytes, the text
    stays whole, for document dedup to judge; where ``copies`` is given, the
    result of :func:`earlier_copies`, only if it is one of these.
    """
    names = df.columns
    marks = mark_repeats(df, edits, min_bytes, id_col, text_col, equal_bytes).withColumn("whole", F.lit(copies is None))
    if copies is not None:
        # No line of a copy stays, so none of them has a row yet.
        nothing = F.lit(None).cast(marks.schema["kept"].dataType)
        marks = marks.union(copies.select("doc", "h", nothing, F.lit(True)))
    marked = _with_marks(df.withColumn("_own", F.xxhash64(text_col)), marks, id_col, F.col("_own"))
    kept = F.coalesce("_kept", F.array().cast("array<int>"))
    # Sorted numbers as one flag for each line: gaps of false, each ended by a true.
    gaps = F.zip_with(kept, F.concat(F.array(F.lit(-1)), kept), lambda n, before: n - before - 1)
    flags = F.flatten(F.transform(
        F.filter(gaps, lambda g: g.isNotNull()),
        lambda g: F.concat(F.array_repeat(F.lit(False), g), F.array(F.lit(True))),
    ))
    marked = marked.withColumn("_flags", flags).withColumn("_lines", F.split(text_col, "\n"))
    left = F.filter("_lines", lambda x, i: ~_counts(x, min_bytes, equal_bytes) | F.coalesce(F.get("_flags", i), F.lit(False)))
    text = F.array_join(left, "\n")
    lost = F.octet_length(text_col) - F.octet_length("_text")
    marked = marked.withColumn("_text", text)
    whole = F.coalesce("_whole", F.lit(copies is None)) & (lost > max_share * F.octet_length(text_col))
    return marked.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(F.col("_text"))).select(*names)
