"""Word, byte-pair and threshold vocabularies for every scope in one job.

A vocabulary is a table ``(scope, kind, token, id, count)``; a scope is a
language, a repository's language, or ``query``. Ids are unique per scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry import constants as C
from quarry.operators.ranking import top_k
from quarry.session import materialise

VOCABULARY_COLUMNS = ["scope", "kind", "token", "id", "count"]


def token_counts(df: DataFrame, tokens: str = "tokens", scope: str = "scope") -> DataFrame:
    """How often each token occurs per scope (combined before the shuffle).

    The outer form of explode keeps the optimizer from testing the list's
    size first, which would compute a derived list twice.
    """
    return (
        df.select(F.col(scope).alias("scope"), F.explode_outer(tokens).alias("token"))
        .filter(F.col("token").isNotNull())
        .groupBy("scope", "token")
        .agg(F.count("*").alias("count"))
    )


def ngram_counts(
    counts: DataFrame, shortest: int = C.NGRAM_MIN, longest: int = C.NGRAM_MAX
) -> DataFrame:
    """Character n-grams of the given words, weighted by word count.

    Single characters always count. Works on distinct words, so its input is
    already reduced; n-grams that hold white space are left out.
    """
    starts = counts.filter(F.length("token") > 0).select(
        "scope",
        "token",
        "count",
        # Few words hold white space; only their n-grams are looked at for it.
        F.col("token").rlike(r"\s").alias("blank"),
        F.explode(F.sequence(F.lit(1), F.length("token"))).alias("start"),
    )
    room = F.least(F.lit(longest), F.length("token") - F.col("start") + 1)
    spans = starts.select(
        "scope", "token", "count", "start", "blank", F.explode(F.sequence(F.lit(1), room)).alias("size")
    ).filter((F.col("size") == 1) | (F.col("size") >= shortest))
    return (
        spans.select(
            "scope",
            F.substr("token", F.col("start"), F.col("size")).alias("ngram"),
            "count",
            "blank",
        )
        .filter(~F.col("blank") | ~F.col("ngram").rlike(r"\s"))
        .groupBy("scope", "ngram")
        .agg(F.sum("count").alias("count"))
    )


def most_common(counts: DataFrame, token: str, n: int) -> DataFrame:
    """The ``n`` most frequent tokens per scope with their 1-based rank."""
    return top_k(counts, ["scope"], [F.col("count").desc(), F.col(token)], n, [token])


def _constant_rows(counts: DataFrame, entries: list[tuple[str, str, int, int]]) -> DataFrame:
    """The same (kind, token, id, count) rows for every scope."""
    rows = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(token).alias("token"),
                F.lit(id_).alias("id"),
                F.lit(count).cast("long").alias("count"),
            )
            for kind, token, id_, count in entries
        ]
    )
    scopes = counts.select("scope").distinct()
    return scopes.select("scope", F.inline(rows)).select(VOCABULARY_COLUMNS)


def word_share(size: int, bpe_share: float, n_required: int = 2) -> int:
    return max(int(size * (1 - bpe_share)), n_required)


def word_vocabulary(
    counts: DataFrame, size: int, bpe_share: float, required: list[str] | None = None
) -> DataFrame:
    """Padding is 0, unknown is 1, then other required and frequent words."""
    others = sorted(set(required or []) - {C.PAD, C.UNK})
    reserved = [C.PAD, C.UNK, *others]
    limit = word_share(size, bpe_share, len(reserved))
    fixed = [("word", C.PAD, 0, 2**32)]
    fixed += [("word", token, i, 2**31) for i, token in enumerate(reserved) if i > 0]
    learnt = counts.filter(~F.col("token").isin(reserved))
    frequent = most_common(learnt, "token", limit - len(reserved))
    return _constant_rows(counts, fixed).unionByName(
        frequent.select(
            "scope",
            F.lit("word").alias("kind"),
            "token",
            (F.col("rank") + (len(reserved) - 1)).alias("id"),
            "count",
        )
    )


def out_of_vocabulary(counts: DataFrame, words: DataFrame) -> DataFrame:
    """Counted words that are not in the word vocabulary."""
    known = words.filter(F.col("kind") == "word").select("scope", "token")
    return counts.join(known, ["scope", "token"], "left_anti")


def bpe_vocabulary(
    oov_counts: DataFrame, scopes: DataFrame, size: int, bpe_share: float, n_required: int = 2
) -> DataFrame:
    """Word start and end marks, then the most frequent n-grams.

    Ids begin at the configured word share even when fewer words exist.
    """
    first = word_share(size, bpe_share, n_required)
    room = size - first
    marks = [("bpe", C.SOW, first, 2**63 - 1), ("bpe", C.EOW, first + 1, 2**63 - 1)][:room]
    grams = ngram_counts(oov_counts).filter(~F.col("ngram").isin(C.SOW, C.EOW))
    frequent = most_common(grams, "ngram", max(room - 2, 0))
    return _constant_rows(scopes, marks).unionByName(
        frequent.select(
            "scope",
            F.lit("bpe").alias("kind"),
            F.col("ngram").alias("token"),
            (F.col("rank") + (first + 1)).alias("id"),
            "count",
        )
    )


def fit_vocabulary(
    counts: DataFrame,
    size: int = C.VOCABULARY_SIZE,
    bpe_share: float = C.BPE_SHARE,
    required: list[str] | None = None,
) -> DataFrame:
    """Word and byte-pair vocabulary of every scope in ``counts``.

    ``counts`` and the bounded word table are read more than once, so both
    are written first.
    """
    if size < 1:
        raise ValueError("vocabulary size must be positive")
    counts = materialise(counts, "token-counts")
    words = materialise(word_vocabulary(counts, size, bpe_share, required), "words")
    n_required = len({C.PAD, C.UNK, *(required or [])})
    bpe = bpe_vocabulary(
        out_of_vocabulary(counts, words), words, size, bpe_share, n_required
    )
    return materialise(words.unionByName(bpe), "vocabulary")


def threshold_vocabulary(
    counts: DataFrame,
    size: int = C.VOCABULARY_SIZE,
    threshold: int = C.TOKEN_COUNT_THRESHOLD,
    ignored: list[str] | None = None,
) -> DataFrame:
    """The plain vocabulary: frequent tokens that reach a minimum count."""
    reserved = [C.MASK_TOKEN, C.UNKNOWN_TOKEN, *(ignored or [])]
    frequent = most_common(
        counts.filter((F.col("count") >= threshold) & ~F.col("token").isin(reserved)),
        "token",
        size,
    )
    fixed = [("simple", C.MASK_TOKEN, 0, 0), ("simple", C.UNKNOWN_TOKEN, 1, 0)]
    return _constant_rows(counts, fixed).unionByName(
        frequent.select(
            "scope",
            F.lit("simple").alias("kind"),
            "token",
            (F.col("rank") + 1).alias("id"),
            "count",
        )
    )


def additional_tokens(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Entries of ``extra`` whose (scope, kind, token) is not in ``base``."""
    return extra.join(base.select("scope", "kind", "token"), ["scope", "kind", "token"], "left_anti")


def merge_vocabularies(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Append new entries to a base vocabulary and renumber without gaps.

    Per scope: base words in id order, new words, base pieces in id order,
    new pieces. A scope holds at most two configured vocabulary sizes, which
    bounds the window's group.
    """
    old = base.select(*VOCABULARY_COLUMNS, F.col("id").alias("base_id"), F.lit(0).alias("_origin"))
    new = additional_tokens(base, extra).select(
        *VOCABULARY_COLUMNS, F.lit(None).cast("int").alias("base_id"), F.lit(1).alias("_origin")
    )
    place = Window.partitionBy("scope").orderBy(
        F.when(F.col("kind") == "word", 0).otherwise(1), "_origin", "base_id", "token"
    )
    return (
        old.unionByName(new)
        .withColumn("id", F.row_number().over(place) - 1)
        .select(*VOCABULARY_COLUMNS, "base_id")
    )


def lookup_table(vocabulary: DataFrame) -> DataFrame:
    """One id per (scope, token): a word, also of a plain vocabulary, wins over an
    equal piece."""
    word = F.col("kind").isin("word", "simple")
    is_word = F.max(word).alias("is_word")
    first_id = F.min_by("id", F.when(word, 0).otherwise(1)).alias("id")
    return vocabulary.groupBy("scope", "token").agg(first_id, is_word)
