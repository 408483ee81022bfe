"""Greedy byte-pair tokenisation, encoding to fixed-length ids, decoding."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry import constants as C
from quarry.functions.vectors import has_real_id
from quarry.operators.scopes import fields, take_columns, with_parameters
from quarry.session import materialise

#: Token lists that meet one copy of their scope's vocabulary.
GROUP_ROWS = 2048


def piece_patterns(vocabulary: DataFrame) -> DataFrame:
    """One regular expression per scope that takes the longest known piece.

    Pieces are grouped by first character and listed longest first, so a
    match at any position is the longest one; a character no piece starts
    with matches outside the capture group. The size of a pattern is bounded
    by the configured vocabulary size.
    """
    escaped = F.regexp_replace(F.substr("token", F.lit(2)), r"([^\p{L}\p{N}])", r"\\$1")
    first = F.substring("token", 1, 1)
    pieces = vocabulary.filter(
        (F.col("kind") == "bpe") & F.length("token").between(1, C.NGRAM_MAX)
    ).select("scope", first.alias("first"), F.length("token").alias("size"), escaped.alias("rest"))
    tails = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "rest")))
    branches = pieces.groupBy("scope", "first").agg(tails.alias("tails"))
    branch = F.concat(
        F.regexp_replace("first", r"([^\p{L}\p{N}])", r"\\$1"),
        F.lit("(?:"),
        F.array_join(F.transform("tails", lambda tail: tail["rest"]), "|"),
        F.lit(")"),
    )
    return (
        branches.select("scope", branch.alias("branch"))
        .groupBy("scope")
        .agg(F.array_join(F.array_sort(F.collect_list("branch")), "|").alias("alternatives"))
        .select(
            "scope",
            F.concat(F.lit("("), "alternatives", F.lit(r")|[\s\S]")).alias("pattern"),
        )
    )


def _pieces(word: Column, pattern: Column) -> Column:
    """Pieces of an unknown word; an empty text stands for an unknown one."""
    return F.concat(
        F.array(F.lit(C.SOW)),
        F.regexp_extract_all(word, pattern, F.lit(1)),
        F.array(F.lit(C.EOW)),
    )


def subword_tokenise(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``pieces`` of each (scope, token): start mark, longest pieces, end mark.

    Rows are ordered by scope inside each task so that a compiled pattern
    serves a whole run of rows.
    """
    patterns = materialise(piece_patterns(vocabulary), "patterns")
    named = F.transform(
        _pieces(F.col("token"), F.col("pattern")),
        lambda piece: F.when(piece == "", C.UNK).otherwise(piece),
    )
    return (
        words.sortWithinPartitions("scope")
        .join(patterns, "scope")
        .withColumn("pieces", named)
        .drop("pattern")
    )


class _Scope:
    """A scope's vocabulary: words, pieces, and ids by token, of which a word wins
    over an equal piece."""

    def __init__(self, table: pa.Table):
        kinds, tokens, ids = (table.column(c).to_pylist() for c in ("kind", "token", "id"))
        rows = list(zip(kinds, tokens, ids))
        self.ids = {t: i for k, t, i in rows if k == "bpe"} | {t: i for k, t, i in rows if k != "bpe"}
        self.words = {t for k, t, _ in rows if k != "bpe"}
        self.pieces = {t for k, t, _ in rows if k == "bpe" and 1 <= len(t) <= C.NGRAM_MAX}
        self.plain = "simple" in kinds

    def cut(self, word: str) -> list[str]:
        """A known word is itself, an unknown one the longest known pieces from the
        left between marks or, in a plain vocabulary, the unknown token."""
        if word in self.words:
            return [word]
        if self.plain:
            return [C.UNKNOWN_TOKEN]
        out, at, end, pieces = [C.SOW], 0, len(word), self.pieces
        while at < end:
            for size in range(min(C.NGRAM_MAX, end - at), 0, -1):
                if word[at : at + size] in pieces:
                    out.append(word[at : at + size])
                    at += size
                    break
            else:
                out.append(C.UNK)
                at += 1
        return [*out, C.EOW]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _encoded_lists(column: pa.ChunkedArray, scope: _Scope, most: int | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For all lists of a group: numbers of their pieces one after the other, how many
    each list has, and the distinct pieces. Each distinct word is cut once."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    coded = lists.flatten().dictionary_encode()
    numbers: dict[str, int] = {}
    flat, counts = [], []
    for word in coded.dictionary.to_pylist():
        own = scope.cut(word)[:most]
        flat += [numbers.setdefault(piece, len(numbers)) for piece in own]
        counts.append(len(own))
    counts = np.array(counts, np.int64)
    index = coded.indices.to_numpy()
    each = counts[index]
    pieces = np.array(flat, np.int64)[_ragged((np.cumsum(counts) - counts)[index], each)]
    total = np.concatenate([[0], np.cumsum(each)])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    return pieces, np.diff(total[edge]), list(numbers)


def _in_scopes(
    df: DataFrame, keys: list[str], vocabulary: DataFrame, limit: int | None, finish: Callable, schema: str
) -> DataFrame:
    """Token lists with the vocabulary of their scope. The lists are written first and
    move once, cut to ``limit`` tokens: each yields at least one id, so others can
    never reach the first ``limit`` ids. Null tokens do not count."""
    tokens = F.filter("tokens", lambda token: token.isNotNull())
    tokens = tokens if limit is None else F.slice(tokens, 1, limit)
    rows = materialise(df.select(*keys, "scope", tokens.alias("tokens")), "token-lists")

    def run(scope: str, group: pa.Table, own: pa.Table) -> pa.Table:
        if not len(own):
            raise ValueError(f"no vocabulary for scope {scope}")
        known = _Scope(own)
        pieces, sizes, names = _encoded_lists(group.column("tokens"), known, limit)
        column = finish(known, pieces, sizes, names)
        return pa.table([*take_columns(group, [*keys, "scope"]), column], [*keys, "scope", "_out"])

    whole = f"{fields(rows, [*keys, 'scope'])}, _out {schema}"
    return with_parameters(rows, keys, vocabulary.select("scope", "kind", "token", "id"), run, whole, GROUP_ROWS)


def tokenise(df: DataFrame, keys: list[str], vocabulary: DataFrame) -> DataFrame:
    """``pieces`` of whole token lists: known words stay, others are split."""

    def finish(known: _Scope, pieces: np.ndarray, sizes: np.ndarray, names: list[str]) -> pa.Array:
        words = pa.DictionaryArray.from_arrays(pa.array(pieces), pa.array(names, pa.string())).cast(pa.string())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), words)

    return _in_scopes(df, keys, vocabulary, None, finish, "array<string>").withColumnRenamed("_out", "pieces")


def encode(
    df: DataFrame,
    keys: list[str],
    vocabulary: DataFrame,
    length: int,
    reverse: bool = False,
    name: str = "ids",
) -> DataFrame:
    """Token lists to exactly ``length`` ids: cut, then padded with 0.

    ``df`` has ``keys``, ``scope`` and ``tokens``. No document and no token is
    left out: unknown ones get marks and unknown ids. A null list has no tokens;
    a scope without a vocabulary is an error.
    """

    def finish(known: _Scope, pieces: np.ndarray, sizes: np.ndarray, names: list[str]) -> pa.Array:
        ids = np.array([known.ids.get(piece, 1) for piece in names], np.int32)
        taken = np.minimum(sizes, length)
        out = np.zeros((len(sizes), length), np.int32)
        row = np.repeat(np.arange(len(sizes)), taken)
        place = _ragged(np.zeros(len(sizes), np.int64), taken)
        out[row, place] = ids[pieces[_ragged(np.cumsum(sizes) - sizes, taken)]] if len(row) else 0
        out = out[:, ::-1] if reverse else out
        offsets = np.arange(len(out) + 1, dtype=np.int32) * length
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(out).reshape(-1)))

    return _in_scopes(df, keys, vocabulary, length, finish, "array<int>").withColumnRenamed("_out", name)


def decode(
    df: DataFrame, keys: list[str], vocabulary: DataFrame, ids: str = "ids", strict: bool = True
) -> DataFrame:
    """Ids back to text; pieces are glued between a start and an end mark.

    A word cut off before its end mark is dropped. ``strict`` fails on
    unbalanced marks and on a loose piece; an unknown id always fails.
    Sequences without ids have no text. Those of equal keys and scope are one,
    their ids in order of place, then id.
    """
    scope = F.coalesce("scope", F.raise_error(F.lit("a sequence without a scope")).cast("string"))
    lists = df.select(*keys, scope.alias("scope"), F.col(ids).alias("_ids")).where(F.size("_ids") > 0)
    grouped = lists.groupBy(*keys, "scope").agg(F.collect_list("_ids").alias("_all"))
    single = F.size("_all") == 1
    placed = F.transform(
        "_all", lambda one: F.transform(one, lambda id_, position: F.struct(position.alias("position"), id_.alias("id")))
    )
    merged = F.transform(F.array_sort(F.flatten(placed)), lambda item: item["id"])
    rows = materialise(
        grouped.select(*keys, "scope", F.when(single, F.element_at("_all", 1)).otherwise(merged).alias("_ids")),
        "id-lists",
    )
    entries = vocabulary.select("scope", "kind", "token", "id")

    def run(scope: str, group: pa.Table, own: pa.Table) -> pa.Table:
        known = _inverse(own)
        texts = [_text(one, known, strict) for one in group.column("_ids").to_pylist()]
        return pa.table([*take_columns(group, [*keys, "scope"]), pa.array(texts, pa.string())], [*keys, "scope", "text"])

    return with_parameters(rows, keys, entries, run, f"{fields(rows, [*keys, 'scope'])}, text string", GROUP_ROWS)


def _inverse(own: pa.Table) -> dict[int, tuple[str | None, str | None]]:
    """Word and piece of each id of a scope, the smallest of several."""
    known: dict[int, list] = {}
    for kind, token, id_ in zip(*(own.column(c).to_pylist() for c in ("kind", "token", "id"))):
        place = {"word": 0, "bpe": 1}.get(kind)
        if place is not None and token is not None:
            pair = known.setdefault(id_, [None, None])
            # Code points and UTF-8 bytes have one order.
            pair[place] = token if pair[place] is None else min(pair[place], token)
    return {id_: tuple(pair) for id_, pair in known.items()}


def _text(ids: list[int | None], known: dict, strict: bool) -> str:
    """One sequence's text; null ids stand for nothing."""
    words, current, inside = [], "", False
    for id_ in ids:
        if id_ is None:
            continue
        if id_ not in known:
            raise ValueError(f"id outside the vocabulary: {id_}")
        word, bpe = known[id_]
        if bpe == C.SOW:
            if strict and inside:
                raise ValueError("second word start before a word end")
            inside = True
        elif bpe == C.EOW:
            if strict and not inside:
                raise ValueError("word end without a word start")
            words.append(current)
            current, inside = "", False
        elif inside:
            current += word if bpe is None else bpe
        elif strict and word is None:
            raise ValueError("piece outside a word")
        else:
            words.append(bpe if word is None else word)
    return " ".join(word for word in words if word)


def valid_pair(code_ids: Column, query_ids: Column) -> Column:
    """Both sequences hold at least one id that is not padding."""
    return has_real_id(code_ids) & has_real_id(query_ids)


def valid_sequences(df: DataFrame, code_ids: str = "code_ids", query_ids: str = "query_ids") -> DataFrame:
    return df.filter(valid_pair(F.col(code_ids), F.col(query_ids)))
