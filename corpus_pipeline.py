"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents``
(doc_id, text, lang, source, n_chars) and returns them again, the last one the
pieces of packed sequences. Nulls, empty texts, repeated rows and empty tables
are handled as the operator of the stage says; further columns are carried.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import language_id, line_dedup, packing, simhash, suffix_dedup
from quarry.session import WRITTEN, materialise, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A text that needs more bits for a byte in its best language matches none.
MAX_BITS = 8.0


#: Tables that the last stage wrote on its way.
_used: list[str] = []
#: The texts that line dedup found to be copies of an earlier document, and
#: where they are written: the stage after it reads them.
_copies: list[tuple[DataFrame, str]] = []


def _stage(function: Stage) -> Stage:
    """A stage's result is written before the next stage begins, so the tables
    that the stage before wrote on its way are deleted first."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _used)
        first = len(WRITTEN)
        out = function(spark, docs, sf_dir)
        _used[:] = WRITTEN[first:]
        return out

    return run_stage


def _recounted(df: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in df.columns else df


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and texts of which
    no language's automaton matches two bytes at a time on average. Learns from
    the labelled rows that op2 learns from; without any, no text is rejected
    for its language. Rows keep their own ``lang``."""
    known = docs.where(~language_id.held_out(F.col("doc_id")))
    found = language_id.identify(docs, language_id.learn(known))
    fits = F.coalesce(F.col("bits") <= MAX_BITS, F.lit(False))
    labelled = F.lit(bool(known.where("lang is not null").take(1)))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.where(F.when(labelled, fits).otherwise(letters)).select(*docs.columns)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that stand at an earlier place, whatever their share of the
    text: equal ones unless they are blank, within two edits from 24 bytes. Only texts of which more than half would
    go and that equal the text of an earlier document stay as they are for the
    next stage, which takes them. No row goes."""
    copies = materialise(line_dedup.earlier_copies(docs), "copies")
    _copies[:] = [(copies, WRITTEN.pop())]
    return _recounted(
        line_dedup.drop_repeats(docs, edits=2, min_bytes=24, max_share=0.5, copies=copies, equal_bytes=1)
    )


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of linked fingerprints, the document with the smallest
    id. Of repeated rows of that id all stay; rows without an id stay unless
    their group has one that has an id. Texts that line dedup left whole as
    copies go, as the document that they repeat may have lost lines and be far
    from them now; a run that begins at this stage knows of none."""
    found = simhash.near_duplicates(docs, width=3, radius=2)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    keep = keep.withColumnRenamed("doc_id", "_keep")
    docs = docs.join(keep, docs["doc_id"].eqNullSafe(keep["_keep"]), "left_semi")
    while _copies:
        copies, path = _copies.pop()
        WRITTEN.append(path)
        copies = copies.toDF("_doc", "_h")
        same = (docs["doc_id"] == copies["_doc"]) & (F.xxhash64(docs["text"]) == copies["_h"])
        docs = docs.join(copies, same, "left_anti")
    return docs


@_stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every byte in a string of 50 bytes that also starts in a document
    with a smaller id; characters that a cut splits go as well. A null text
    becomes an empty one. No row goes."""
    found = suffix_dedup.remove_repeats(docs, window=50, carry=True)
    text = F.when(F.col("n_removed") == 0, F.coalesce("text", F.lit(""))).otherwise(
        # try_validate_utf8 would drop the text; the marks of bad bytes go instead.
        F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("�"), F.lit(""))
    )
    return _recounted(found.withColumn("text", text).select(*docs.columns))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of the token ids into sequences of 2048."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.best_fit(pieces)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", passages),
    ("best_fit_packing", pack),
]

#: Fingerprints and token ids are not SQL: the tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
