"""Vocabulary rules on small counts."""

from pyspark.sql import functions as F

from quarry.operators import vocabulary as K


def counts(spark, rows, scope="s"):
    return spark.createDataFrame(
        [(scope, token, n) for token, n in rows], "scope string, token string, count long"
    )


def ids(df, kind=None):
    return {r.token: r.id for r in df.collect() if kind in (None, r.kind)}


def test_small_vocabulary(spark):
    fitted = K.fit_vocabulary(counts(spark, [("a", 5), ("b", 4), ("c", 4), ("dd", 2)]), 6, 0.5)
    assert ids(fitted, "word") == {"__pad": 0, "__unk": 1, "a": 2}
    assert ids(fitted, "bpe") == {"__sow": 3, "__eow": 4, "b": 5}


def test_piece_ids_start_at_the_configured_share(spark):
    fitted = K.fit_vocabulary(counts(spark, [("a", 1)]), 20, 0.5)
    assert ids(fitted, "bpe") == {"__sow": 10, "__eow": 11}


def test_required_tokens_come_first(spark):
    words = K.word_vocabulary(counts(spark, [("a", 9), ("z", 1)]), 8, 0.5, required=["z"])
    assert ids(words) == {"__pad": 0, "__unk": 1, "z": 2, "a": 3}


def test_scopes_are_learnt_side_by_side(spark):
    both = counts(spark, [("a", 2)], "x").unionByName(counts(spark, [("b", 2)], "y"))
    fitted = K.fit_vocabulary(both, 8, 0.5)
    assert {(r.scope, r.token) for r in fitted.filter("id = 2").collect()} == {("x", "a"), ("y", "b")}


def test_ngrams_are_weighted_and_whole(spark):
    grams = {r.ngram: r["count"] for r in K.ngram_counts(counts(spark, [("aba", 3), ("a b", 1)])).collect()}
    assert grams == {"a": 7, "b": 4, "ab": 3, "ba": 3, "aba": 3}


def test_ngrams_stop_at_eight(spark):
    grams = [r.ngram for r in K.ngram_counts(counts(spark, [("abcdefghij", 1)])).collect()]
    assert max(map(len, grams)) == 8 and "abcdefgh" in grams


def test_threshold_vocabulary(spark):
    fitted = K.threshold_vocabulary(counts(spark, [("a", 12), ("b", 10), ("c", 9)]), 10, 10)
    assert ids(fitted) == {"%MASK%": 0, "%UNK%": 1, "a": 2, "b": 3}


def test_merge_keeps_base_order_and_closes_gaps(spark):
    base = K.fit_vocabulary(counts(spark, [("m", 9), ("q", 1)]), 20, 0.5)
    extra = K.fit_vocabulary(counts(spark, [("b", 9), ("m", 3), ("zz", 1)]), 8, 0.5)
    merged = K.merge_vocabularies(base, extra).collect()
    by_id = [r.token for r in sorted(merged, key=lambda r: r.id)]
    assert [r.id for r in sorted(merged, key=lambda r: r.id)] == list(range(len(merged)))
    words = [t for t in by_id if (t, "word") in {(r.token, r.kind) for r in merged}]
    assert words == ["__pad", "__unk", "m", "q", "b"]
    assert by_id[5:7] == ["__sow", "__eow"]
    assert {r.token for r in merged if r.base_id is None} == {"b", "z", "zz"}


def test_hot_token_counts_once(spark):
    tokens = F.when(F.col("id") % 3 == 0, F.array(F.lit("hot"))).otherwise(
        F.array(F.col("id").cast("string"), F.lit(""))
    )
    df = spark.range(3000).select(F.lit("s").alias("scope"), tokens.alias("tokens"))
    found = {r.token: r["count"] for r in K.token_counts(df).filter("count > 1").collect()}
    assert found == {"hot": 1000, "": 2000}
