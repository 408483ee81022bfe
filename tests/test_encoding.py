"""Byte-pair tokenisation against a plain greedy walk."""

import random

import pytest

from quarry.operators import encoding as K

ROWS = [("word", "__pad", 0), ("word", "__unk", 1), ("word", "if", 2), ("word", "ab", 3), ("word", "", 4)]
ROWS += [("bpe", "__sow", 10), ("bpe", "__eow", 11)]
ROWS += [("bpe", t, 12 + i) for i, t in enumerate(["ab", "abc", "c", "d", "a.b", "(", "é", "bcdefghi"])]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame(
        [("s", kind, token, id_, 1) for kind, token, id_ in ROWS],
        "scope string, kind string, token string, id int, count long",
    )


def greedy(word):
    known = {t for kind, t, _ in ROWS if kind == "bpe"}
    out, i = ["__sow"], 0
    while i < len(word):
        size = next((n for n in range(8, 0, -1) if word[i : i + n] in known and i + n <= len(word)), 0)
        out.append(word[i : i + size] if size else "__unk")
        i += size or 1
    return out + ["__eow"]


def lists(spark, *rows):
    return spark.createDataFrame(
        [(i, "s", list(r)) for i, r in enumerate(rows)], "k long, scope string, tokens array<string>"
    )


def test_worked_words(spark, vocabulary):
    words = spark.createDataFrame([("s", w) for w in ["abcd", "abx", ""]], "scope string, token string")
    found = {r.token: r.pieces for r in K.subword_tokenise(words, vocabulary).collect()}
    assert found == {
        "abcd": ["__sow", "abc", "d", "__eow"],
        "abx": ["__sow", "ab", "__unk", "__eow"],
        "": ["__sow", "__eow"],
    }


def test_random_words_follow_the_greedy_walk(spark, vocabulary):
    rng = random.Random(1)
    words = {"".join(rng.choices("abcdefghi.(é\n😀", k=rng.randint(1, 30))) for _ in range(300)}
    df = spark.createDataFrame([("s", w) for w in words], "scope string, token string")
    for row in K.subword_tokenise(df, vocabulary).collect():
        assert row.pieces == greedy(row.token)
    table = vocabulary.select("kind", "token", "id").toArrow()
    scope = K._Scope(table)
    assert all(scope.cut(w) == greedy(w) for w in words if w not in scope.words)


def test_encode_cuts_and_pads(spark, vocabulary):
    found = K.encode(lists(spark, ["if", "ab"], [], ["abcx"], ["if"] * 9, ["", "x"]), ["k"], vocabulary, 4)
    ids = {r.k: r.ids for r in found.collect()}
    # "abc" is a piece; "ab" inside a word takes the word's id.
    assert ids == {0: [2, 3, 0, 0], 1: [0, 0, 0, 0], 2: [10, 13, 1, 11], 3: [2, 2, 2, 2], 4: [4, 10, 1, 11]}


def test_a_piece_that_is_a_word_takes_the_word_id(spark, vocabulary):
    ids = K.encode(lists(spark, ["abd"]), ["k"], vocabulary, 5).first().ids
    assert ids == [10, 3, 15, 11, 0]


def test_reverse_after_padding(spark, vocabulary):
    assert K.encode(lists(spark, ["if"]), ["k"], vocabulary, 3, reverse=True).first().ids == [0, 0, 2]


def test_cut_equals_whole_encoding(spark, vocabulary):
    rng = random.Random(2)
    rows = [["".join(rng.choices("abcdx(", k=rng.randint(0, 6))) for _ in range(40)] for _ in range(20)]
    short = {r.k: r.ids for r in K.encode(lists(spark, *rows), ["k"], vocabulary, 15).collect()}
    whole = {r.k: r.ids for r in K.encode(lists(spark, *rows), ["k"], vocabulary, 500).collect()}
    assert all(whole[k][:15] == short[k] for k in short)


def ids_table(spark, *rows):
    return spark.createDataFrame(
        [(i, "s", list(r)) for i, r in enumerate(rows)], "k long, scope string, ids array<int>"
    )


def test_decode(spark, vocabulary):
    rows = ids_table(spark, [2, 10, 13, 15, 11, 3], [10, 13, 15], [10, 1, 11, 0])
    found = {r.k: r.text for r in K.decode(rows, ["k"], vocabulary).collect()}
    assert found == {0: "if abcd ab", 1: "", 2: "__unk __pad"}


def test_decode_does_not_move_each_id(spark, vocabulary):
    """Vocabularies meet whole lists; equal keys are one list, empty ones have no text."""
    rows = ids_table(spark, [2, 10, 13, 15, 11, 3], []).selectExpr("1 AS k", "scope", "ids")
    plan = K.decode(rows, ["k"], vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate posexplode" not in plan
    assert [r.text for r in K.decode(rows, ["k"], vocabulary).collect()] == ["if abcd ab"]
    twice = ids_table(spark, [2, 3], [3, 2]).selectExpr("1 AS k", "scope", "ids")
    assert [r.text for r in K.decode(twice, ["k"], vocabulary).collect()] == ["if ab if ab"]


@pytest.mark.parametrize("bad", [[10, 10], [11], [13], [99]])
def test_strict_decode_fails(spark, vocabulary, bad):
    with pytest.raises(Exception):
        K.decode(ids_table(spark, bad), ["k"], vocabulary).collect()


def test_lenient_decode(spark, vocabulary):
    found = K.decode(ids_table(spark, [13, 11, 2]), ["k"], vocabulary, strict=False).first().text
    assert found == "abc if"


def test_valid_sequences(spark):
    df = spark.createDataFrame(
        [(1, [0, 0], [1, 0]), (2, [1, 0], [1, 0]), (3, [1], [0])],
        "k int, code_ids array<int>, query_ids array<int>",
    )
    assert [r.k for r in K.valid_sequences(df).collect()] == [2]


def test_lists_and_vocabulary_move_once(spark, vocabulary):
    df = lists(spark, ["if"], ["abc"])
    plan = K.encode(df, ["k"], vocabulary, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Generate posexplode" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_null_tokens_and_lists_do_not_count(spark, vocabulary):
    df = spark.createDataFrame(
        [(1, "s", [None, None, "if", None, "ab"]), (2, "s", None), (3, "s", [None])], "k long, scope string, tokens array<string>"
    )
    assert {r.k: r.ids for r in K.encode(df, ["k"], vocabulary, 2).collect()} == {1: [2, 3], 2: [0, 0], 3: [0, 0]}
    assert {r.k: r.pieces for r in K.tokenise(df, ["k"], vocabulary).collect()} == {1: ["if", "ab"], 2: [], 3: []}


def test_scope_without_pieces_drops_nothing(spark):
    words = spark.createDataFrame(
        [("s", "word", t, i, 1) for i, t in enumerate(["__pad", "__unk", "a"])],
        "scope string, kind string, token string, id int, count long",
    )
    found = K.encode(lists(spark, ["a", "zz", "a"], ["zz"], []), ["k"], words, 6).collect()
    assert {r.k: r.ids for r in found} == {0: [2, 1, 1, 1, 1, 2], 1: [1, 1, 1, 1, 0, 0], 2: [0] * 6}


def test_threshold_vocabulary_encodes(spark):
    from quarry.operators.vocabulary import threshold_vocabulary, token_counts

    docs = lists(spark, ["a", "b", "a"], ["a", "c"])
    vocabulary = threshold_vocabulary(token_counts(docs), 10, 2)
    found = K.encode(docs, ["k"], vocabulary, 4).collect()
    assert {r.k: r.ids for r in found} == {0: [2, 1, 2, 0], 1: [2, 1, 0, 0]}


def test_unknown_scope_is_an_error(spark, vocabulary):
    docs = spark.createDataFrame([(1, "other", ["x"])], "k long, scope string, tokens array<string>")
    with pytest.raises(Exception, match="no vocabulary for scope other"):
        K.encode(docs, ["k"], vocabulary, 3).collect()


def test_valid_seqs_keeps_pairs_of_short_turns(spark, tmp_path):
    from quarry.suite.sequences import valid_seqs

    turns = []
    for conv, (query, code) in enumerate([("sort", "x = 1")] * 20 + [("a " * 40, "y"), ("sort", ""), (None, "x"), ("", "x")]):
        turns += [(conv, 0, "user", query), (conv, 1, "assistant", code)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    found = {r.row_id // 1000: r["mask"] for r in valid_seqs(spark, str(tmp_path)).collect()}
    # Left out are a turn without code tokens and one that is null.
    assert sorted(found) == [*range(21), 23]
    assert all("1" in mask and len(mask.split("|")) == 30 for mask in found.values())
