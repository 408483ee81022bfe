"""Worked cases of the text expressions."""

import re

import pytest
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions import text as T, vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def words(*items):
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


@pytest.mark.parametrize(
    "text, expected",
    [
        ('Sort list(x), then "return" it.', ["Sort", "list", "(", "x", ")", "then", "return", "it", "."]),
        ("foo() == []", ["foo", "()", "==", "[]"]),
        ("", []),
    ],
)
def test_docstring_tokens(spark, text, expected):
    assert value(spark, T.docstring_tokens(F.lit(text))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("Sum.\n\nMore @x", "Sum."), ("Do it @param x", "Do it "), ("plain", "plain")],
)
def test_docstring_summary(spark, text, expected):
    assert value(spark, T.docstring_summary(F.lit(text))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("/**\n * Adds.\n *\n * @return x\n */", "Adds.\n@return x"),
        ("// a\n// b", "a\nb"),
        ("/** */", ""),
        ("/* one */", "one"),
    ],
)
def test_strip_comment_delimiters(spark, text, expected):
    assert value(spark, T.strip_comment_delimiters(F.lit(text))) == expected


@pytest.mark.parametrize(
    "token, expected",
    [
        ("fooBarBaz", ["foo", "Bar", "Baz"]),
        ("get_user_ID", ["get", "user", "ID"]),
        ("HTTPServer2Go", ["HTTPServer2", "Go"]),
        ("'a.b'", ["'a.b'"]),
        ('r"x.y"', ['r"x.y"']),
        ("a..b", ["a", "b"]),
        ("1aB", ["1aB"]),
        ("", []),
    ],
)
def test_sub_tokens(spark, token, expected):
    assert value(spark, T.sub_tokens(F.lit(token))) == expected


def test_query_tokens_fall_back_on_a_long_identifier(spark):
    tokens = lambda name: value(spark, T.query_tokens(words(), F.lit(name)))
    assert tokens("readFileLines") == ["read", "File", "Lines"]
    assert tokens("readFile") == []
    assert value(spark, T.query_tokens(words("Read", " X "), F.lit("readFileLines"))) == ["read", "x"]
    lowered = T.query_tokens(words(), F.lit("readFileLines"), lower_fallback=True)
    assert value(spark, lowered) == ["read", "file", "lines"]


@pytest.mark.parametrize(
    "language, token, expected",
    [
        ("php", "#x", True), ("php", "//x", True), ("go", "#x", False), ("python", "//x", False),
        ("java", "/* x", True), ("ruby", "# x", True), ("python", "", False),
    ],
)
def test_comment_tokens(spark, language, token, expected):
    assert value(spark, T.is_comment_token(F.lit(language), F.lit(token))) is expected


def test_normalised_code_tokens_keep_empty_ones(spark):
    tokens = T.normalised_code_tokens(F.lit("python"), words("# c", "Foo ", " ", "  # x"))
    # The last token shows its comment only once stripped: a second pass drops it.
    assert value(spark, tokens) == ["foo", "", "# x"]
    assert value(spark, T.normalised_code_tokens(F.lit("python"), tokens)) == ["foo", ""]


def test_lexer_follows_the_language(spark):
    code = "a = 'x # y' # note\nb //= 2.5"
    lexed = lambda name: value(spark, T.code_tokens(F.lit(name), F.lit(code)))
    assert lexed("python") == ["a", "=", "'x # y'", "# note", "b", "/", "/", "=", "2.5"]
    assert lexed("java") == ["a", "=", "'x # y'", "#", "note", "b", "//= 2.5"]


def test_names_paths_and_labels(spark):
    assert value(spark, T.qualified_identifier(F.lit("A"), F.lit("b"))) == "A.b"
    assert value(spark, T.qualified_identifier(F.lit(None), F.lit("b"))) == "b"
    assert value(spark, T.basename(F.lit("a/b/c.py"))) == "c.py"
    assert value(spark, T.language_of_file(F.lit("a/b.js"))) == "javascript"
    assert value(spark, T.language_of_file(F.lit("a/b.txt"))) is None
    assert value(spark, T.relative_path(F.lit("/root//x/y.py"), F.lit("/root"))) == "x/y.py"
    assert value(spark, T.capitalised(F.lit("javaScript"))) == "JavaScript"
    assert value(spark, T.capitalised(F.lit(None).cast("string"))) == ""
    assert value(spark, T.document_label(F.lit("go"), F.lit(""), F.lit("x" * 40))) == "(go) " + "x" * 32
    assert value(spark, T.clean_quoted_docstring(F.lit(' """\'Hi\'""" '))) == "Hi"
    assert value(spark, T.join_line_comments(words(" # a ", "## b #"))) == " a\n b "


def test_language_filter(spark):
    query = F.lit("read file +language=Python,go")
    assert value(spark, T.filter_languages(query)) == ["python", "go"]
    assert value(spark, T.without_filter(query)) == "read file"
    assert value(spark, T.filter_languages(F.lit("read file"))) is None


def test_source_url(spark):
    url = T.source_url(F.lit("o"), F.lit("n"), F.lit("c"), F.lit("p/q.py"), F.lit(3), F.lit(9))
    assert value(spark, url).endswith("/o/n/blob/c/p/q.py#L3-L9")


def test_rating_and_similarity(spark):
    assert value(spark, V.match_rating(F.lit(0.5))) == 75.0
    a, b = F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert value(spark, V.cosine_distance(a, b)) == 1.0
    assert value(spark, V.cosine_distance(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert value(spark, V.cosine_similarity(a, a)) == pytest.approx(1.0)
    assert value(spark, V.real_ids(F.array(F.lit(5), F.lit(0)))) == [1, 0]


def test_the_language_is_looked_at_once_a_list(spark):
    """Without comments as a test of every token says, for null languages and tokens too."""
    tokens = ["#a", "//b", "/*c*/", "d", "", "/", None]
    rows = [(name, tokens) for name in ("php", "python", "java", "cobol", None)] + [("go", None), ("go", [])]
    df = spark.createDataFrame(rows, "language string, tokens array<string>")
    language = F.col("language")
    each = F.filter("tokens", lambda t: ~T.is_comment_token(language, t))
    assert df.where(~T.without_comments(language, F.col("tokens")).eqNullSafe(each)).count() == 0
    plan = df.select(T.without_comments(language, F.col("tokens")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "lambdafunction(" in plan and not re.search(r"lambdafunction\(.{0,12}language", plan)


def test_possessive_runs_match_the_same(spark):
    texts = [
        "x_1 = 'a\\'b' + \"c\\\"d\" # e\n1.5 1. é９ /* f * / g **/ // h", "'open \"q' \"open 'r", "/* open", "\"a\\", "''\"\"", "/**/ /***/ /*/",
    ]
    df = spark.createDataFrame([(name, x) for x in texts for name in ("php", "python", "java", "cobol")], "language string, code string")
    parts = {"php": [C.LEX_HASH_COMMENT, C.LEX_SLASH_COMMENT], "python": [C.LEX_HASH_COMMENT], "java": [C.LEX_SLASH_COMMENT], "cobol": []}
    whole = {k: "|".join([C.LEX_WORD, *v, C.LEX_STRING, C.LEX_NUMBER, C.LEX_SYMBOL]) for k, v in parts.items()}
    plain = F.create_map(*[F.lit(x) for pair in whole.items() for x in pair])[F.col("language")]
    assert "*+" in T.lex_pattern(F.lit("php"))._jc.toString()
    assert df.where(~T.code_tokens(F.col("language"), F.col("code")).eqNullSafe(F.regexp_extract_all("code", plain, F.lit(0)))).count() == 0
