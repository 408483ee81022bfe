"""Token and text expressions on docstrings, code and paths."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from quarry import constants as C


def strip_blank(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(text, F.lit(C.BLANKS))


def docstring_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(C.DOCSTRING_TOKEN), F.lit(0))


def docstring_summary(docstring: Column) -> Column:
    """The part before the first empty line, else before the first ``@``."""
    return F.when(docstring.contains("\n\n"), F.substring_index(docstring, "\n\n", 1)).otherwise(
        F.substring_index(docstring, "@", 1)
    )


def strip_comment_delimiters(comment: Column) -> Column:
    """Remove C-style comment marks line by line and drop emptied lines.

    Emptiness is judged before the last trim, so a blank left between the
    marks still counts as one (empty) line.
    """

    def unmark(line: Column) -> Column:
        body = F.regexp_replace(strip_blank(line), r"\*/\z", "")
        return F.regexp_replace(body, C.COMMENT_OPENING, "")

    kept = F.filter(F.transform(F.split(comment, "\n"), unmark), lambda line: F.length(line) > 0)
    return F.array_join(F.transform(kept, strip_blank), "\n")


def join_line_comments(lines: Column) -> Column:
    """One docstring from ``#`` comment lines."""
    return F.array_join(
        F.transform(lines, lambda line: F.btrim(strip_blank(line), F.lit("#"))), "\n"
    )


def clean_quoted_docstring(literal: Column) -> Column:
    """A string literal's text: trim blanks, then double, then single quotes."""
    return F.btrim(F.btrim(strip_blank(literal), F.lit('"')), F.lit("'"))


def is_comment_token(language: Column, token: Column) -> Column:
    hashed = language.isin(C.HASH_COMMENT_LANGUAGES) & token.startswith("#")
    slashed = language.isin(C.SLASH_COMMENT_LANGUAGES) & (
        token.startswith("//") | token.startswith("/*")
    )
    return hashed | slashed


def without_comments(language: Column, tokens: Column) -> Column:
    """Tokens that are no comments of the language, which is looked at once a list.
    A null token is none of a known language's."""
    hashed = language.isin(C.HASH_COMMENT_LANGUAGES)
    slashed = language.isin(C.SLASH_COMMENT_LANGUAGES)

    def without(*marks: str) -> Column:
        return F.filter(tokens, lambda token: ~reduce(Column.__or__, [token.startswith(mark) for mark in marks]))

    return (
        F.when(language.isNull() | (hashed & slashed), without("#", "//", "/*"))
        .when(hashed, without("#"))
        .when(slashed, without("//", "/*"))
        .otherwise(tokens)
    )


def _lower_and_strip(tokens: Column) -> Column:
    return F.transform(tokens, lambda token: strip_blank(F.lower(token)))


def normalised_code_tokens(language: Column, tokens: Column) -> Column:
    """Code tokens for the vocabulary: no comments, lower case, trimmed."""
    return _lower_and_strip(without_comments(language, tokens))


def normalised_query_tokens(tokens: Column) -> Column:
    return _lower_and_strip(tokens)


def sub_tokens(token: Column) -> Column:
    """Split an identifier at dots, underscores and camel-case humps.

    String literals stay whole; pieces that do not start like an identifier
    are not split at humps.
    """

    def humps(part: Column) -> Column:
        spaced = F.regexp_replace(part, "(?<=[a-z0-9])([A-Z])", " $1")
        return F.when(part.rlike("^[_a-zA-Z]"), F.split(spaced, " ")).otherwise(F.array(part))

    pieces = F.flatten(F.transform(F.split(token, "[._]"), humps))
    trimmed = F.filter(F.transform(pieces, strip_blank), lambda piece: F.length(piece) > 0)
    return F.when(token.rlike("^[rf]?['\"]"), F.array(token)).otherwise(trimmed)


def query_tokens(tokens: Column, identifier: Column, lower_fallback: bool = False) -> Column:
    """Docstring tokens, or the identifier's sub-tokens when there are none."""
    fallback = sub_tokens(identifier)
    if lower_fallback:
        fallback = _lower_and_strip(fallback)
    long_enough = F.length(identifier) >= C.MIN_IDENTIFIER_QUERY_LENGTH
    return (
        F.when(F.size(tokens) > 0, normalised_query_tokens(tokens))
        .when(long_enough, fallback)
        .otherwise(F.array().cast("array<string>"))
    )


def text_query_tokens(query: Column) -> Column:
    """A typed query split at single blanks; empty tokens are possible."""
    return F.split(query, " ")


def lex_pattern(language: Column) -> Column:
    """The lexer's pattern; only comment syntax differs between languages.

    What follows a run of characters is never one of the run, so runs are
    possessive: the matches are the same, without places to come back to.
    """

    def pattern(*comments: str) -> Column:
        parts = [C.LEX_WORD, *comments, C.LEX_STRING, C.LEX_NUMBER, C.LEX_SYMBOL]
        return F.lit(re.sub(r"\]\*(?!\?)", "]*+", "|".join(parts)))

    hashed = language.isin(C.HASH_COMMENT_LANGUAGES)
    slashed = language.isin(C.SLASH_COMMENT_LANGUAGES)
    return (
        F.when(hashed & slashed, pattern(C.LEX_HASH_COMMENT, C.LEX_SLASH_COMMENT))
        .when(hashed, pattern(C.LEX_HASH_COMMENT))
        .when(slashed, pattern(C.LEX_SLASH_COMMENT))
        .otherwise(pattern())
    )


def code_tokens(language: Column, code: Column) -> Column:
    """Source text to tokens; a string literal or a comment is one token."""
    return F.regexp_extract_all(code, lex_pattern(language), F.lit(0))


def qualified_identifier(scope: Column, name: Column) -> Column:
    return F.concat_ws(".", scope, name)


def bare_identifier(identifier: Column) -> Column:
    return F.substring_index(identifier, ".", -1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language_of_file(path: Column) -> Column:
    """Language by the last dotted part of the file name; null if unknown."""
    extension = F.substring_index(basename(path), ".", -1)
    pairs = [F.lit(x) for language, ext in C.EXTENSIONS.items() for x in (ext, language)]
    return F.create_map(*pairs)[extension]


def relative_path(path: Column, root: Column) -> Column:
    return F.regexp_replace(F.substr(path, F.length(root) + 1), r"\A/+", "")


def capitalised(text: Column) -> Column:
    """First letter upper case, the rest unchanged, null as empty text."""
    value = F.coalesce(text, F.lit(""))
    return F.concat(F.upper(F.substring(value, 1, 1)), F.substr(value, F.lit(2)))


def document_label(language: Column, identifier: Column, code: Column) -> Column:
    name = F.when(F.length(identifier) > 0, identifier).otherwise(F.substring(code, 1, 32))
    return F.concat(F.lit("("), language, F.lit(") "), name)


def source_url(organization, name, commit, path, start_line, end_line) -> Column:
    return F.format_string(
        "https://github.com/%s/%s/blob/%s/%s#L%d-L%d",
        organization, name, commit, path, start_line, end_line,
    )


def filter_languages(query: Column) -> Column:
    """Languages named by ``+language=a,b``; null when there is no filter."""
    named = F.regexp_extract(query, C.LANGUAGE_FILTER, 1)
    return F.when(named != "", F.split(F.lower(named), ","))


def without_filter(query: Column) -> Column:
    return strip_blank(F.regexp_replace(query, C.LANGUAGE_FILTER, ""))


def cache_key(kind: str, organization: Column, name: Column, value: Column) -> Column:
    return F.sha1(F.concat_ws(":", F.lit(kind), organization, name, value))


def hash_share(seed: int, key: Column) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") / F.lit(2.0**28)
