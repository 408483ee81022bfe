"""Phrase collocations against brute force."""

import random
import re
from collections import Counter

import pytest

from quarry.llm import blocks, collocations

SCHEMA = "doc_id long, text string, lang string, id int, words string, f long, block int"
CAPITALS = {c: c + 32 for c in range(65, 91)}


def brute(rows, max_words, min_count, top, absorbed=80):
    counts, sizes = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(CAPITALS)):
            own = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(own)
            for k in range(1, max_words + 1):
                for p in range(len(own) - k + 1):
                    counts[lang, tuple(own[p : p + k])] += 1
    counts = {g: n for g, n in counts.items() if n >= min_count}
    inside = set()
    for (lang, g), n in counts.items():
        for k in range(2, len(g)):
            for p in range(len(g) - k + 1):
                if 100 * n >= absorbed * counts[lang, g[p : p + k]]:
                    inside.add((lang, g[p : p + k]))
    found = {}
    for (lang, g), a in counts.items():
        if len(g) < 2 or (lang, g) in inside:
            continue
        cuts = [(counts[lang, g[:k]], counts[lang, g[k:]], k) for k in range(1, len(g))]
        score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for l, r, k in cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), l, r))
    return sorted(
        (lang, rank + 1, g.decode(), -a, l, r, sizes[lang], -score)
        for lang, own in found.items()
        for rank, (score, a, g, l, r) in enumerate(sorted(own)[:top])
    )


def found(spark, rows, **args):
    df = spark.createDataFrame([(i, t, lang, 1, "w", 2, 3) for i, t, lang in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, collocations.collocations(df, **args).collect()))


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "é", "a-b", "x" * 5000, "\xa0"]
    phrases = [["new", "York", "city"], ["of", "the"], ["one", "two", "three", "four", "five"], ["hapax", "legomenon"]]
    rows = []
    for i in range(n):
        own = []
        for _ in range(rng.randint(0, 30)):
            own += rng.choice(phrases) if rng.random() < 0.4 else [rng.choice(words[:-2] if rng.random() < 0.99 else words)]
            own.append(rng.choice([" ", "\t", "  ", ". ", ",", "\n", "!?"]))
        text = "".join(w if w.strip(" \t.,\n!?") == "" else f" {w} " for w in own)
        rows.append((i % 50, text, rng.choice(["en", "de", None, "und"])))
    return rows + [(1, None, "en"), (2, "", "fr"), (3, "...", "fr"), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "max_words", "min_count", "top"), [(1, 4, 5, 2000), (2, 3, 2, 3), (3, 2, 3, 10), (4, 4, 1, 50)])
def test_equals_brute_force(spark, monkeypatch, seed, max_words, min_count, top):
    for name, value in (("BLOCK_BYTES", 3000), ("ROW_BYTES", 700)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(collocations, "RANGE_ENTRIES", 40)
    rows = texts(seed)
    args = {"max_words": max_words, "min_count": min_count, "top": top}
    assert found(spark, rows, **args) == brute(rows, **args)


def test_extensions(spark):
    df = spark.createDataFrame([(1, "a b c. a b c. a b. b c", None)], "doc_id long, text string, lang string")
    rows, sizes = collocations.phrases(df, max_words=3, min_count=2)
    got = {" ".join(r.words): (r.f, r.l, r.r, r.extension) for r in rows.collect()}
    assert got == {"a b": (3, [3], [4], 2), "b c": (3, [4], [3], 2), "a b c": (2, [3, 3], [3, 3], None)}
    assert [tuple(r) for r in sizes.collect()] == [("und", 10)]


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "a b", "en")]) == []
