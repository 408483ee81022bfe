"""Substring dedup against brute force."""

import random
import re

import pytest

from quarry.llm import blocks, substring_dedup

SCHEMA = "doc_id long, text string, block long, kept int, grp string"


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, own in words:
        for p in range(len(own) - window + 1 if i is not None else 0):
            key = tuple(own[p : p + window])
            first[key] = min(first.get(key, (i, p)), (i, p))
    out = []
    for i, own in words:
        gone = set()
        for p in range(len(own) - window + 1 if i is not None else 0):
            if (i, p) > first[tuple(own[p : p + window])]:
                gone |= set(range(p, p + window))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        starts = [k for k in sorted(gone) if k - 1 not in gone]
        ends = [k + 1 for k in sorted(gone) if k + 1 not in gone]
        out.append((i, len(own), len(gone), starts, ends, kept))
    return sorted(out, key=str)


def found(spark, rows, window):
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, substring_dedup.remove_repeats(df, window=window).collect()), key=str)


def texts(seed, words, n=60):
    rng = random.Random(seed)
    passages = [[rng.choice(words) for _ in range(rng.randint(10, 60))] for _ in range(5)]
    rows = []
    for _ in range(n):
        own = []
        for _ in range(rng.randint(0, 5)):
            own += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 30))]
        gap = rng.choice([" ", "  ", "\n", " \t"])
        rows.append((rng.randint(0, n) if rng.random() < 0.9 else None, gap.join(own) + rng.choice(["", " "])))
    # Nulls, empty texts and repeated rows.
    return rows + [(3, None), (4, ""), (5, " \n "), rows[0], rows[1], (None, None)]


@pytest.mark.parametrize(("window", "words"), [(20, 40), (20, 2), (5, 3), (8, 30), (4, 1), (41, 2)])
def test_equals_brute_force(spark, monkeypatch, window, words):
    # Many small blocks, groups and ranges, so that most prefixes are too large.
    for name, value in (("BLOCK_BYTES", 2000), ("ROW_BYTES", 500)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(substring_dedup, "GROUP_SUFFIXES", 50)
    monkeypatch.setattr(substring_dedup, "RANGE_KEYS", 100)
    rows = texts(window, [f"w{i}" for i in range(words)] + ["é\xa0x"])
    assert found(spark, rows, window) == brute(rows, window)


def test_one_block_and_long_text(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice("abcdefgh") for _ in range(60_000))
    rows = [(1, long), (2, "x " + long[5000:9000] + " " + "y" * 300_000), (3, "a " * 5000)]
    assert found(spark, rows, 20) == brute(rows, 20)


def test_no_rows(spark):
    assert found(spark, [], 20) == []
    assert found(spark, [(None, None)], 20) == [(None, 0, 0, [], [], "")]
