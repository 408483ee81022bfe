"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from quarry.llm import blocks, ranked_search

DOCS = "doc_id long, text string, score string, rank int, number long, item_id string"
QUERIES = "item_id long, text string, doc_id long, id int"


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, queries, k):
    bags = [(i, Counter(words(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        found = []
        for (i, bag), size in zip(bags, sizes):
            score = 0
            for t in words(text):
                if bag[t]:
                    m = 25 + 75 * size * n // total
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += weight * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score:
                found.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(found)[:k]):
            out.append((item, rank + 1, None if none else i, -score))
    return sorted(out, key=str)


def found(spark, docs, queries, k=10):
    left = spark.createDataFrame([(i, t, "s", 1, 2, "x") for i, t in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(i, t, 5, 6) for i, t in queries], QUERIES)
    return sorted(map(tuple, ranked_search.search(left, right, k=k).collect()), key=str)


def texts(rng, n, vocabulary):
    gaps = [" ", "-", "\n", "..", " é", "_"]
    return ["".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "segment", "read", "block", "k"), [(1, 200, 1, 100, 10), (2, 3000, 2, 10_000, 3), (3, 1 << 20, 64, 50, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, segment, read, block, k):
    for module, name, value in (
        (ranked_search, "SEGMENT_BYTES", segment), (ranked_search, "FIRST_READ", read),
        (ranked_search, "QUERY_BYTES", block), (blocks, "ROW_BYTES", 150),
    ):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(seed)
    vocabulary = ["The", "the", "b", "C3", "ü", "日本", "rare%d" % seed, "x"] + [f"w{i}" for i in range(20)]
    docs = [(rng.randint(0, 60) if rng.random() < 0.9 else None, t) for t in texts(rng, 80, vocabulary)]
    # Nulls, texts without terms, ties, repeated rows.
    docs += [(100, None), (101, ""), (102, "?! "), (90, "b b x"), (91, "x b b"), (89, "b x b"), docs[0], docs[0]]
    queries = list(enumerate(texts(rng, 8, vocabulary))) + [(50, None), (51, ""), (52, "unknown"), (53, "b x"), (54, "b b b x")]
    assert found(spark, docs, queries, k) == brute(docs, queries, k)


def test_long_text_and_repeated_query(spark):
    docs = [(1, "needle " + "hay " * 50_000), (2, "needle"), (3, "h" * 400_000), (4, "hay")]
    queries = [(1, "needle hay"), (1, "needle hay"), (2, "h" * 400_000)]
    assert found(spark, docs, queries) == brute(docs, queries, 10)


def test_no_rows(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []
