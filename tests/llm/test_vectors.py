"""Exact top-k and embedding near-dedup against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import embedding_dedup, topk
from quarry.llm.components import components, forest

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, component_id string, cutoff int"


def table(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for i in range(n):
        v = (centres[i % 6] + 0.25 * rng.normal(size=width)).astype(np.float32)
        if i % 7 == 0:
            v = centres[0].astype(np.float32)  # a large group of equal vectors
        rows.append((i, v.tolist(), i % 3, "x", None, 1))
    bad = [None, [], [0.0] * width, [float("nan")] + [1.0] * (width - 1), [float("inf")] * width, [None] + [1.0] * (width - 1)]
    rows += [(n + i, v, 0, None, "y", None) for i, v in enumerate(bad)]
    rows += [(None, rows[1][1], 1, None, None, None), (n + 90, rows[1][1], None, None, None, None)]
    return rows


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("k", [1, 4, 5000])
def test_top_k(spark, k):
    rows = table(240, 9, 1)
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=k).collect())
    ints = {r[0]: [math.floor(64 * float(np.float32(x))) for x in r[1]] for r in rows if r[0] is not None and good(r[1])}
    want = []
    for q in ints:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)
            want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores[:k])]
    assert got == sorted(want)


def test_top_k_small_tables(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame(table(1, 4, 2)[:1], SCHEMA)
    assert topk.top_k(one, F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_large_numbers_is_exact():
    big = np.array([[3_000_000_001, -5], [3_000_000_000, 7]])
    assert sum(topk.partial_scores(big, big)).tolist() == [
        [9_000_000_006_000_000_026, 9_000_000_002_999_999_965],
        [9_000_000_002_999_999_965, 9_000_000_000_000_000_049],
    ]


def brute_links(rows, threshold):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and good(r[1]) and any(r[1])]
    near = {r[0]: set() for r in rows}
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2]:
                x, y = (np.array(v[1], np.float32).astype(np.float64) for v in (a, b))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[a[0]].add(b[0])
                    near[b[0]].add(a[0])
    return near


def reach(near):
    out = {}
    for start in sorted(k for k in near if k is not None):
        todo = [start] if start not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


@pytest.mark.parametrize("tile", [16, 2048])
def test_embedding_dedup(spark, tile):
    rows = table(300, 8, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = embedding_dedup.near_duplicates(df, 0.93, tile_rows=tile).collect()
    near = brute_links(rows, 0.93)
    component = reach(near)
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id) == (len(near[r.vec_id]), component[r.vec_id])
            assert r.kept == (r.vec_id == r.component_id)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(4)
    u = rng.normal(size=(200, 33))
    u /= np.linalg.norm(u, axis=1)[:, None]
    q, s, e = embedding_dedup.quantise(u)
    off = np.abs(u @ u.T - (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :])
    assert (off <= e[:, None] + (1 + e[:, None]) * e[None, :]).all()
    assert q.dtype == np.int8


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(200, 300)]
    edges += [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)] + [(7, 7)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == reach(near)
    a, b = np.array(edges).T
    child, root = forest(a, b, 2000)
    assert {int(c): int(r) for c, r in zip(child, root)} == {k: v for k, v in got.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
