"""Neighbour search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import neighbours as N


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    data = rng.normal(size=(600, 8))
    data[::3] = data[0]  # a third of the rows are one copy
    data[5] = 0.0
    return data


@pytest.fixture(scope="module")
def items(spark, vectors):
    rows = [("x" if i % 2 else "y", i, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "language string, row_index long, embedding array<double>").repartition(5)


@pytest.fixture(scope="module")
def queries(spark, vectors):
    rng = np.random.default_rng(4)
    rows = [(i, q.tolist()) for i, q in enumerate([*rng.normal(size=(6, 8)), vectors[0]])]
    return spark.createDataFrame(rows, "query_id long, embedding array<double>")


def brute(vectors, queries, k, skip=lambda q, i: False):
    out = set()
    for row in queries.collect():
        q = np.array(row.embedding)
        for language in ("x", "y"):
            found = []
            for i, v in enumerate(vectors):
                if ("x" if i % 2 else "y") != language or not v.any() or skip(row.query_id, i):
                    continue
                d = round(1 - q @ v / (np.linalg.norm(q) * np.linalg.norm(v)), 9)
                found.append((d, i))
            for rank, (d, i) in enumerate(sorted(found)[:k], 1):
                out.add((row.query_id, language, i, rank))
    return out


def as_set(hits):
    return {(r.query_id, r.language, r.row_index, r["rank"]) for r in hits.collect()}


def test_exact_search_with_many_copies(spark, vectors, items, queries):
    assert as_set(N.nearest(items, queries, 12)) == brute(vectors, queries, 12)


def test_query_blocks_give_the_same(spark, vectors, items, queries, monkeypatch):
    monkeypatch.setattr(N, "QUERY_NUMBERS", 16)
    assert as_set(N.nearest(items, queries, 5)) == brute(vectors, queries, 5)


def test_languages_limit_a_query(spark, vectors, items, queries):
    limited = queries.withColumn("languages", F.array(F.lit("x")))
    expected = {h for h in brute(vectors, queries, 5) if h[1] == "x"}
    assert as_set(N.nearest(items, limited, 5)) == expected


def test_stored_rows_leave_themselves_out(spark, vectors, items):
    requests = items.filter("row_index in (0, 7, 30)").select(
        F.col("row_index").alias("query_id"), "language", "row_index"
    )
    asked = requests.join(items, ["language", "row_index"]).select("query_id", "language", "embedding")
    languages = {r.query_id: r.language for r in asked.collect()}
    expected = {
        h for h in brute(vectors, asked, 6, skip=lambda q, i: q == i) if languages[h[0]] == h[1]
    }
    assert as_set(N.nearest_to_stored(items, requests, 6)) == expected


def test_index(spark, vectors, items, queries, tmp_path):
    path = str(tmp_path / "index")
    index = N.VectorIndex.build(items, 6, path)
    assert index.table.count() == 599  # every vector but the zero one
    everything = brute(vectors, queries, 10)
    assert as_set(index.search(queries, 10, probes=6)) == everything
    found = as_set(N.VectorIndex.load(spark, path).search(queries, 10, probes=4))
    recall = len({h[:3] for h in found} & {h[:3] for h in everything}) / len(everything)
    assert recall > 0.7
    # Few probes still reach k results of every language.
    assert len(index.search(queries, 60, probes=1).collect()) == 7 * 2 * 60
    stored = items.filter("row_index = 7").select(
        F.lit(1).alias("query_id"), "language", "row_index"
    )
    mine = index.search_stored(stored, 4, probes=6)
    assert as_set(mine) == as_set(N.nearest_to_stored(items, stored, 4))
    plan = index.search(queries, 10, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1][:60]


def test_no_pairing_of_rows(spark, items, queries):
    plan = N.nearest(items, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_many_queries_get_partial_results_of_their_languages_only(spark, vectors, monkeypatch):
    """Vectors are laid out by language when queries need several passes."""
    rows = [(f"l{i % 8}", i, v.tolist()) for i, v in enumerate(vectors)]
    items = spark.createDataFrame(rows, "language string, row_index long, embedding array<double>").repartition(8)
    requests = items.where("row_index % 7 = 1").selectExpr("row_index AS query_id", "language", "row_index")
    whole = {tuple(r) for r in N.nearest_to_stored(items, requests, 4).collect()}
    seen = []
    real = N._partial_best

    def watched(items, *rest):
        held = items.select("language", F.spark_partition_id().alias("task")).distinct().collect()
        seen.append((len(held), len({r.task for r in held}), len({r.language for r in held})))
        return real(items, *rest)

    monkeypatch.setattr(N, "_partial_best", watched)
    monkeypatch.setattr(N, "QUERY_NUMBERS", 1000)
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task for each file
    try:
        found = {tuple(r) for r in N.nearest_to_stored(items, requests, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == whole and len(seen) > 1
    assert all(pairs < tasks + languages for pairs, tasks, languages in seen)
