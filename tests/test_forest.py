"""The forest index: recall, breadth, odd rows, and what a search reads."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators.forest import Forest, _ranked_whole
from quarry.operators.neighbours import nearest, nearest_to_stored
from quarry.suite.search import label_means, vector_items

FOLDER = "/root/testdata/sf0.1"


def found(hits):
    return {(r.query_id, str(r.language), r.row_index) for r in hits.collect()}


@pytest.fixture(scope="module")
def items(spark):
    return vector_items(spark, FOLDER).withColumn("language", F.col("language").cast("string"))


@pytest.fixture(scope="module")
def forest(spark, items):
    return Forest.build(items, n_trees=20, leaf_rows=16, shard_rows=150)


def test_recall_rises_with_the_budget(spark, items, forest):
    queries = label_means(spark, FOLDER)
    exact = found(nearest(items, queries, 20))
    shares = [
        len(found(forest.search(queries, 20, budget)) & exact) / len(exact) for budget in (20, 400, 2000, 20 * 2000)
    ]
    assert shares == sorted(shares)
    assert shares[-1] == 1.0
    assert shares[0] < shares[2]


def test_recall_of_stored_rows_at_the_default_budget(spark, items, forest):
    requests = items.where("row_index % 50 = 0").select(F.col("row_index").alias("query_id"), "language", "row_index")
    exact = found(nearest_to_stored(items, requests, 20))
    got = forest.search_stored(requests, 20)
    assert got.where("query_id = row_index").count() == 0
    assert len(found(got) & exact) / len(exact) >= 0.9


def test_leaves_hold_every_row_once(spark, items, forest):
    assert forest.groups.agg(F.min("shards")).first()[0] > 1
    rows = forest.vectors.select("language", "row_index", "leaves").collect()
    assert len(rows) == items.count() == len({(r.language, r.row_index) for r in rows})
    assert {len(r.leaves) for r in rows} == {20}
    sizes = forest.vectors.select("part", F.posexplode("leaves").alias("tree", "node")).groupBy("part", "tree", "node").count()
    leaves = forest.nodes.where("normal is null")
    assert leaves.agg(F.max("n")).first()[0] <= 16
    both = sizes.join(leaves, ["part", "tree", "node"], "full")
    assert both.where("not (count <=> n)").count() == 0


def test_equal_zero_and_missing_vectors(spark):
    rng = random.Random(1)
    rows = [("a", i, [1.0, 2.0, 3.0]) for i in range(300)]
    rows += [("a", 300 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(50)]
    rows += [("a", 400, [0.0, 0.0, 0.0]), ("a", 401, None), ("b", 1, [1.0, 0.0, 0.0])]
    items = spark.createDataFrame(rows, "language string, row_index long, embedding array<double>")
    forest = Forest.build(items, n_trees=3, leaf_rows=8)
    # Equal rows are dealt to the sides by a hash.
    assert forest.nodes.where("normal is null").agg(F.max("n")).first()[0] <= 8
    queries = spark.createDataFrame(
        [(1, [1.0, 2.0, 3.0], ["a"]), (2, [0.0, 1.0, 0.0], ["a", "b", "c"])],
        "query_id int, embedding array<double>, languages array<string>",
    )
    exact = nearest(items.where("embedding is not null"), queries, 5)
    full = forest.search(queries, 5, 3 * 351)
    key = ["query_id", "language", "row_index", "rank"]
    assert sorted(map(tuple, full.select(key).collect())) == sorted(map(tuple, exact.select(key).collect()))
    assert forest.search(queries.where("query_id = 9"), 5).count() == 0


def test_empty_index(spark):
    items = spark.createDataFrame([], "language string, row_index long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<double>")
    assert Forest.build(items, n_trees=2).search(queries.withColumn("languages", F.array(F.lit("a")))).count() == 0


def test_a_lookup_reads_its_buckets_only(spark, items, forest):
    buckets = forest.groups.first()["buckets"]
    assert buckets > 4
    one = items.limit(1).select(F.col("row_index").alias("query_id"), "language", "row_index")
    held = forest.stored(one)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    files = {f.rsplit("/", 2)[1] for f in held.inputFiles()}
    assert held.count() == 1
    scanned = forest.vectors.where(F.col("bucket").isin(forest._buckets(forest._asked(
        held.withColumn("query_id", F.lit(1)), 10, 5)))).select("bucket").distinct().count()
    assert 1 <= scanned < buckets and files


def test_frontier_takes_the_best_leaves(spark, items):
    """Against a search that sorts the bounds of all leaves."""
    forest = Forest.build(items.where("language = '1'"), n_trees=4, leaf_rows=8)
    nodes = {(r.tree, r.node): r for r in forest.nodes.collect()}
    query = np.array(items.where("language = '2'").first().embedding)
    unit = query / np.sqrt(query @ query)
    bounds = []
    for (tree, node), r in nodes.items():
        if r.normal is None:
            bound, at = np.inf, node
            while at > 1:
                margin = round(float(unit @ np.array(nodes[tree, at >> 1].normal)), 9)
                bound, at = min(bound, margin if at & 1 else -margin), at >> 1
            bounds.append((-bound, tree, node, r.n))
    rows = {r.row_index: r.leaves for r in forest.vectors.collect()}
    for budget in (1, 30, 100):
        held, wanted = 0, set()
        for _, tree, node, n in sorted(bounds):
            if held >= budget:
                break
            held += n
            wanted |= {i for i, leaves in rows.items() if leaves[tree] == node}
        asked = spark.createDataFrame([(1, query.tolist(), ["1"])], "query_id int, embedding array<double>, languages array<string>")
        got = {r.row_index for r in forest.search(asked, 10_000, budget).collect()}
        assert got == wanted


def test_a_whole_budget_is_answered_in_blocks(spark, items, forest, monkeypatch):
    """No list of leaves for each query, and the queries of a shard in groups."""
    monkeypatch.setattr("quarry.operators.forest.GROUP_QUERIES", 50)
    requests = items.select(F.col("row_index").alias("query_id"), "language", "row_index")
    hits = forest.search_stored(requests, 20, 20 * items.count())
    assert "keys#" not in hits._jdf.queryExecution().toString()
    exact = nearest_to_stored(items, requests, 20)
    key = ["query_id", "language", "row_index", "rank"]
    assert sorted(map(tuple, hits.select(key).collect())) == sorted(map(tuple, exact.select(key).collect()))
    dealt = forest._dealt(forest._asked(forest.stored(requests), 20, 20))
    assert dealt.groupBy("part", "_group").count().agg(F.max("count")).first()[0] < 100


def test_ties_and_own_rows_in_blocks():
    """Distances that differ after the ninth decimal only tie, and the row decides."""
    vectors = pa.table({"row_index": [7, 5, 3, 1, 9], "embedding": [[1.0, 1e-12], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]})
    asked = pa.table({
        "query_id": [1, 2, 3], "language": ["a"] * 3, "embedding": [[1.0, 0.0], [1.0, 0.0], [0.0, 0.0]],
        "own_row": pa.array([None, 3, None], pa.int64()),
    })
    run, _ = _ranked_whole("bigint", 2)
    assert list(zip(*(run(vectors, asked).column(c).to_pylist() for c in ("query_id", "row_index")))) == [(1, 3), (1, 5), (2, 5), (2, 7)]
