"""The forest index over the test vectors.

Planes by a whole-number formula make the trees expressible in SQL; planes made
of the rows are checked at full breadth, where the search is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.operators.forest import Forest
from quarry.suite.common import table
from quarry.suite.search import MEANS, _hits, _sql_knn, label_means, sql_distance, sql_top, vector_items

#: Trees, rows of a leaf, levels and search budget of the trees by formula.
TREES, LEAF, DEPTH, BUDGET = 6, 16, 12, 50


def formula_planes(tree: int, nodes: np.ndarray, width: int) -> np.ndarray:
    d = np.arange(1, width + 1)
    return ((tree * 5 + 1) * (nodes[:, None] * 11 + 3) * (d * 7 + 2) % 101 - 50) / 50.0


def _formula_forest(spark, folder):
    return Forest.build(
        vector_items(spark, folder), n_trees=TREES, leaf_rows=LEAF, max_depth=DEPTH, planes=formula_planes
    )


def _plain(hits):
    return _hits(hits.withColumn("language", F.col("language").cast("int")))


def forest_leaves(spark, folder):
    """Each vector's leaf in every tree."""
    vectors = _formula_forest(spark, folder).vectors
    return vectors.select("language", "row_index", F.posexplode("leaves").alias("tree", "leaf"))


def forest_nodes(spark, folder):
    """Rows below every node of every tree, and whether it is a leaf."""
    nodes = _formula_forest(spark, folder).nodes
    language = F.substring_index("part", ":", 1).alias("language")
    return nodes.groupBy(language, "tree", "node").agg(
        F.sum("n").alias("n"), F.bool_and(F.col("normal").isNull()).alias("is_leaf")
    )


def knn_index(spark, folder):
    """Best-first search of a forest within a small budget."""
    found = _formula_forest(spark, folder).search(label_means(spark, folder), C.WEB_RESULTS, BUDGET)
    return _plain(found)


def knn_index_full(spark, folder):
    """Trees made of the rows; a budget of all rows in every tree is exact."""
    items = vector_items(spark, folder)
    forest = Forest.build(items, n_trees=10, leaf_rows=16, shard_rows=100)
    return _plain(forest.search(label_means(spark, folder), C.WEB_RESULTS, 10 * items.count()))


def similar_docs_index(spark, folder):
    """Stored vectors like the ones users looked at, by the index alone."""
    seen = table(spark, folder, "events").select(F.col("user_id").alias("row_index")).distinct()
    items = vector_items(spark, folder).select("language", "row_index")
    requests = seen.join(items, "row_index").select(F.col("row_index").alias("query_id"), "language", "row_index")
    return _plain(_formula_forest(spark, folder).search_stored(requests, C.WEB_RESULTS, BUDGET))


QUERIES = {
    f.__name__: f for f in [forest_leaves, forest_nodes, knn_index, knn_index_full, similar_docs_index]
}


# --- The same in SQL ------------------------------------------------------------

_PLANE = (
    "list_transform(range(1, 65), lambda d: "
    "(((tree * 5 + 1) * (node * 11 + 3) * (d * 7 + 2)) % 101 - 50) / 50e0)"
)


def _unit(x: str) -> str:
    return f"list_transform({x}, lambda y: y / sqrt(list_dot_product({x}, {x})))"


def _levels() -> str:
    steps = [
        f"""rows_in AS (
  SELECT label AS language, vec_id AS row_index, {_unit('embedding::DOUBLE[]')} AS u
  FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
level_0 AS (SELECT *, 1::BIGINT AS node FROM rows_in, (SELECT unnest(range(0, {TREES}))::INTEGER AS tree))"""
    ]
    for i in range(DEPTH + 1):
        steps.append(
            f"sized_{i} AS (SELECT *, count(*) OVER (PARTITION BY language, tree, node) AS n FROM level_{i})"
        )
        if i < DEPTH:
            steps.append(
                f"level_{i + 1} AS (SELECT language, row_index, u, tree, 2 * node + "
                f"CASE WHEN round(list_dot_product(u, {_PLANE}), 9) > 0 THEN 1 ELSE 0 END AS node "
                f"FROM sized_{i} WHERE n > {LEAF})"
            )
    every = [
        f"SELECT language, row_index, tree, node AS leaf FROM sized_{i}" + (f" WHERE n <= {LEAF}" if i < DEPTH else "")
        for i in range(DEPTH + 1)
    ]
    steps.append("leaves AS (" + " UNION ALL ".join(every) + ")")
    return ",\n".join(steps)


LEVELS = _levels()


def _best_first(queries: str) -> str:
    """CTE ``candidates(query_id, language, row_index)`` of the leaves that a CTE
    (query_id, language, vec) takes."""
    return f"""sizes AS (SELECT language, tree, leaf, count(*) AS n FROM leaves GROUP BY ALL),
above AS (
  SELECT language, tree, leaf, n, leaf >> i AS node, (leaf >> (i - 1)) & 1 AS side
  FROM (SELECT *, unnest(range(1, {DEPTH + 2})) AS i FROM sizes) WHERE leaf >> i >= 1),
seen AS (
  SELECT q.query_id, language, tree, leaf,
    min(CASE side WHEN 1 THEN 1 ELSE -1 END * round(list_dot_product({_unit('q.vec')}, {_PLANE}), 9)) AS bound
  FROM {queries} q JOIN above USING (language) GROUP BY ALL),
bounds AS (
  SELECT q.query_id, language, tree, leaf, n, coalesce(bound, 'infinity'::DOUBLE) AS bound
  FROM {queries} q JOIN sizes USING (language) LEFT JOIN seen s USING (query_id, language, tree, leaf)),
taken AS (
  SELECT * FROM bounds QUALIFY sum(n) OVER (
    PARTITION BY query_id, language ORDER BY bound DESC, tree, leaf ROWS UNBOUNDED PRECEDING) - n < {BUDGET}),
candidates AS (
  SELECT DISTINCT query_id, language, row_index FROM taken JOIN leaves USING (language, tree, leaf))"""


_RANKED = f"""pairs AS (
  SELECT c.query_id, c.language, c.row_index, {sql_distance('q.vec', 'e.embedding::DOUBLE[]')} AS distance
  FROM candidates c JOIN asked q USING (query_id, language) JOIN embeddings e ON e.vec_id = c.row_index
  WHERE c.row_index IS DISTINCT FROM q.own)
SELECT query_id, language, row_index, rank, distance + 0e0 AS distance FROM ({sql_top('pairs', C.WEB_RESULTS)})"""

SQL = {
    "forest_leaves": f"WITH {LEVELS} SELECT language::VARCHAR AS language, row_index, tree, leaf FROM leaves",
    "forest_nodes": f"WITH {LEVELS} "
    + " UNION ALL ".join(
        f"SELECT language::VARCHAR AS language, tree, node, count(*) AS n, "
        + (f"count(*) <= {LEAF}" if i < DEPTH else "true")
        + f" AS is_leaf FROM level_{i} GROUP BY ALL"
        for i in range(DEPTH + 1)
    ),
    "knn_index": f"""
WITH {LEVELS}, {MEANS},
asked AS (
  SELECT m.label AS query_id, l.language, m.vec, NULL::BIGINT AS own
  FROM means m, (SELECT DISTINCT language FROM leaves) l),
{_best_first('asked')},
{_RANKED}""",
    "knn_index_full": _sql_knn(C.WEB_RESULTS),
    "similar_docs_index": f"""
WITH {LEVELS},
asked AS (
  SELECT vec_id AS query_id, label AS language, embedding::DOUBLE[] AS vec, vec_id AS own
  FROM embeddings WHERE vec_id IN (SELECT user_id FROM events)),
{_best_first('asked')},
{_RANKED}""",
}
