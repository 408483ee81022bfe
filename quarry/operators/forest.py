"""Approximate neighbours by a forest of random-projection trees.

Rows are ``(language, row_index, embedding)`` as in :mod:`neighbours`;
``language`` may name a repository too. Each language's rows are dealt to shards
of a bounded number of rows. In a shard, every tree halves the rows of a node by
a plane through the origin, level by level, until a node holds few rows. The
index is three tables: ``vectors`` with each row's leaf in every tree, ``nodes``
with the plane of each node (none: a leaf) and its number of rows, and ``groups``
with the number of shards of each language. The first two are laid out by
bucket, so that a search reads the buckets of the shards that it asks.

A search goes through the trees best first: a node is as good as the smallest
distance to the planes above it, negative on the far side. Leaves are taken from
the best on until they hold ``search_k`` rows, counted once for each tree; the
rows in them are compared exactly. With ``search_k`` at the number of rows times
trees, all are, so that no leaf is looked for: the shard is compared in blocks.
The queries of a shard are dealt to groups, each with its copy of the shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarry import constants as C
from quarry.operators.embedding import list_column, matrix
from quarry.operators.encoding import _ragged
from quarry.operators.neighbours import DECIMALS, PRODUCT_NUMBERS, _unit
from quarry.operators.ranking import top_k
from quarry.session import materialise, shared_folder

#: Rows of a shard and of a leaf; levels of a tree; most buckets of an index.
SHARD_ROWS, LEAF_ROWS, MAX_DEPTH, MAX_BUCKETS = 1 << 16, 64, 40, 1024
#: Queries whose frontiers are expanded together.
QUERY_BLOCK = 256
#: Queries that meet one copy of a shard, and slots in which they are counted.
GROUP_QUERIES, SLOTS = 4096, 64
#: A node's number within its tree stays below this.
_TREE = 1 << 48

#: The stored tables.
SCHEMAS = {
    "vectors": "part string, language string, row_index long, embedding array<double>, leaves array<long>, bucket int",
    "nodes": "part string, tree int, node long, n long, normal array<double>, bucket int",
    "groups": "language string, rows long, shards int, buckets int, trees int",
}

Planes = Callable[[int, np.ndarray, int], np.ndarray]


def _mixed(rows: np.ndarray, salt: int) -> np.ndarray:
    h = (rows.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def margins(vectors: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Inner products row by row, to nine decimals, so that sides don't depend on
    the order of summation."""
    return np.round(np.einsum("ij,ij->i", vectors, normals), DECIMALS)


def split(unit: np.ndarray, rows: np.ndarray, tree: int, node: np.ndarray, leaf_rows: int, planes: Planes | None):
    """One level of one tree: the nodes there with their number of rows and plane
    (none for leaves), and each row's node below, zero where it is in a leaf.

    A plane lies between two rows that a hash picks. Where these are equal, the
    normal is zero and the hash deals the rows to the sides.
    """
    names, at, counts = np.unique(node, return_inverse=True, return_counts=True)
    opened = counts > leaf_rows
    normals = np.zeros((len(names), unit.shape[1]))
    salt = _mixed(_mixed(rows, 7).view(np.int64) ^ node, tree)
    if planes is not None:
        normals[opened] = planes(tree, names[opened], unit.shape[1])
    else:
        order = np.lexsort((salt, at))
        ends = np.cumsum(counts)
        normals = unit[order[ends - counts]] - unit[order[ends - 1]]
    inside = np.flatnonzero(opened[at])
    own = normals[at[inside]]
    side = margins(unit[inside], own) > 0
    flat = ~own.any(axis=1)
    side[flat] = (salt[inside][flat] >> np.uint64(17)) & np.uint64(1) == 1
    below = np.zeros(len(node), np.int64)
    below[inside] = 2 * node[inside] + side
    return names, counts, opened, normals, below


def _grow(n_trees: int, leaf_rows: int, max_depth: int, planes: Planes | None) -> Callable[[pa.Table], pa.Table]:
    """All trees of a shard: a row for each vector, with its leaves, and one for
    each node."""

    def run(shard: pa.Table) -> pa.Table:
        unit = _unit(matrix(shard.column("embedding")))
        rows = shard.column("row_index").to_numpy()
        leaves = np.zeros((n_trees, len(rows)), np.int64)
        found: list[tuple] = []
        for tree in range(n_trees):
            left, node = np.arange(len(rows)), np.ones(len(rows), np.int64)
            for depth in range(max_depth + 1):
                limit = leaf_rows if depth < max_depth else len(rows)
                names, counts, opened, normals, below = split(unit[left], rows[left], tree, node, limit, planes)
                found.append((np.full(len(names), tree), names, counts, opened, normals))
                leaves[tree, left[below == 0]] = node[below == 0]
                left, node = left[below > 0], below[below > 0]
                if not len(left):
                    break
        tree, name, counts, opened, normals = (np.concatenate(x) for x in zip(*found))
        n, m = len(name), len(rows)
        normal = list_column(normals)
        nodes = [
            pa.array([shard.column("part")[0].as_py()] * n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.list_(pa.int64())), pa.array(tree, pa.int32()),
            pa.array(name), pa.array(counts, pa.int64()),
            pa.ListArray.from_arrays(normal.offsets, normal.values, mask=pa.array(~opened)),
        ]
        vectors = [
            shard.column("part").combine_chunks(), shard.column("language").combine_chunks(), pa.array(rows, pa.int64()),
            shard.column("embedding").combine_chunks(), list_column(leaves.T, pa.int64()), pa.nulls(m, pa.int32()),
            pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.float64())),
        ]
        names = ["part", "language", "row_index", "embedding", "leaves", "tree", "node", "n", "normal"]
        return pa.concat_tables([pa.table(x, names) for x in (nodes, vectors)])

    return run


_GROWN = (
    "part string, language string, row_index long, embedding array<double>, leaves array<long>, "
    "tree int, node long, n long, normal array<double>"
)


class _Trees:
    """The nodes of a shard's trees as arrays in the order of (tree, node)."""

    def __init__(self, table: pa.Table):
        tree, node = table.column("tree").to_numpy().astype(np.int64), table.column("node").to_numpy()
        key = tree * _TREE + node
        order = np.argsort(key)
        self.key, self.tree, self.node = key[order], tree[order], node[order]
        self.n = table.column("n").to_numpy()[order]
        normal = table.column("normal").combine_chunks()
        self.leaf = normal.is_null().to_numpy(zero_copy_only=False)[order]
        inner = order[~self.leaf]
        self.normals = matrix(normal.take(pa.array(inner))) if len(inner) else np.zeros((0, 1))
        self.place = np.cumsum(~self.leaf) - 1
        children = [self.tree * _TREE + 2 * self.node + side for side in (0, 1)]
        self.child = [np.searchsorted(self.key, c) for c in children]
        # A child that holds no row has no node.
        self.there = [(c < len(self.key)) & (self.key[np.minimum(c, len(self.key) - 1)] == k) for c, k in zip(self.child, children)]
        self.roots = np.flatnonzero(self.node == 1)

    def reach(self, unit: np.ndarray, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``query, leaf``: the best leaves of each query until they hold its budget.

        The frontier is a table of (query, node, bound). In each round the best
        entries of every query that is not done yet are replaced by their
        children; a query is done when the leaves that are better than its
        frontier hold enough rows.
        """
        width = max(64, len(self.roots))
        query = np.repeat(np.arange(len(unit)), len(self.roots))
        at = np.tile(self.roots, len(unit))
        bound = np.full(len(query), np.inf)
        done: list[tuple] = []
        while len(query):
            order = np.lexsort((-bound, query))
            query, at, bound = query[order], at[order], bound[order]
            nth = np.arange(len(query)) - np.searchsorted(query, query)
            go = nth < width
            leaf = go & self.leaf[at]
            done.append((query[leaf], at[leaf], bound[leaf]))
            inner = np.flatnonzero(go & ~self.leaf[at])
            margin = margins(unit[query[inner]], self.normals[self.place[at[inner]]]) if len(inner) else np.zeros(0)
            rest = ~go
            parts = [(query[rest], at[rest], bound[rest])]
            for side, sign in ((0, -1.0), (1, 1.0)):
                some = self.there[side][at[inner]]
                own = inner[some]
                parts.append((query[own], self.child[side][at[own]], np.minimum(bound[own], sign * margin[some])))
            query, at, bound = (np.concatenate(x) for x in zip(*parts))
            # Rows in leaves at least as good as the best of the frontier.
            best = np.full(len(unit), -np.inf)
            np.maximum.at(best, query, bound)
            q, leaves, b = (np.concatenate(x) for x in zip(*done))
            safe = b > best[q]
            held = np.bincount(q[safe], self.n[leaves[safe]], len(unit))
            more = held[query] < budget[query]
            query, at, bound = query[more], at[more], bound[more]
        q, leaves, b = (np.concatenate(x) for x in zip(*done))
        order = np.lexsort((leaves, -b, q))
        q, leaves = q[order], leaves[order]
        total = np.cumsum(self.n[leaves]) - self.n[leaves]
        before = total - total[np.searchsorted(q, q)]
        some = before < budget[q]
        return q[some], leaves[some]


def _reached(query_type: str) -> tuple[Callable[[pa.Table, pa.Table], pa.Table], str]:
    def run(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        empty = asked.slice(0, 0).append_column("keys", pa.array([], pa.list_(pa.int64())))
        if not len(nodes) or not len(asked):
            return empty.drop_columns(["budget"])
        trees, out = _Trees(nodes), []
        for at in range(0, len(asked), QUERY_BLOCK):
            part = asked.slice(at, QUERY_BLOCK)
            unit = _unit(matrix(part.column("embedding")))
            query, leaf = trees.reach(unit, part.column("budget").to_numpy())
            bounds = np.searchsorted(query, np.arange(len(part) + 1)).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(trees.key[leaf]))
            out.append(part.append_column("keys", keys).drop_columns(["budget"]))
        return pa.concat_tables(out)

    return run, (
        f"part string, language string, query_id {query_type}, embedding array<double>, own_row long, _group int, keys array<long>"
    )


def _ranked(query_type: str, k: int) -> tuple[Callable[[pa.Table, pa.Table], pa.Table], str]:
    """The best ``k`` rows of a shard for each query among those of its leaves."""

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        ids, found, distances = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(vectors) and len(asked):
            rows = vectors.column("row_index").to_numpy()
            unit = _unit(matrix(vectors.column("embedding")))
            leaves = matrix(vectors.column("leaves"))
            key = (leaves + np.arange(leaves.shape[1]) * _TREE).T.ravel()
            order = np.argsort(key, kind="stable")
            key = key[order]
            wanted = asked.column("keys").combine_chunks()
            sizes = wanted.value_lengths().to_numpy()
            names = wanted.flatten().to_numpy()
            ask = _unit(matrix(asked.column("embedding")))
            own_row = asked.column("own_row").fill_null(-1).to_numpy()
            # Each query's rows once: the members of its leaves, as a mask over the shard.
            edges = np.concatenate([[0], np.cumsum(sizes)])
            begin, end = np.searchsorted(key, names), np.searchsorted(key, names, side="right")
            parts = []
            for i in range(len(asked)):
                mask = np.zeros(len(rows), bool)
                for a, b in zip(begin[edges[i] : edges[i + 1]].tolist(), end[edges[i] : edges[i + 1]].tolist()):
                    mask[order[a:b] % len(rows)] = True
                mask[rows == own_row[i]] = False
                own = np.flatnonzero(mask)
                near = np.round(1.0 - unit[own] @ ask[i], DECIMALS)
                own, near = own[~np.isnan(near)], near[~np.isnan(near)]
                best = np.lexsort((rows[own], near))[:k]
                parts.append((np.full(len(best), i), rows[own[best]], near[best]))
            ids, found, distances = (np.concatenate(x) for x in zip(*parts))
        return _results(asked, ids, found, distances)

    return run, _RESULT.format(query_type)


def _ranked_whole(query_type: str, k: int) -> tuple[Callable[[pa.Table, pa.Table], pa.Table], str]:
    """The best ``k`` rows of a shard for queries whose budget takes all of its
    leaves: blocks of matrix products, without a list of leaves for each query."""

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(vectors) and len(asked):
            rows = vectors.column("row_index").to_numpy()
            unit = _unit(matrix(vectors.column("embedding")))
            ask = _unit(matrix(asked.column("embedding")))
            own_row = asked.column("own_row").fill_null(-1).to_numpy()
            by_row = np.argsort(rows, kind="stable")
            step = max(1, PRODUCT_NUMBERS // len(rows))
            for at in range(0, len(ask), step):
                near = 1.0 - ask[at : at + step] @ unit.T
                # The row itself, as often as it stands there.
                first, last = (np.searchsorted(rows[by_row], own_row[at : at + step], side) for side in ("left", "right"))
                near[np.repeat(np.arange(len(near)), last - first), by_row[_ragged(first, last - first)]] = np.nan
                limit = np.full(len(near), np.inf)
                if k < len(rows):
                    limit = np.partition(near, k - 1, axis=1)[:, k - 1]
                    limit[np.isnan(limit)] = np.inf
                # All that may be among the first once distances are rounded.
                query, own = np.nonzero(near <= limit[:, None] + 2 * 10.0**-DECIMALS)
                distance, row = np.round(near[query, own], DECIMALS), rows[own]
                order = np.lexsort((row, distance, query))
                nth = np.arange(len(query)) - np.searchsorted(query, query)
                best = order[nth < k]
                parts.append((at + query[best], row[best], distance[best]))
        return _results(asked, *(np.concatenate(x) for x in zip(*parts)))

    return run, _RESULT.format(query_type)


_RESULT = "query_id {}, language string, row_index long, distance double"


def _results(asked: pa.Table, ids: np.ndarray, rows: np.ndarray, distances: np.ndarray) -> pa.Table:
    taken = pa.array(ids)
    return pa.table(
        [asked.column("query_id").take(taken), asked.column("language").take(taken), pa.array(rows), pa.array(distances)],
        ["query_id", "language", "row_index", "distance"],
    )


def _part(language: Column, shard: Column) -> Column:
    return F.concat_ws(":", language, shard.cast("string"))


class Forest:
    """A forest index; see the module."""

    def __init__(self, vectors: DataFrame, nodes: DataFrame, groups: DataFrame):
        self.vectors, self.nodes, self.groups = vectors, nodes, groups

    @staticmethod
    def grow(
        items: DataFrame,
        n_trees: int = C.TREES,
        leaf_rows: int = LEAF_ROWS,
        shard_rows: int = SHARD_ROWS,
        max_depth: int = MAX_DEPTH,
        planes: Planes | None = None,
    ) -> Forest:
        """The tables of the index. Vectors move once, to their shard.

        ``planes`` gives normals for (tree, nodes, width) in place of those
        made of the rows. Null and zero vectors are in no shard.
        """
        known = materialise(
            items.where(F.exists("embedding", lambda x: x != 0)).select(
                F.col("language").cast("string").alias("language"),
                F.col("row_index").cast("long").alias("row_index"),
                F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
            ),
            "vectors",
        )
        shards = F.ceil(F.col("rows") / shard_rows).cast("int")
        groups = known.groupBy("language").agg(F.count("*").alias("rows")).withColumn("shards", shards)
        total = groups.agg(F.coalesce(F.sum("shards"), F.lit(0)).alias("n")).first()["n"]
        buckets = int(max(1, min(MAX_BUCKETS, total)))
        groups = materialise(groups.withColumns({"buckets": F.lit(buckets), "trees": F.lit(n_trees)}), "groups")
        dealt = known.join(groups.select("language", "shards"), "language").select(
            _part(F.col("language"), F.pmod(F.xxhash64("row_index"), F.col("shards"))).alias("part"),
            "language", "row_index", "embedding",
        )
        grown = dealt.groupBy("part").applyInArrow(_grow(n_trees, leaf_rows, max_depth, planes), _GROWN)
        bucket = F.pmod(F.xxhash64("part"), F.lit(buckets)).cast("int")
        grown = materialise(grown.withColumn("bucket", bucket), "forest")
        return Forest(
            grown.where("row_index is not null").select("bucket", "part", "language", "row_index", "embedding", "leaves"),
            grown.where("row_index is null").select("bucket", "part", "tree", "node", "n", "normal"),
            groups,
        )

    def save(self, path: str) -> Forest:
        for name, df in (("vectors", self.vectors), ("nodes", self.nodes)):
            df.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        self.groups.write.mode("overwrite").parquet(f"{path}/groups")
        return Forest.load(self.groups.sparkSession, path)

    @staticmethod
    def build(items: DataFrame, path: str | None = None, **options) -> Forest:
        spark = items.sparkSession
        return Forest.grow(items, **options).save(path or f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        # An empty table has no file that tells its schema.
        return Forest(*[spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}") for name in SCHEMAS])

    def _buckets(self, asked: DataFrame) -> list[int]:
        """Buckets of the shards asked: no more numbers than the index has buckets."""
        return [r[0] for r in asked.select("bucket").distinct().collect()]

    def _asked(self, queries: DataFrame, search_k: int | None, k: int) -> DataFrame:
        """A row for each query and shard of its languages."""
        names = queries.columns
        if "languages" not in names:
            every = [r[0] for r in self.groups.select("language").distinct().collect()]
            queries = queries.withColumn("languages", F.array(*map(F.lit, every)).cast("array<string>"))
        own = F.col("own_row").cast("long") if "own_row" in names else F.lit(None).cast("long")
        wanted = queries.select(
            "query_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), own.alias("own_row"),
            F.explode(F.array_distinct(F.transform("languages", lambda x: x.cast("string")))).alias("language"),
        )
        budget = F.lit(search_k) if search_k else F.col("trees") * k
        shard = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
        return wanted.join(self.groups, "language").select(
            "*", F.ceil(budget / F.col("shards")).cast("long").alias("budget"), shard.alias("shard")
        ).withColumn("part", _part(F.col("language"), F.col("shard"))).withColumn(
            "bucket", F.pmod(F.xxhash64("part"), F.col("buckets")).cast("int")
        ).select("bucket", "part", "language", "query_id", "embedding", "own_row", "budget")

    @staticmethod
    def _dealt(asked: DataFrame) -> DataFrame:
        """``asked`` with ``_group``, so that of a shard's queries a bounded number
        meets in a task. The numbers of groups are met by shard and slot, so that
        no task reads all queries of a shard."""
        asked = asked.withColumn("_slot", F.pmod(F.xxhash64(F.lit("slot"), "query_id"), F.lit(SLOTS)).cast("int"))
        held = asked.groupBy("part", "_slot").agg(F.count("*").alias("_n"))
        total = F.sum("_n").over(Window.partitionBy("part"))
        groups = materialise(held.select("part", "_slot", F.ceil(total / GROUP_QUERIES).cast("int").alias("_groups")), "groups")
        group = F.pmod(F.xxhash64("query_id"), F.col("_groups")).cast("int")
        return asked.join(groups, ["part", "_slot"]).withColumn("_group", group).drop("_slot", "_groups")

    @staticmethod
    def _copied(rows: DataFrame, asked: DataFrame) -> DataFrame:
        """A shard's rows once for each group of queries that ask it."""
        return rows.join(asked.select("part", F.col("_group").alias("_copy")).distinct(), "part")

    def search(self, queries: DataFrame, k: int = C.WEB_RESULTS, search_k: int | None = None) -> DataFrame:
        """Nearest ``k`` per (query, language) within the search budget, ``k`` for
        each tree by default. Optional columns of queries: ``languages``, and
        ``own_row``, a row to leave out."""
        asked = materialise(self._asked(queries, search_k, k), "asked")
        kind = asked.schema["query_id"].dataType.simpleString()
        buckets = self._buckets(asked)
        roots = self.nodes.where(F.col("bucket").isin(buckets) & (F.col("node") == 1))
        sizes = materialise(roots.groupBy("part").agg(F.sum("n").alias("_leaves")), "sizes")
        asked = materialise(self._dealt(asked).join(sizes, "part"), "dealt")
        columns = ["part", "language", "query_id", "embedding", "own_row"]
        vectors = self.vectors.where(F.col("bucket").isin(buckets))
        whole = asked.where("budget >= _leaves")
        rank, schema = _ranked_whole(kind, k)
        found = self._copied(vectors.select("part", "row_index", "embedding"), whole).groupBy("part", "_copy").cogroup(
            whole.select(*columns, "_group").groupBy("part", "_group")
        ).applyInArrow(rank, schema)
        some = asked.where("budget < _leaves")
        if some.head(1):
            near, reached = _reached(kind)
            nodes = self.nodes.where(F.col("bucket").isin(buckets)).select("part", "tree", "node", "n", "normal")
            wanted = self._copied(nodes, some).groupBy("part", "_copy").cogroup(
                some.select(*columns, "budget", "_group").groupBy("part", "_group")
            ).applyInArrow(near, reached)
            rank, schema = _ranked(kind, k)
            found = found.unionByName(
                self._copied(vectors.select("part", "row_index", "embedding", "leaves"), some).groupBy("part", "_copy")
                .cogroup(wanted.groupBy("part", "_group")).applyInArrow(rank, schema)
            )
        order = [F.col("distance"), F.col("row_index")]
        return top_k(found, ["query_id", "language"], order, k, ["row_index"])

    def stored(self, requests: DataFrame) -> DataFrame:
        """Requests (query_id, language, row_index) with the vectors of their rows,
        from the buckets that hold them."""
        wanted = materialise(
            requests.select("query_id", F.col("language").cast("string").alias("language"), F.col("row_index").cast("long").alias("row_index"))
            .join(self.groups, "language")
            .withColumn("part", _part(F.col("language"), F.pmod(F.xxhash64("row_index"), F.col("shards"))))
            .select("query_id", "part", "row_index", F.pmod(F.xxhash64("part"), F.col("buckets")).cast("int").alias("bucket")),
            "wanted",
        )
        held = self.vectors.where(F.col("bucket").isin(self._buckets(wanted)))
        return held.join(wanted, ["bucket", "part", "row_index"]).select(
            "query_id", "embedding", F.array("language").alias("languages"), F.col("row_index").alias("own_row")
        )

    def search_stored(self, requests: DataFrame, k: int = C.WEB_RESULTS, search_k: int | None = None) -> DataFrame:
        """Nearest rows of the same language to stored ones, without themselves."""
        return self.search(self.stored(requests), k, search_k)
