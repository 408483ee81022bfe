"""Nearest code vectors per (query, language): exact and by an index.

Vectors to search are rows ``(language, row_index, embedding)``, queries are
rows ``(query_id, embedding)``, results are rows ``(query_id, language,
row_index, distance, rank)`` with cosine distance. Distances are kept to nine
decimals, so equal vectors tie and row order settles the tie, whatever the
order of summation. A zero vector has no distance and is no result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from quarry import constants as C
from quarry.operators.embedding import list_column, matrix
from quarry.operators.ranking import top_k
from quarry.session import materialise, shared_folder

# Queries that travel to the executors at once, in numbers (queries x width).
QUERY_NUMBERS = 4_000_000
# Distances that a task holds at once.
PRODUCT_NUMBERS = 1 << 20
DECIMALS = 9


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / length


class _Best:
    """The running best ``k`` (distance, row_index) per (query, language)."""

    def __init__(self, k: int):
        self.k = k
        self.kept: dict = {}

    def add(self, key, distances: np.ndarray, rows: np.ndarray) -> None:
        if key in self.kept:
            old_distances, old_rows = self.kept[key]
            distances = np.concatenate([old_distances, distances])
            rows = np.concatenate([old_rows, rows])
        order = np.lexsort((rows, distances))[: self.k]
        self.kept[key] = distances[order], rows[order]

    def limit(self, key) -> float:
        distances = self.kept.get(key, (np.empty(0),))[0]
        return distances[-1] if len(distances) == self.k else np.inf

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        queries, languages, rows, distances = [], [], [], []
        for (query, language), (best, index) in self.kept.items():
            queries += [query] * len(best)
            languages += [language] * len(best)
            rows.append(index)
            distances.append(best)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(queries, schema.field(0).type),
                pa.array(languages, schema.field(1).type),
                pa.array(np.concatenate(rows) if rows else [], pa.int64()),
                pa.array(np.concatenate(distances) if distances else [], pa.float64()),
            ],
            schema=schema,
        )


def _partial_best(items: DataFrame, queries: dict, k: int, excluded: bool, cells: bool) -> DataFrame:
    """Each task's own best ``k``; only those leave the task.

    One matrix product per batch of vectors and block of queries replaces
    any pairing of rows. ``queries`` are broadcast; their size was checked.
    """
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(queries)
    language_type = items.schema["language"].dataType.simpleString()
    schema = (
        f"query_id {queries['type']}, language {language_type}, row_index long, distance double"
    )
    arrow = pa.schema(
        [
            ("query_id", pa.int64() if queries["type"] in ("bigint", "int") else pa.string()),
            ("language", pa.string() if language_type == "string" else pa.int32()
             if language_type == "int" else pa.int64()),
            ("row_index", pa.int64()),
            ("distance", pa.float64()),
        ]
    )
    if queries["type"] == "int":
        arrow = arrow.set(0, pa.field("query_id", pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = _Best(k)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            languages = batch.column("language").to_numpy(zero_copy_only=False)
            rows = batch.column("row_index").to_numpy()
            vectors = _unit(matrix(batch.column("embedding")))
            cell = batch.column("cell").to_numpy() if cells else None
            names, which = np.unique(languages, return_inverse=True)
            for i, name in enumerate(names):
                language = name if isinstance(name, str) else int(name)
                members = np.flatnonzero(which == i)
                positions = np.concatenate(
                    [asked["open"], asked["by_language"].get(language, asked["open"][:0])]
                )
                step = max(1, PRODUCT_NUMBERS // len(members))
                for start in range(0, len(positions), step):
                    block = positions[start : start + step]
                    distance = np.round(1.0 - vectors[members] @ asked["unit"][block].T, DECIMALS)
                    for column, query in enumerate(block):
                        key = (asked["ids"][query], language)
                        near = distance[:, column]
                        keep = near <= best.limit(key)
                        if excluded and asked["own"][query][0] == language:
                            keep &= rows[members] != asked["own"][query][1]
                        if cells:
                            keep &= np.isin(cell[members], asked["cells"].get(key, ()))
                        chosen = np.flatnonzero(keep)
                        if len(chosen) > k:
                            cut = np.partition(near[chosen], k - 1)[k - 1]
                            chosen = chosen[near[chosen] <= cut]
                        if len(chosen):
                            best.add(key, near[chosen], rows[members[chosen]])
        yield best.batch(arrow)

    columns = ["language", F.col("row_index").cast("long"), "embedding"]
    if cells:
        columns.append(F.col("cell").cast("long"))
    return items.select(*columns).mapInArrow(run, schema)


def _collect_queries(block: DataFrame, own: bool, cells: DataFrame | None) -> dict:
    """A size-checked block of queries as arrays, grouped by wanted language."""
    table = block.toArrow()
    ids = table.column("query_id").to_pylist()
    asked: dict = {
        "type": block.schema["query_id"].dataType.simpleString(),
        "ids": ids,
        "unit": _unit(matrix(table.column("embedding"))),
        "by_language": {},
    }
    wanted = [None] * len(ids)
    if "languages" in table.column_names:
        wanted = table.column("languages").to_pylist()
    asked["open"] = np.array([i for i, x in enumerate(wanted) if x is None], dtype=np.int64)
    for i, names in enumerate(wanted):
        for name in dict.fromkeys(names or []):
            asked["by_language"].setdefault(name, []).append(i)
    asked["by_language"] = {n: np.array(x) for n, x in asked["by_language"].items()}
    if own:
        languages = table.column("own_language").to_pylist()
        asked["own"] = list(zip(languages, table.column("own_row").to_pylist()))
    if cells is not None:
        probed = cells.join(block.select("query_id"), "query_id", "left_semi").toArrow()
        keys = zip(probed.column("query_id").to_pylist(), probed.column("language").to_pylist())
        asked["cells"] = {
            key: np.array(found) for key, found in zip(keys, probed.column("cells").to_pylist())
        }
    return asked


def nearest(
    items: DataFrame,
    queries: DataFrame,
    k: int = C.WEB_RESULTS,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Exact nearest ``k`` per (query, language).

    Optional query columns: ``languages`` limits a query to some languages;
    ``own_language`` and ``own_row`` name a stored row to leave out. With
    ``cells`` (query_id, language, cells) a query only looks at items of
    those cells. The vectors are scanned where they lie; more queries than
    fit one broadcast are answered in hashed blocks, each a pass of its own.
    """
    queries = materialise(queries, "queries")
    own, named = "own_row" in queries.columns, False
    if "languages" in queries.columns:
        # Vectors of languages nobody asks for are not looked at.
        asked = queries.select(F.coalesce("languages", F.array(F.lit(None))).alias("l"))
        asked = asked.select(F.explode("l").alias("language")).distinct()
        named = not asked.filter(F.col("language").isNull()).head(1)
        if named:
            items = items.join(materialise(asked, "languages"), "language", "left_semi")
    size = queries.agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("d")
    ).first()
    # A query costs its vector on the way in and its best rows on the way out.
    n_blocks = -(-size["n"] * max(size["d"], 8 * k) // QUERY_NUMBERS) or 1
    if named and n_blocks > 1:
        # Written before the range sort, which samples its input.
        columns = ["language", "row_index", "embedding", *(["cell"] if cells is not None else [])]
        items = materialise(items.select(columns), "items")
        items = materialise(items.repartitionByRange("language", "row_index"), "items-by-language")
    partials = []
    for block in range(n_blocks):
        part = queries
        if n_blocks > 1:
            part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block)
        asked = _collect_queries(part, own, cells)
        partials.append(_partial_best(items, asked, k, own, cells is not None))
    found = reduce(DataFrame.unionByName, partials)
    # Tasks give at most k rows each; slices of them are cut before the last ranking.
    return top_k(
        found.filter(~F.isnan("distance")),
        ["query_id", "language"], [F.col("distance"), F.col("row_index")], k, ["row_index"],
    )


def _stored_queries(items: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.join(items, ["language", "row_index"]).select(
        "query_id",
        "embedding",
        F.array("language").alias("languages"),
        F.col("language").alias("own_language"),
        F.col("row_index").cast("long").alias("own_row"),
    )


def nearest_to_stored(items: DataFrame, requests: DataFrame, k: int = C.WEB_RESULTS) -> DataFrame:
    """Nearest vectors of the same language to stored rows, self left out.

    ``requests`` has query_id, language and row_index.
    """
    return nearest(items, _stored_queries(items, requests), k)


class VectorIndex:
    """An index of vector cells for approximate search.

    Every vector belongs to the cell of its nearest centre; the stored table
    is laid out by cell, so a search reads only the cells it probes and looks
    at every vector in them. ``probes`` trades speed for recall; probing all
    cells is exact. Cells are shared by all languages; a query goes on to
    further cells of a language until they hold ``k`` of its vectors.
    """

    def __init__(self, table: DataFrame, centres: np.ndarray, sizes: DataFrame):
        self.table = table
        self.centres = centres
        self.sizes = sizes

    @staticmethod
    def build(
        items: DataFrame,
        n_cells: int,
        path: str | None = None,
        seed: int = 0,
        fit_rows_per_cell: int = 256,
    ) -> VectorIndex:
        """Place centres on a share of the vectors, then assign all of them.

        The share only decides where the centres are.
        """
        spark = items.sparkSession
        items = materialise(items, "vectors")  # read by the count, the fit and the layout
        vectors = items.filter(F.exists("embedding", lambda x: x != 0)).withColumn(
            "features", array_to_vector(F.transform("embedding", lambda x: x.cast("double")))
        )
        share = min(1.0, n_cells * fit_rows_per_cell / max(vectors.count(), 1))
        kmeans = KMeans(
            k=n_cells, distanceMeasure="cosine", seed=seed, maxIter=10, predictionCol="cell"
        )
        model = kmeans.fit(vectors.sample(share, seed) if share < 1 else vectors)
        assigned = model.transform(vectors).select("language", "row_index", "embedding", "cell")
        path = path or f"{shared_folder(spark)}/vector-index-{uuid.uuid4().hex}"
        # Rebalancing gathers a small cell into one file and splits a large one.
        assigned.hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(path)
        centres = spark.createDataFrame(
            [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
            "cell int, centre array<double>",
        )
        centres.write.mode("overwrite").parquet(path + "-centres")
        sizes = spark.read.parquet(path).groupBy("language", "cell").agg(F.count("*").alias("n"))
        sizes.write.mode("overwrite").parquet(path + "-sizes")
        return VectorIndex.load(spark, path)

    @staticmethod
    def load(spark, path: str) -> VectorIndex:
        centres = spark.read.parquet(path + "-centres").orderBy("cell").toArrow()
        return VectorIndex(
            spark.read.parquet(path),
            _unit(matrix(centres.column("centre"))),
            spark.read.parquet(path + "-sizes"),
        )

    def _probe(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """Cells to look at per (query, language): the nearest ones that hold
        the language, at least ``probes`` and at least ``k`` vectors."""
        centres = self.centres

        def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                near = np.argsort(-_unit(matrix(batch.column("embedding"))) @ centres.T, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id"), list_column(near.astype(np.int32), pa.int32())],
                    names=["query_id", "order"],
                )

        query_type = queries.schema["query_id"].dataType.simpleString()
        ordered = queries.select("query_id", "embedding").mapInArrow(
            order, f"query_id {query_type}, order array<int>"
        )
        reached = ordered.select("query_id", F.posexplode("order").alias("place", "cell")).join(
            self.sizes, "cell"
        )
        if "languages" in queries.columns:
            wanted = queries.select("query_id", F.col("languages").alias("wanted"))
            reached = reached.join(wanted, "query_id").filter(
                F.col("wanted").isNull() | F.array_contains("wanted", F.col("language"))
            )
        # At most one row per cell and (query, language): a bounded group.
        nearer = Window.partitionBy("query_id", "language").orderBy("place")
        seen = F.sum("n").over(nearer.rowsBetween(Window.unboundedPreceding, -1))
        return (
            reached.withColumn("nth", F.row_number().over(nearer))
            .withColumn("seen", F.coalesce(seen, F.lit(0)))
            .filter((F.col("nth") <= probes) | (F.col("seen") <= k))
            .groupBy("query_id", "language")
            .agg(F.collect_list(F.col("cell").cast("long")).alias("cells"))
        )

    def search(self, queries: DataFrame, k: int = C.WEB_RESULTS, probes: int = 4) -> DataFrame:
        """Nearest ``k`` per (query, language) among the probed cells."""
        queries = materialise(queries, "queries")
        probed = materialise(self._probe(queries, k, probes), "probed")
        # The probed cells (at most the number of cells) prune the folders read.
        wanted = probed.select(F.explode("cells").alias("cell")).distinct().collect()
        table = self.table.filter(F.col("cell").isin([row["cell"] for row in wanted]))
        return nearest(table, queries, k, probed)

    def search_stored(
        self, requests: DataFrame, k: int = C.WEB_RESULTS, probes: int = 4
    ) -> DataFrame:
        """Like :func:`nearest_to_stored`, by the index."""
        return self.search(_stored_queries(self.table, requests), k, probes)
