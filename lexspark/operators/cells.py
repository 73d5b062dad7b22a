"""An inverted file of vectors: cells around centroids, of which a search reads those nearest to its queries.

The centroids are fitted on a bounded sample (SAMPLE vectors at most); every vector is put into the cell of its nearest centroid, and the table is
partitioned by cell, so cells that no query asks for are not read. A filter applies inside the cells. Null vectors and those of another dimension than
the centroids' are in a cell of their own, where queries of other dimensions look. With as many probes as cells the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import search

SAMPLE, MOST_CELLS, ROUNDS, OTHER = 50_000, 4096, 8, -1


def fit_centroids(vectors: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means; a cell that gets none starts anew at the vector worst served."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(rounds):
        near = [vectors[i : i + 4096] @ centroids.T for i in range(0, len(vectors), 4096)]
        cell, best = (np.concatenate([f(x, axis=1) for x in near]) for f in (np.argmax, np.max))
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, vectors)
        empty = np.flatnonzero(np.bincount(cell, minlength=len(centroids)) == 0)
        sums[empty] = vectors[np.argsort(best, kind="stable")[: len(empty)]]
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


@dataclass(frozen=True)
class Cells:
    """A table of points with their cell, and the centroids."""

    points: DataFrame
    centroids: np.ndarray

    def nearest(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The cells nearest to each vector."""
        near = vectors @ self.centroids.T
        probes = min(probes, len(self.centroids))
        return np.argpartition(-near, probes - 1, axis=1)[:, :probes]


def _cells_of(ids: pa.Array, vectors: pa.Array, centroids: np.ndarray, probes: int) -> list[list[int]]:
    """The nearest cells of each row; OTHER for those that fit no centroid."""
    out: list[list[int]] = [[OTHER]] * len(ids)
    place = pa.array(np.arange(len(ids)))
    rows, units = search._unit(place, vectors, centroids.shape[1])
    found = Cells(None, centroids).nearest(units, probes) if len(rows) else []
    for i, cells in zip(rows.tolist(), found, strict=True):
        out[i] = cells.tolist()
    return out


def build_cells(points: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """Index points (point_id, embedding, filter columns) under path, a folder that all executors share."""
    n = points.count()
    place = F.xxhash64(F.lit("cells"), "point_id").cast("double") / float(1 << 63)
    share = 2.0 * sample / max(1, n) - 1.0
    chosen = (points.where(place < share) if share < 1 else points).where("embedding IS NOT NULL").select("embedding").limit(2 * sample).toArrow().combine_chunks()
    vectors = chosen.column("embedding").chunk(0) if chosen.num_rows else pa.array([], pa.list_(pa.float64()))
    by_dimension = search._by_dimension(pa.array(np.arange(len(vectors))), vectors)
    _, _, units = max(by_dimension, key=lambda x: len(x[1]), default=(1, None, np.ones((1, 1))))
    centroids = fit_centroids(units, cells or min(MOST_CELLS, max(1, int(len(units) ** 0.5)))) if len(units) else np.ones((1, 1))
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = [c[0] for c in _cells_of(batch.column("point_id"), batch.column("embedding"), shared.value, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType())])
    points.mapInArrow(of, schema).repartition("cell", F.pmod(F.xxhash64("point_id"), F.lit(1 + n // (1_000_000 * max(1, len(centroids)))))).write.partitionBy("cell").parquet(path)
    return Cells(points.sparkSession.read.schema(schema).parquet(path), centroids)


def asked_cells(queries: DataFrame, index: Cells, probes: int) -> DataFrame:
    """query_id, embedding, cell: a row for each cell that a query looks into."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _cells_of(batch.column("query_id"), batch.column("embedding"), shared.value, probes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    asked = queries.select("query_id", "embedding").where("embedding IS NOT NULL")
    found = asked.mapInArrow(of, T.StructType([*asked.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))
    return found.select("query_id", "embedding", F.explode("cells").alias("cell"))


def indexed_search(queries: DataFrame, index: Cells, k: int = search.DEFAULT_K, condition: Column | None = None, threshold: float | None = None, probes: int = 8) -> DataFrame:
    """(query_id, point_id, score, rank) of the k best points in the probed cells.

    Blocks of queries meet blocks of points of their cell in one equi-join, each pair giving k rows a query; Spark sends the queries' blocks out or
    shuffles both, by their size, and cells without a query are pruned from the scan where it sends them.
    """
    spark, arrow = search._schemas(queries, index.points)

    def pack_queries(table: pa.Table) -> pa.Table:
        return pa.table([table.column("cell").slice(0, 1), pa.array([search._packed(table.select(["query_id", "embedding"]))], pa.binary())], ["cell", "asked"])

    def pack_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            for cell in np.unique(cells).tolist():
                own = pa.Table.from_batches([batch]).take(pa.array(np.flatnonzero(cells == cell))).select(["point_id", "embedding"])
                for at in range(0, own.num_rows, search.POINT_BLOCK):
                    block = own.slice(at, search.POINT_BLOCK).combine_chunks()
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([search._packed(block)], pa.binary())], ["in_cell", "stored"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, stored in zip(batch.column("asked"), batch.column("stored"), strict=True):  # read where they lie in the batch
                points_of = search._unpacked(stored.as_buffer())
                for dim, query_ids, q in search._by_dimension(*search._unpacked(asked.as_buffer())):
                    point_ids, p = search._unit(*points_of, dim)
                    if len(q) and len(p):
                        yield search._results(query_ids, point_ids, search._best(q, p, k, threshold), arrow)

    wanted = asked_cells(queries, index, probes)
    cells = [r["cell"] for r in wanted.select("cell").distinct().collect()]  # as many as there are centroids at most
    points = index.points.where(F.col("cell").isin(cells))
    points = points.where(condition) if condition is not None else points
    block = F.pmod(F.xxhash64("query_id"), F.lit(1 + wanted.count() // (search.QUERY_BLOCK * max(1, len(cells)))))
    asked = wanted.withColumn("block", block).groupBy("cell", "block").applyInArrow(pack_queries, "cell int, asked binary")
    stored = points.select("cell", "point_id", "embedding").mapInArrow(pack_points, "in_cell int, stored binary")
    pairs = stored.join(asked, F.col("in_cell") == F.col("cell")).select("asked", "stored")
    return search.top_k(pairs.mapInArrow(score, spark), k)


def scanned_share(queries: DataFrame, index: Cells, probes: int = 8) -> float:
    """Of all points, the share that lies in cells which some query looks into."""
    cells = [r["cell"] for r in asked_cells(queries, index, probes).select("cell").distinct().collect()]
    n, seen = index.points.agg(F.count("*"), F.count_if(F.col("cell").isin(cells))).first()
    return seen / n if n else 0.0
