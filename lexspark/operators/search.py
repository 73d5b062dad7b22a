"""Batch vector search: a table of queries against collections of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_K, MAX_K = 10, 50
#: Queries of one block, and points of one block; what a task or a closure holds is bounded by them.
QUERY_BLOCK, POINT_BLOCK = 1024, 8192
#: Bytes of packed query blocks up to which they may be sent to every executor.
BROADCAST_BYTES = 48 << 20


def top_k(scored: DataFrame, k: int, query: str = "query_id", ties: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """The k best rows of each query with their rank, ties in the given order."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}")
    order = Window.partitionBy(query).orderBy(F.desc("score"), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _lengths(vectors: pa.Array) -> np.ndarray:
    """The length of each vector; null has none."""
    return np.nan_to_num(pc.list_value_length(vectors).to_numpy(zero_copy_only=False), nan=0).astype(np.int64)


def _unit(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows whose vector has this dimension and is not zero, in order of their ids."""
    own = ids.to_numpy(zero_copy_only=False)
    fine = np.flatnonzero(_lengths(vectors) == dim)
    matrix = vectors.take(pa.array(fine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norms = np.linalg.norm(matrix, axis=1)
    fine, matrix, norms = fine[norms > 0], matrix[norms > 0], norms[norms > 0]
    order = np.argsort(own[fine], kind="stable")
    return own[fine][order], (matrix / norms[:, None])[order]


def _by_dimension(ids: pa.Array, vectors: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, unit vectors) for each dimension that the vectors have."""
    return [(dim, *_unit(ids, vectors, dim)) for dim in np.unique(_lengths(vectors)).tolist() if dim]


def _best(queries: np.ndarray, points: np.ndarray, k: int, threshold: float | None, rows: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of the k best points of each query, ties by the order of points; a few queries at a time."""
    out = []
    for at in range(0, len(queries), rows):
        scores = np.round(queries[at : at + rows] @ points.T, 12)
        least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -2.0)
        least = np.maximum(least, -2.0 if threshold is None else threshold)
        q, p = np.nonzero(scores >= least[:, None])
        order = np.lexsort((p, -scores[q, p], q))
        q, p = q[order], p[order]
        first = np.searchsorted(q, q)
        on = np.arange(len(q)) - first < k
        out.append((q[on] + at, p[on], scores[q[on], p[on]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | pa.Buffer) -> list[pa.Array]:
    """Ids and vectors."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns]


def _results(query_ids: np.ndarray, point_ids: np.ndarray, found: tuple, schema: pa.Schema) -> pa.RecordBatch:
    q, p, score = found
    return pa.RecordBatch.from_arrays([pa.array(query_ids[q], schema.field(0).type), pa.array(point_ids[p], schema.field(1).type), pa.array(score)], schema=schema)


def _schemas(queries: DataFrame, points: DataFrame) -> tuple[T.StructType, pa.Schema]:
    q, p = queries.schema["query_id"].dataType, points.schema["point_id"].dataType
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    spark = T.StructType([T.StructField("query_id", q), T.StructField("point_id", p), T.StructField("score", T.DoubleType())])
    return spark, pa.schema([("query_id", kinds[q.simpleString()]), ("point_id", kinds[p.simpleString()]), ("score", pa.float64())])


def _in_blocks(queries: DataFrame, points: DataFrame, n: int, k: int, threshold: float | None) -> DataFrame:
    """Every block of queries against every block of points, on the executors; each pair gives k rows a query."""
    spark, arrow = _schemas(queries, points)
    block = F.pmod(F.xxhash64("query_id"), F.lit(-(-n // QUERY_BLOCK))).alias("block")

    def pack_group(table: pa.Table) -> pa.Table:
        return pa.table([pa.array([_packed(table.select(["query_id", "embedding"]))], pa.binary())], ["asked"])

    def pack_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, POINT_BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([_packed(pa.Table.from_batches([batch.slice(at, POINT_BLOCK)]))], pa.binary())], ["stored"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, stored in zip(batch.column("asked"), batch.column("stored"), strict=True):  # read where they lie in the batch
                points_of = _unpacked(stored.as_buffer())
                for dim, query_ids, q in _by_dimension(*_unpacked(asked.as_buffer())):
                    point_ids, p = _unit(*points_of, dim)
                    if len(q) and len(p):
                        yield _results(query_ids, point_ids, _best(q, p, k, threshold), arrow)

    asked = queries.select("query_id", "embedding", block).groupBy("block").applyInArrow(pack_group, "asked binary")
    stored = points.mapInArrow(pack_points, "stored binary")
    width = queries.agg(F.max(F.size("embedding"))).first()[0] or 1
    asked = F.broadcast(asked) if n * width * 8 <= BROADCAST_BYTES else asked
    return stored.crossJoin(asked).mapInArrow(score, spark)


def vector_search(queries: DataFrame, points: DataFrame, k: int = DEFAULT_K, condition: Column | None = None, threshold: float | None = None) -> DataFrame:
    """(query_id, point_id, score, rank). queries: query_id, embedding; points: point_id, embedding and filter columns.

    One block of queries goes out with the tasks, each of which keeps k rows a query; more queries are paired
    with the points block by block on the executors. Only the rows kept are shuffled. Ids may be numbers or
    strings. A query meets the points of its own dimension; null and zero vectors score nothing.
    """
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}")
    found = points.where(condition) if condition is not None else points
    found, asked = found.select("point_id", "embedding"), queries.select("query_id", "embedding").where("embedding IS NOT NULL")
    block = asked.limit(QUERY_BLOCK + 1).toArrow()
    if block.num_rows > QUERY_BLOCK:
        return top_k(_in_blocks(asked, found, asked.count(), k, threshold), k)
    spark, arrow = _schemas(queries, points)
    block = block.combine_chunks()
    by_dimension = _by_dimension(*(c.chunk(0) for c in block.columns)) if block.num_rows else []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, query_ids, matrix in by_dimension:
                point_ids, p = _unit(batch.column("point_id"), batch.column("embedding"), dim)
                if len(p) and len(matrix):
                    yield _results(query_ids, point_ids, _best(matrix, p, k, threshold), arrow)

    return top_k(found.mapInArrow(score, spark), k)


def tagged(results: dict[str, DataFrame]) -> DataFrame:
    """All rows of several collections with their collection's name as type; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("type", F.lit(name)) for name, df in results.items()])


def merge_collections(results: dict[str, DataFrame], k: int = DEFAULT_K) -> DataFrame:
    """The k best of several collections' results with a type tag; ties in the order of the collections, then by rank."""
    both = tagged({name: df.withColumn("__order", F.lit(i)) for i, (name, df) in enumerate(results.items())}).withColumnRenamed("rank", "__rank")
    return top_k(both, k, ties=("__order", "__rank")).drop("__order", "__rank")


def first_of_document(results: DataFrame) -> DataFrame:
    """The best chunk of each document of a result set."""
    w = Window.partitionBy("query_id", "document_id").orderBy("rank")
    return results.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def hint_gate(results: DataFrame, max_results: int = 3, min_score: float = 0.4) -> DataFrame:
    """Results of queries with few results of which the best is good."""
    w = Window.partitionBy("query_id")
    gated = results.withColumn("__n", F.count("*").over(w)).withColumn("__top", F.max("score").over(w))
    return gated.where((F.col("__n") <= max_results) & (F.col("__top") >= min_score)).drop("__n", "__top")
