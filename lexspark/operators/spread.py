"""Parallelism of CPU-bound text work, and how much of a batch is in Python's hands at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a split that keeps a core busy for a while.
SPLIT = 16 << 20
#: Rows and bytes of a slice: Spark's batches hold up to 10,000 rows, which as Python objects take many times their bytes.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20
#: What leaves the rows of a task as they are dealt.
_ROW_BY_ROW = ("Project", "Filter", "SubqueryAlias", "View")


def _below(df: DataFrame):
    """The plan's first node that is no projection or filter."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in _ROW_BY_ROW:
        node = node.children().apply(0)
    return node


def _bytes(node) -> int:
    return int(str(node.stats().sizeInBytes()))


def tasks_of(df: DataFrame, split: int = SPLIT) -> int:
    """Tasks of at most about `split` bytes of the input that df reads row by row, and one for each core at least."""
    cores, below = df.sparkSession.sparkContext.defaultParallelism, _below(df)
    return max(cores, -(-_bytes(below) // split)) if below.children().isEmpty() and below.nodeName() == "LogicalRelation" else cores


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, in tasks of at most SPLIT bytes of input, however large the files' row groups are. Runs nothing.

    What is dealt out already stays so; of other inputs only those that are too small by the optimizer's estimate to have a split for each core are dealt.
    """
    below = _below(df)
    if below.nodeName().startswith("Repartition"):
        return df
    if below.children().isEmpty() and below.nodeName() == "LogicalRelation":
        return df.repartition(tasks_of(df, SPLIT))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _bytes(df._jdf.queryExecution().optimizedPlan()) < cores * SPLIT else df


def slices(n_rows: int, n_bytes: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of the slices of a batch of so many rows and bytes; all of its rows, of at most about SLICE_BYTES each."""
    step = max(1, min(SLICE_ROWS, SLICE_BYTES * n_rows // max(n_bytes, 1)))
    for at in range(0, n_rows, step):
        yield at, min(step, n_rows - at)


def sliced(column: pa.Array) -> Iterator[list]:
    """The values of a column as Python objects, a slice at a time."""
    for at, n in slices(len(column), column.nbytes):
        yield column.slice(at, n).to_pylist()
