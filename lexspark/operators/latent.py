"""Latent semantic vectors: word counts projected on the directions in which documents vary most, fitted and applied in Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embed import Embedder
from .spread import sliced, spread

#: Places that words are hashed to.
FEATURES = 1 << 14
#: Directions beyond those wanted, tasks of a pass at most (or one a core), rows of the sums that travel together, and cells of a dense block of texts.
MORE, TASKS, BLOCK, CELLS = 16, 64, 256, 1 << 22
_PART = "block int, sums binary"
#: The counts of a slice of texts: texts, where each one's entries end, their places, and how often each is there.
_COUNTED = "n int, ends binary, places binary, counts binary"
#: Counts of a batch: as many rows as there are texts, in the manner of compressed sparse rows.
Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Places(dict):
    """The first 32 bits of the MD5 of each word seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)
        return self[word]


_places = _Places()


def place(word: str, features: int) -> int:
    """Where a word is counted; the first 32 bits of its MD5."""
    return _places[word] % features


def counts(texts: list[str], features: int) -> Sparse:
    """(row, place, count) of the words of texts, by row and place."""
    words = [(t or "").lower().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    at = np.fromiter(map(_places.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum())) % features
    key, n = np.unique(np.repeat(np.arange(len(texts)), n) * features + at, return_counts=True)
    return key // features, key % features, n.astype(np.float64)


def weighted(found: Sparse, n_rows: int, weights: np.ndarray) -> Sparse:
    """Rows of (1 + log count) * weight, scaled to length one; a row without words stays zero."""
    rows, at, n = found
    value = (1 + np.log(n)) * weights[at]
    length = np.sqrt(np.bincount(rows, weights=value * value, minlength=n_rows))
    return rows, at, value / np.maximum(length, 1e-12)[rows]


def projected(found: Sparse, n_rows: int, basis: np.ndarray) -> np.ndarray:
    """The rows times basis, one run of entries a row."""
    rows, at, value = found
    out = np.zeros((n_rows, basis.shape[1]))
    if len(rows):
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        out[rows[first]] = np.add.reduceat(basis[at] * value[:, None], first, axis=0)
    return out


def _counted(texts: DataFrame, features: int) -> DataFrame:
    """The counts of all texts, a row for each slice of a batch; words are looked up here alone."""
    kind = np.uint16 if features <= 1 << 16 else np.uint32

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch.column(0)):
                rows, at, n = counts(part, features)
                n = n.astype(np.min_scalar_type(int(n.max(initial=0))))
                ends = np.searchsorted(rows, np.arange(len(part)), side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ends, at.astype(kind), n))], ["n", "ends", "places", "counts"])

    return texts.mapInArrow(of, _COUNTED)


def _unpacked(batch: pa.RecordBatch, features: int) -> Iterator[tuple[Sparse, int]]:
    """The counts of each slice, and how many texts it has."""
    kind = np.uint16 if features <= 1 << 16 else np.uint32
    for n, *packed in zip(*(batch.column(c) for c in ("n", "ends", "places", "counts")), strict=True):
        ends, places, found = (x.as_buffer() for x in packed)
        at = np.frombuffer(places, kind).astype(np.int64)
        rows = np.repeat(np.arange(n.as_py()), np.diff(np.frombuffer(ends, np.int32), prepend=0))
        yield (rows, at, np.frombuffer(found, f"u{found.size // max(len(at), 1) or 1}").astype(np.float64)), n.as_py()


def gram(found: Sparse, n_rows: int, basis: np.ndarray, total: np.ndarray) -> None:
    """Adds the transposed rows times the rows times basis to total: features by columns of basis. A block of at most CELLS cells is dense at a time."""
    rows, at, value = found
    step = max(1, CELLS // len(basis))
    block = np.zeros((min(step, n_rows), len(basis)), np.float32)
    for first in range(0, n_rows, step):
        a, b = np.searchsorted(rows, (first, first + step))
        block[rows[a:b] - first, at[a:b]] = value[a:b]
        total += block.T @ (block @ basis)
        block[rows[a:b] - first, at[a:b]] = 0


def _summed(counted: DataFrame, features: int, width: int, add: Callable[[Sparse, int, np.ndarray], None]) -> np.ndarray:
    """What add() puts into features by `width` numbers for each slice of texts: summed in each task, then over tasks by block of rows."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features, width))
        for batch in batches:
            for found, n in _unpacked(batch, features):
                add(found, n, total)
        blocks = range(-(-len(total) // BLOCK))
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([total[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in blocks], pa.binary())], ["block", "sums"])

    def sums(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(s) for batch in batches for s in batch.column("sums").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])

    few = counted.coalesce(max(TASKS, counted.sparkSession.sparkContext.defaultParallelism))
    rows = few.mapInArrow(parts, _PART).groupBy("block").applyInArrow(sums, _PART).collect()  # as large as the model
    return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["block"])]).reshape(-1, width) if rows else np.zeros((features, width))


@dataclass(frozen=True)
class Latent:
    """weights: of each place of a word; basis: places by dimensions; strengths: the singular values; n_documents: fitted on so many."""

    weights: np.ndarray
    basis: np.ndarray
    strengths: np.ndarray
    n_documents: int

    @property
    def dim(self) -> int:
        return self.basis.shape[1]

    def embedder(self) -> Embedder:
        """For embed(fn=...): vectors of length one, or zero for texts without known words. The model goes out with the task: 4 bytes a place and dimension."""
        weights, basis = self.weights, self.basis

        def of(texts: list[str]) -> np.ndarray:
            found = weighted(counts(texts, len(weights)), len(texts), weights)
            out = projected(found, len(texts), basis)
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return of


def chosen(docs: DataFrame, text: str, sample: int) -> DataFrame:
    """About `sample` texts, chosen by their hash, or all if there are fewer; equal texts are chosen together. Counts the rows."""
    texts = docs.select(F.col(text).alias("text")).where(F.coalesce(F.col(text), F.lit("")) != "")
    n = texts.count()
    share = (1 << 63) - 1 if n <= sample else int(sample / n * 2**63)
    kept = texts.where(F.shiftrightunsigned(F.xxhash64("text"), 1) < share)
    return kept.coalesce(TASKS) if n > sample else spread(kept)


def fit(docs: DataFrame, text: str = "text", dim: int = 64, features: int = FEATURES, sample: int | None = None, rounds: int = 2, seed: int = 0) -> Latent:
    """The `dim` strongest directions of the weighted word counts of all texts, by randomised range finding with `rounds` rounds of subspace iteration.

    Weights are log((1 + n) / (1 + documents with the word)) + 1. Words are counted once; the counts (3 bytes a word and document at least) are kept,
    in memory or on disk, and a round is one pass over them: each task keeps features by dim + MORE sums (10 MB by default), which are
    added by blocks; the driver sees the sums alone, and orthogonalises them. The same documents give the same directions, up to the
    rounding of sums. sample: fit on about so many texts, for a caller who asks for it. Fails if no document has a text; dim may not exceed features.
    """
    texts = docs.select(F.col(text).alias("text")).where(F.coalesce(F.col(text), F.lit("")) != "") if sample is None else chosen(docs, text, sample)
    counted = _counted(spread(texts), features).persist()
    try:
        n = counted.agg(F.sum("n")).first()[0]
        if not n:
            raise ValueError("no text to fit on")

        def present(found: Sparse, n_rows: int, total: np.ndarray) -> None:
            total[:, 0] += np.bincount(found[1], minlength=features)

        weights = np.log((1 + n) / (1 + _summed(counted, features, 1, present)[:, 0])) + 1
        width = min(dim + MORE, features)
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))[0]
        for _ in range(rounds + 1):

            def step(found: Sparse, n_rows: int, total: np.ndarray, basis: np.ndarray = basis.astype(np.float32)) -> None:
                gram(weighted(found, n_rows, weights), n_rows, basis, total)

            image = _summed(counted, features, width, step)  # the Gram matrix of the places times basis
            small = basis.T @ image
            last, basis = basis, np.linalg.qr(image)[0]
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:dim]
        return Latent(weights, (last @ turn[:, order]).astype(np.float32), np.sqrt(np.maximum(values[order], 0)), n)
    finally:
        counted.unpersist()
