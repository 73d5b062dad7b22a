"""Substring dedup on bytes, by suffix sorting.

Stretches of windows (see repeats) bring together the places that can share a 50-byte string. The
different ones of each anchor are put one after another into shards, whose suffixes are sorted by external
induced sorting on disk; suffixes that have 50 bytes in common are neighbours there, and the least doc_id among
them keeps its bytes. Equal windows have equal anchors, so a shard is sorted in runs of whole anchors, which are so short that the
names of a sort fit in memory; only a single anchor with more goes deeper.

Edge cases: null text is empty; a text shorter than 50 bytes is untouched; a very long text is read whole, in steps; rows
that share a doc_id do not remove each other's bytes, and equal rows get equal results; of documents that tie the smallest doc_id keeps
its bytes; null doc_id counts as the largest; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, induced, repeats

#: Stretches that are put into a shard's text at once.
STEP = 1 << 14


def _shard_text(bodies: list[bytes], sizes: np.ndarray, disk: induced.Disk) -> tuple[np.ndarray, np.ndarray]:
    """The text of a shard: bytes + 2, 1 after each body, 0 at the end; and where each body begins."""
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    text = disk.array(int(sizes.sum()) + len(bodies) + 1, np.uint16)
    for i in range(0, len(bodies), STEP):
        data = np.frombuffer(b"".join(bodies[i : i + STEP]), dtype=np.uint8).astype(np.uint16) + np.uint16(2)
        n = sizes[i : i + STEP]
        at = np.arange(len(data)) + np.repeat(np.arange(len(n)), n) + begins[i]
        text[begins[i] + np.cumsum(n + 1) - 1] = 1
        text[at] = data
    text[-1] = 0
    return text, begins


def shared_windows(owner: np.ndarray, n: np.ndarray, bodies: list[bytes], window: int, disk: induced.Disk) -> np.ndarray:
    """Which windows of stretches also start in a stretch with a smaller owner.

    Stretch i has n[i] windows and n[i] + window - 1 bytes; the result is flat, n[0] + n[1] + ...
    """
    text, begins = _shard_text(bodies, n + window - 1, disk)
    flat = np.cumsum(n) - n
    out = disk.array(int(n.sum()), bool)

    def close(stretch: np.ndarray, numbers: np.ndarray, group: np.ndarray) -> None:
        ids = owner[stretch]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        least = np.minimum.reduceat(ids, first)
        out[numbers] = ids > np.repeat(least, np.diff(np.concatenate((first, [len(ids)]))))

    kept = (np.zeros(0, dtype=np.int64),) * 3
    last = 0
    for places, shared in induced.descending(text, window, disk):
        group = np.cumsum(shared < window) + last
        last = int(group[-1])
        stretch = np.searchsorted(begins, places, side="right") - 1
        offset = places - begins[stretch]
        mine = offset < n[stretch]  # a window starts here
        mine[places == len(text) - 1] = False
        found = stretch[mine], (flat[stretch] + offset)[mine], group[mine]
        found = tuple(np.concatenate(x) for x in zip(kept, found, strict=True))
        open_ = found[2] == last  # may go on in the next block
        if not open_.all():
            close(*(x[~open_] for x in found))
        kept = tuple(x[open_] for x in found)
    if len(kept[0]):
        close(*kept)
    return out


def runs_of_anchors(anchors: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of whole anchors (equal ones stand together) of at most `most` symbols, or of one anchor."""
    ends = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(anchors))
    total = np.cumsum(sizes)[ends - 1]
    begin, k = 0, -1
    while begin < len(anchors):
        done = total[k] if begin else 0
        k = max(int(np.searchsorted(total, done + most, side="right")) - 1, k + 1)
        yield begin, int(ends[k])
        begin = int(ends[k])


def _find(kind: repeats.Kind, held: int, base: int) -> repeats.Find:
    def of(s: repeats.Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = []
        # A text has at most half as many names as symbols, of which each stretch has its own and one between.
        for a, b in runs_of_anchors(s.anchors, s.n + kind.window, 2 * base):
            with tempfile.TemporaryDirectory() as folder:  # the task's own; a lost task starts anew
                found = np.array(shared_windows(s.ids[a:b], s.n[a:b], s.bodies[a:b], kind.window, induced.Disk(folder, held, base)))
            stretch, first, n = repeats.runs_of(found, s.n[a:b])
            out.append((stretch + a, first, n))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return of


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _apply(digest: bool):
    def of(kind: repeats.Kind, table: pa.Table, marks: pa.Table) -> pa.Table:
        ids, _, texts, rows = repeats.texts_of(table)
        bounds = np.cumsum([0, *map(len, texts)])
        gone = repeats.covered(marks, bounds, rows, kind.window)
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        out = []
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            mine = gone[a:b]
            removed = int(np.count_nonzero(mine))
            spans = int(np.count_nonzero(mine[1:] & ~mine[:-1]) + mine[0]) if removed else 0
            kept = data[a:b][~mine].tobytes() if removed else texts[i]
            out.append((b - a, removed, spans, hashlib.sha256(kept).digest() if digest else kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
        return pa.table([repeats.doc_ids(ids), *columns], [x.split()[0] for x in _RESULT.split(", ")])

    return of


def remove_substrings(docs: DataFrame, digest: bool = False, held: int = induced.HELD, base: int = induced.BASE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: the bytes left of each text, or with digest their SHA-256.

    held, base: suffix tuples and names that a sort keeps in memory.
    """
    return repeats.removals(docs, repeats.BYTES, _find(repeats.BYTES, held, base), _apply(digest), _RESULT)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = remove_substrings(common.documents(spark, sf_dir), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
