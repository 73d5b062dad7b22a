"""Token counters for chunking: four characters a token, or byte pairs by a rank table."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.spread import sliced

# Fixed value: how a public byte-level vocabulary cuts texts into words before pairs are merged.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose counts are kept in a worker, and the longest of them in bytes.
KEPT, LONGEST = 200_000, 64


def quarter(text: str) -> int:
    """Four characters a token."""
    return len(text) // 4


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank table: a line for each token, in base64, and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a word: again and again the pair of neighbours with the least rank, leftmost first, becomes one.

    Neighbours are linked, and pairs wait in a queue by rank and place; a pair that has changed since it was put there is passed over. So
    a word of n bytes takes n log n steps, however long it is.
    """
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    waiting: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(parts):
            pair = parts[i] + parts[after[i]]
            if pair in ranks:
                heapq.heappush(waiting, (ranks[pair], i, pair))

    for i in range(len(parts) - 1):
        offer(i)
    while waiting:
        _, i, pair = heapq.heappop(waiting)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j], after[i] = pair, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


class RankCounter:
    """Counts tokens by a rank table, which goes to the tasks with the counter; words that recur are counted once a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = WORDS):
        self.ranks, self.pattern, self._known, self._words = ranks, pattern, {}, None

    @classmethod
    def of_file(cls, path: str, pattern: str = WORDS) -> RankCounter:
        """The file is read on the driver."""
        return cls(read_ranks(path), pattern)

    def __getstate__(self) -> tuple:
        return self.ranks, self.pattern

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _count(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        n = 1 if raw in self.ranks else len(merged(raw, self.ranks))
        if len(raw) <= LONGEST:
            if len(self._known) >= KEPT:
                self._known.clear()
            self._known[word] = n
        return n

    def __call__(self, text: str) -> int:
        self._words = self._words or regex.compile(self.pattern)
        known = self._known
        return sum(known.get(w) or self._count(w) for w in self._words.findall(text))


def counted(texts: pa.Array, counter: Callable[[str], int]) -> pa.Array:
    """Tokens of each text of a batch, of which a slice at a time is in Python's hands."""
    return pa.array([counter(t) if t else 0 for part in sliced(texts) for t in part], pa.int64())


def token_counts(spark, text: Column, counter: RankCounter) -> Column:
    """Tokens of each text; null has none. The table is sent to each executor once."""
    shared = spark.sparkContext.broadcast(counter)

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return counted(texts, shared.value)

    return of(text)
