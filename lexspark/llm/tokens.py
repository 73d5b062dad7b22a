"""Words and word hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text put through numpy at once; a longer text goes alone.
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


@cache
def _powers(log: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, 2**log of them."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(1, dtype=np.uint64)
        while len(p) < 1 << log:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        out.append(p)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    forward, back = _powers(max(16, int(n).bit_length()))
    return forward[:n], back[:n]


def _byte_values(lower: bool) -> np.ndarray:
    values = constants(256, 7)
    if lower:
        values[65:91] = values[97:123]
    return values


VALUES, VALUES_LOWER = _byte_values(False), _byte_values(True)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Words:
    """Words [^ \\t-\\r]+ (or of the bytes that are not in gap) of some texts: hashes, byte starts and ends, and first[i]:first[i+1] for text i."""

    def __init__(self, texts: list[bytes], lower: bool, gap: np.ndarray = SPACE):
        self.data = np.frombuffer(b" ".join([*texts, b""]) if texts else b"", dtype=np.uint8)
        n = len(self.data)
        space = gap[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
        self.starts, self.ends = edges[::2], edges[1::2]
        forward, back = powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((VALUES_LOWER if lower else VALUES)[self.data] * forward[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * back[self.starts])
        self.offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, self.offsets)


    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words as bytes with one blank between them, and the start and end of each word there."""
        space = SPACE[self.data]
        keep = ~space
        keep[1:] |= ~space[:-1]
        place = np.cumsum(keep) - keep
        starts = place[self.starts]
        return np.where(space, np.uint8(32), self.data)[keep], starts, starts + (self.ends - self.starts)


def slices(column: pa.Array, rows: int = 512) -> Iterator[list]:
    """The values of a column as Python objects, some rows at a time."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def steps(texts: list, size: int = STEP) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) for runs of texts of about size bytes; null is empty."""
    at, run, n = 0, [], 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t
        if run and n + len(b) > size:
            yield at, run
            at, run, n = i, [], 0
        run.append(b)
        n += len(b) + 1
    if run:
        yield at, run
