"""Suffix order and common-prefix values of a shard by external induced sorting.

Suffixes that are smaller (S) or larger (L) than their right neighbour induce each other: a scan in suffix order
puts the left neighbour of each suffix into the queue of its first symbol. The queues are priority
queues on (symbol, order of arrival): each is a FIFO, taken in symbol order, filled and emptied in
blocks, and written to disk when the blocks in memory exceed a limit. An entry is a suffix tuple (place,
common prefix with its predecessor in the queue); the value for a new entry is one more than the least value
scanned since the last entry of that queue. The leftmost S suffixes, with which it all starts, are sorted by
inducing their substrings, naming equal ones (compared symbol by symbol) and sorting the string of names, recursively while
that string is longer than a limit, else in memory.

The text, types, seeds, names and orders are files mapped into memory and read and written in blocks, so what a task holds is
bounded by the limits, not by its shard. Files lie in a folder of the task and go with it; a lost task starts anew.

Common prefixes are followed up to a cap; suffixes that agree in that many symbols may come in any order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Tuples in memory before queues go to disk, tuples in a block, names that are sorted in memory.
HELD, BLOCK, BASE = 400_000, 1 << 18, 1_000_000


@dataclass
class Disk:
    """Mapped arrays in a folder, the limits that a sort keeps to, and what it did.

    An array's file has no name once it is mapped, so its space is free as soon as the array is no longer used.
    """

    folder: str
    held: int = HELD
    base: int = BASE
    spilled: int = 0
    depth: int = 0

    def array(self, n: int, kind: type) -> np.ndarray:
        with tempfile.NamedTemporaryFile(dir=self.folder) as file:
            return np.memmap(file.name, dtype=kind, mode="w+", shape=max(n, 1))[:n]

    def gathered(self, blocks: Iterator[np.ndarray], kind: type) -> np.ndarray:
        """All blocks, one after another."""
        with tempfile.NamedTemporaryFile(dir=self.folder) as file:
            n = 0
            for block in blocks:
                file.write(block.astype(kind).tobytes())
                n += len(block)
            file.flush()
            return np.memmap(file.name, dtype=kind, mode="r", shape=n) if n else np.zeros(0, dtype=kind)


def _place(n: int) -> type:
    """The type of places in a text of n symbols."""
    return np.int32 if n < 1 << 31 else np.int64


class Queues:
    """Disk-backed FIFO queues of suffix tuples, one for each symbol."""

    def __init__(self, disk: Disk):
        self.file = tempfile.TemporaryFile(dir=disk.folder)
        self.disk, self.limit, self.held = disk, disk.held, 0
        self.blocks: dict[int, list] = {}
        self.sizes: dict[int, int] = {}

    def push(self, symbol: int, places: np.ndarray, common: np.ndarray) -> None:
        self.blocks.setdefault(symbol, []).append((places, common))
        self.sizes[symbol] = self.sizes.get(symbol, 0) + len(places)
        self.held += len(places)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        """All blocks in memory go to disk, one after another."""
        at = self.file.seek(0, 2)
        for symbol, n in self.sizes.items():
            if n:
                blocks = self.blocks[symbol]
                for i in range(len(blocks) - 1, -1, -1):
                    if len(blocks[i]) != 2:
                        break  # those before it went earlier
                    places, common = blocks[i]
                    self.file.write(places.tobytes() + common.tobytes())
                    blocks[i] = (at, len(places), places.dtype)
                    at += len(places) * (places.itemsize + 1)
                self.sizes[symbol] = 0
        self.disk.spilled += self.held
        self.held = 0

    def _read(self, block: tuple) -> tuple[np.ndarray, np.ndarray]:
        if len(block) == 2:
            return block
        at, n, kind = block
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * kind.itemsize), kind), np.frombuffer(self.file.read(n), np.uint8)

    def symbols(self) -> list[int]:
        return list(self.blocks)

    def pop(self, symbol: int, backward: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All that the queue holds now, in blocks; new entries may come meanwhile."""
        blocks = self.blocks.pop(symbol, [])
        self.held -= self.sizes.pop(symbol, 0)
        run: list = []
        n = 0
        for block in reversed(blocks) if backward else blocks:
            run.append(self._read(block))
            n += len(run[-1][0])
            if n >= BLOCK:
                yield self._joined(run, backward)
                run, n = [], 0
        if run:
            yield self._joined(run, backward)

    @staticmethod
    def _joined(run: list, backward: bool) -> tuple[np.ndarray, np.ndarray]:
        run = run[::-1] if backward else run
        return (run[0] if len(run) == 1 else tuple(np.concatenate(x) for x in zip(*run, strict=True)))


def small_suffixes(text: np.ndarray, disk: Disk) -> np.ndarray:
    """Whether each suffix is smaller than its right neighbour; the last symbol is the unique least one."""
    out = disk.array(len(text), bool)
    out[-1] = later = True
    for end in range(len(text) - 1, 0, -BLOCK):
        begin = max(0, end - BLOCK)
        step = np.sign(text[begin + 1 : end + 1].astype(np.int64) - text[begin:end].astype(np.int64))
        where = np.where(step != 0, np.arange(len(step)), len(step))
        where = np.minimum.accumulate(where[::-1])[::-1]
        out[begin:end] = np.append(step, 1 if later else -1)[where] > 0
        later = bool(out[begin])
    return out


class _Least:
    """Least common prefix since the last entry of each queue."""

    def __init__(self, symbols: int, cap: int):
        self.since, self.cap = np.zeros(symbols, dtype=np.uint8), cap
        self.begun = np.zeros(symbols, dtype=bool)

    def values(self, common: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """For entries made at the scanned places at, sorted by symbol and then place."""
        new = np.concatenate(([True], symbol[1:] != symbol[:-1]))
        low = np.where(new, 0, np.concatenate(([0], at[:-1] + 1)))
        size = at - low + 1
        level = np.frexp(size.astype(np.float64))[1] - 1
        least = np.empty(len(at), dtype=np.uint8)
        table = common
        for k in range(int(level.max()) + 1):
            if k:
                table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
            of = np.flatnonzero(level == k)
            least[of] = np.minimum(table[low[of]], table[at[of] - (1 << k) + 1])
        first = np.flatnonzero(new)
        heads = symbol[first]
        least[first] = np.minimum(least[first], self.since[heads])
        out = np.minimum(least.astype(np.int64) + 1, self.cap).astype(np.uint8)
        out[first[~self.begun[heads]]] = 0
        self.since = np.minimum(self.since, common.min())
        tails = np.minimum.accumulate(common[::-1])[::-1]
        last = at[np.concatenate((first[1:], [len(at)])) - 1] + 1
        self.since[heads] = np.where(last < len(common), tails[np.minimum(last, len(common) - 1)], self.cap)
        self.begun[heads] = True
        return out

    def skip(self, common: np.ndarray) -> None:
        self.since = np.minimum(self.since, common.min())


def _prefix(text: np.ndarray, a: int, b: int, cap: int) -> int:
    x, y = text[a : a + cap], text[b : b + cap]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def _induce(text, small, queues: Queues, places, common, want_small: bool, least: _Least | None) -> None:
    """Queue the left neighbours, of the wanted kind, of scanned suffixes."""
    left = places - 1
    at = np.flatnonzero((places > 0) & (small[left] == want_small))
    if not len(at):
        if least is not None:
            least.skip(common)
        return
    symbol = text[left[at]]
    order = np.argsort(symbol, kind="stable")
    at, symbol = at[order], symbol[order].astype(np.int64)
    values = np.zeros(len(at), dtype=np.uint8) if least is None else least.values(common, at, symbol)
    left = left[at]
    cuts = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1], [True])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        queues.push(int(symbol[a]), left[a:b], values[a:b])


def _by_symbol(text: np.ndarray, places: np.ndarray, disk: Disk) -> tuple[np.ndarray, np.ndarray]:
    """places grouped by their symbol, in order within each group, and the bounds of the groups."""
    top = 1 + max(int(text[i : i + BLOCK].max()) for i in range(0, len(text), BLOCK))
    counts = np.zeros(top + 1, dtype=np.int64)
    for i in range(0, len(places), BLOCK):
        counts[1:] += np.bincount(text[places[i : i + BLOCK]], minlength=top)
    bounds = np.cumsum(counts)
    out, free = disk.array(len(places), _place(len(text))), bounds[:-1].copy()
    for i in range(0, len(places), BLOCK):
        block = places[i : i + BLOCK]
        symbol = text[block].astype(np.int64)
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order]
        first = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
        sizes = np.diff(np.concatenate((first, [len(symbol)])))
        out[free[symbol] + np.arange(len(symbol)) - np.repeat(first, sizes)] = block[order]
        free[symbol[first]] += sizes
    return out, bounds


def _sweep(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, bounds: np.ndarray, seed_common: np.ndarray | None, cap: int, disk: Disk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order with their common prefix with the one before; cap 0: without those.

    seeds: leftmost S suffixes, grouped by symbol (bounds), in the order that they shall have in their groups.
    """
    top = len(bounds) - 1
    counts = np.zeros(top, dtype=np.int64)
    for i in range(0, len(text), BLOCK):
        counts += np.bincount(text[i : i + BLOCK], minlength=top)
    present = np.flatnonzero(counts).tolist()
    queues, large = Queues(disk), Queues(disk)
    least = _Least(top, cap) if cap else None
    for c in present:
        last = -1
        while c in queues.blocks:
            for places, common in queues.pop(c):
                last = int(places[-1])
                large.push(c, places, common)
                _induce(text, small, queues, places, common, False, least)
        a, b = int(bounds[c]), int(bounds[c + 1])
        for i in range(a, b, BLOCK):
            places = np.array(seeds[i : min(b, i + BLOCK)])
            common = np.zeros(len(places), dtype=np.uint8) if seed_common is None else np.array(seed_common[i : min(b, i + BLOCK)])
            if i == a:
                common[0] = _prefix(text, last, int(places[0]), cap) if last >= 0 and cap else 0
            _induce(text, small, queues, places, common, False, least)
    least = _Least(top, cap) if cap else None
    for c in reversed(present):
        last = -1
        while c in queues.blocks:
            for places, common in queues.pop(c):
                last = int(places[-1])
                yield places, common
                _induce(text, small, queues, places, common, True, least)
        incoming = -1
        for places, common in large.pop(c, backward=True):
            if incoming < 0:
                incoming = _prefix(text, last, int(places[-1]), cap) if last >= 0 and cap else 0
            places, turned = places[::-1], np.concatenate(([incoming], common[:0:-1])).astype(np.uint8)
            incoming = int(common[0])
            yield places, turned
            _induce(text, small, queues, places, turned, True, least)
        if c == 0:  # the last suffix induces in the first scan only; here it ends the order
            yield np.array([len(text) - 1], dtype=_place(len(text))), np.zeros(1, dtype=np.uint8)


def _doubling(names: np.ndarray, cap: int) -> np.ndarray:
    """Suffixes of names in order by cap names at least, by prefix doubling in memory."""
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    size = 1
    while True:
        further = np.concatenate((rank[size:] + 1, np.zeros(min(size, len(rank)), dtype=np.int64)))[: len(rank)]
        key = rank * (len(rank) + 2) + further
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([False], key[order][1:] != key[order][:-1]))
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new)
        size *= 2
        if size >= cap or rank[order[-1]] == len(rank) - 1:
            return order


def _differ(text: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether text[a:a_end + 1] and text[b:b_end + 1] differ, pair by pair."""
    out = (a_end - a) != (b_end - b)
    going = np.flatnonzero(~out)
    k = 0
    while len(going):
        unlike = text[a[going] + k] != text[b[going] + k]
        out[going[unlike]] = True
        going = going[~unlike]
        k += 1
        going = going[a[going] + k <= a_end[going]]
    return out


def _backward(blocks: Iterator[np.ndarray], n: int, kind: type, disk: Disk) -> np.ndarray:
    """The n values of blocks in reverse."""
    out = disk.array(n, kind)
    for block in blocks:
        out[n - len(block) : n] = block[::-1]
        n -= len(block)
    return out


def _order_seeds(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, cap: int, disk: Disk) -> np.ndarray:
    """The leftmost S suffixes (given by place) in suffix order."""
    grouped, bounds = _by_symbol(text, seeds, disk)
    is_seed = disk.array(len(text), bool)
    for i in range(0, len(seeds), BLOCK):
        is_seed[seeds[i : i + BLOCK]] = True
    found = (places[is_seed[places]] for places, _ in _sweep(text, small, grouped, bounds, None, 0, disk))
    induced = _backward(found, len(seeds), seeds.dtype, disk)
    names, name = disk.array(len(seeds), np.int32), 0
    before = None
    for i in range(0, len(seeds), BLOCK):
        place = np.array(induced[i : i + BLOCK])
        number = np.searchsorted(seeds, place)
        end = np.where(number + 1 < len(seeds), seeds[np.minimum(number + 1, len(seeds) - 1)], place)
        if before is None:
            before = place[:1], end[:1]
        a, a_end = np.concatenate((before[0], place[:-1])), np.concatenate((before[1], end[:-1]))
        new = _differ(text, a, a_end, place, end)
        names[number] = name + np.cumsum(new)
        name += int(new.sum())
        before = place[-1:], end[-1:]
    if name == len(seeds) - 1:
        return induced
    if len(names) <= disk.base:
        return seeds[_doubling(np.array(names), cap)]
    # The last seed is the last symbol: its name is the unique least, as the string of names needs.
    return _backward((seeds[places] for places, _ in descending(names, 0, disk, depth=cap)), len(seeds), seeds.dtype, disk)


def _seeds(small: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(0, len(small) - 1, BLOCK):
        step = small[i : i + BLOCK + 1]
        yield np.flatnonzero(step[1:] & ~step[:-1]) + i + 1


def _common(text: np.ndarray, ordered: np.ndarray, cap: int, disk: Disk) -> np.ndarray:
    """Common prefixes, up to cap, of each place with the one before."""
    out = disk.array(len(ordered), np.uint8)
    for i in range(1, len(ordered), BLOCK):
        b, a = ordered[i : i + BLOCK], ordered[i - 1 : i - 1 + len(ordered[i : i + BLOCK])]
        going = np.arange(len(b))
        for k in range(cap):
            x, y = b[going] + k, a[going] + k
            fine = (x < len(text)) & (y < len(text))
            going, x, y = going[fine], x[fine], y[fine]
            going = going[text[x] == text[y]]
            out[i + going] = k + 1
            if not len(going):
                break
    return out


def descending(text: np.ndarray, cap: int, disk: Disk, depth: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefix with the suffix before, up to cap) of all suffixes, largest first, in blocks.

    The last symbol must be 0 and occur nowhere else.
    """
    disk.depth += 1
    small = small_suffixes(text, disk)
    seeds = disk.gathered(_seeds(small), _place(len(text)))
    if not len(seeds):
        seeds = np.array([len(text) - 1], dtype=_place(len(text)))
    ordered = _order_seeds(text, small, seeds, depth or max(cap, 1), disk) if len(seeds) > 1 else seeds
    del seeds
    _, bounds = _by_symbol(text, ordered, disk)  # suffixes in order are grouped by symbol already
    yield from _sweep(text, small, ordered, bounds, _common(text, ordered, cap, disk) if cap else None, cap, disk)
