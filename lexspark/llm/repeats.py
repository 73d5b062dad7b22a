"""Finding windows of symbols (bytes or words) that occur again, over a whole corpus.

Each window of L symbols has an anchor: its least k-gram by hash, the leftmost of equals. Equal windows have
equal anchors at equal offsets. Consecutive windows with the same anchor occurrence are one stretch, so a
stretch stands for many windows and only stretches are shuffled:

1. scan: stretches of every text, packed by the hash of their anchor. Copies of a stretch that a task has seen, compared byte by
   byte, are marked as repeats at once, whatever their number;
2. match: a stretch whose anchor occurs nowhere else has no window that occurs again, and goes no further. This
   is all that hashes decide;
3. fetch: the bytes of all other stretches are read from their documents and dealt to shards by their anchors;
4. compare: in a shard equal stretches are found by their bytes. Where an anchor has several different ones, the caller (suffix
   sorting or suffix trees) finds the windows that they share;
5. apply: all marks of a document are brought to it.

An anchor with more than HOT stretches is split by content: its stretches are dealt window by window, by the hash of each
window's bytes, and of equal windows of a bucket of documents only the first is dealt. Marks and requests are packed arrays
for buckets of documents; both document reads use one exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Bytes of text whose stretches one match task gets, in a bucket of documents, and whose stretches a shard gets.
PART_BYTES, BUCKET_BYTES, SHARD_BYTES = 16 << 20, 8 << 20, 12 << 20
#: Stretches from which an anchor is split by content.
HOT = 50_000
#: Stretches, and bytes of documents, that a task packs at once.
FLUSH, PACKED_BYTES = 300_000, 12 << 20
NO_ID = np.iinfo(np.int64).max
MARK, ENTRY, REQUEST, SPLIT, BODY = range(5)
_PLACE_BITS, _ANCHOR_BITS = 31, 48
MESSAGE = "part int, kind int, data binary"
_MESSAGE = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


@dataclass(frozen=True)
class Kind:
    """What a symbol is: window and anchor lengths, and whether a document's own earlier window counts."""

    window: int
    anchor: int
    words: bool
    within: bool


BYTES, WORDS = Kind(50, 20, words=False, within=False), Kind(20, 6, words=True, within=True)


@dataclass
class Stream:
    """Texts put one after another: symbol bounds of each, anchor hashes, prefix sums of a rolling hash, bytes of each symbol."""

    bounds: np.ndarray
    anchors: np.ndarray
    sums: np.ndarray
    back: np.ndarray
    data: np.ndarray
    low: np.ndarray
    high: np.ndarray


def stream(texts: list[bytes], kind: Kind) -> Stream:
    multipliers = tokens.constants(max(3, kind.anchor), 21)
    if kind.words:
        words = tokens.Words(texts, lower=False)
        symbols, values, bounds = words.hashes, words.hashes, words.first
        data, low, high = words.joined()
        n = max(0, len(symbols) - kind.anchor + 1)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(kind.anchor):
            h += symbols[k : k + n] * multipliers[k]
    else:
        symbols = np.frombuffer(b"".join(texts), dtype=np.uint8)
        values, bounds = tokens.VALUES[symbols], np.cumsum([0, *map(len, texts)])
        data, low = symbols, np.arange(len(symbols))
        high = low + 1
        n = max(0, len(symbols) - kind.anchor + 1)
        eight = np.ndarray((max(0, len(symbols) - 7),), "<u8", symbols, 0, (1,)) if len(symbols) >= 8 else np.zeros(0, dtype=np.uint64)
        h = np.zeros(n, dtype=np.uint64)
        for k, at in enumerate((0, 8, kind.anchor - 8)):
            h += eight[at : at + n] * multipliers[k]
    forward, back = tokens.powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(values * forward[: len(symbols)], out=sums[1:])
    return Stream(bounds, tokens.mix(h), sums, back, data, low, high)


def window_starts(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of all windows that lie in one text."""
    n = np.maximum(0, np.diff(bounds) - length + 1)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)


def stretches(s: Stream, kind: Kind) -> tuple[np.ndarray, ...]:
    """text, start in the text, windows, anchor hash, content hash, and bounds of the bytes of each stretch."""
    owner, starts = window_starts(s.bounds, kind.window)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (s.anchors & ~low) | np.arange(len(s.anchors), dtype=np.uint64)
    size, w = 1, kind.window - kind.anchor + 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: size - w], least[w - size :])
    at = (least[starts] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    begin, end, place = starts[first], starts[last] + kind.window, at[first]
    content = tokens.mix((s.sums[end] - s.sums[begin]) * s.back[begin] + (end - begin).astype(np.uint64))
    text = owner[first]
    return text, begin - s.bounds[text], last - first + 1, s.anchors[place] >> np.uint64(64 - _ANCHOR_BITS), content, s.low[begin], s.high[end - 1]


def same_bytes(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Whether data[a:a_end] equals data[b:b_end], pair by pair; none is empty."""
    out = (a_end - a) == (b_end - b)
    pairs = np.flatnonzero(out)
    sizes = (a_end - a)[pairs]
    cuts = [0, *np.flatnonzero(np.diff(np.cumsum(sizes) // step)) + 1, len(pairs)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j > i:
            own, n = pairs[i:j], sizes[i:j]
            first = np.cumsum(n) - n
            offset = np.arange(n.sum()) - np.repeat(first, n)
            unlike = data[np.repeat(a[own], n) + offset] != data[np.repeat(b[own], n) + offset]
            out[own] = np.add.reduceat(unlike, first, dtype=np.int64) == 0
    return out


def pack(ids: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Rows in runs of equal (id, key) and columns of equal length, as one value."""
    new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))))
    counts = np.diff(np.concatenate((new, [len(ids)])))
    head = np.array([len(ids), len(new)], dtype=np.int64)
    return b"".join(x.tobytes() for x in (head, np.diff(ids[new], prepend=np.int64(0)), keys[new], counts.astype(np.uint32), *columns))


def unpack(blobs: list[bytes], *kinds: type) -> list[np.ndarray]:
    """ids, keys and columns of packed values, put together."""
    out: list[list[np.ndarray]] = [[] for _ in range(2 + len(kinds))]
    for blob in blobs:
        n, docs = np.frombuffer(blob, dtype=np.int64, count=2)
        at = 16
        with np.errstate(over="ignore"):
            ids = np.cumsum(np.frombuffer(blob, np.int64, docs, at))
        keys, counts = np.frombuffer(blob, np.int64, docs, at + 8 * docs), np.frombuffer(blob, np.uint32, docs, at + 16 * docs)
        at += 20 * docs
        out[0].append(np.repeat(ids, counts))
        out[1].append(np.repeat(keys, counts))
        for column, kind in zip(out[2:], kinds, strict=True):
            column.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    empty = [np.int64, np.int64, *kinds]
    return [np.concatenate(x) if x else np.zeros(0, dtype=k) for x, k in zip(out, empty, strict=True)]


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high halves; the high ones are nearly always 0 and compress to nothing."""
    return x.astype(np.uint16), (x >> np.uint32(16)).astype(np.uint16)


def bucket_of(ids: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    return np.mod(ids ^ keys, n)


def messages(kind: int, to: np.ndarray, ids: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One packed value for each destination; places in a document stay in order."""
    if not len(to):
        return
    order = np.lexsort((keys, ids, to))
    to, ids, keys = to[order], ids[order], keys[order]
    columns = tuple(c[order] for c in columns)
    cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True):
        yield int(to[a]), kind, pack(ids[a:b], keys[a:b], *(c[a:b] for c in columns))


def first_of_class(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, class_: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (class, place); in that order, each row's first of its class, and whether that is earlier.

    Earlier: a smaller id, and for kinds that look within documents any smaller (id, key, start).
    """
    order = np.lexsort((starts, keys, ids, class_))
    of = class_[order]
    new = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.zeros(0, dtype=bool)
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(of) else order
    later = ids[order] != ids[head]
    if kind.within:
        later |= (keys[order] != keys[head]) | (starts[order] != starts[head])
    return order, head, later


def split_anchor(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return anchor.astype(np.uint32), (anchor >> np.uint64(32)).astype(np.uint16)


def whole_anchor(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def marks(to: int, n_buckets: int, ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, n: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Marks of n windows from each start, on their way to buckets by one of `to` parts."""
    rows = messages(MARK, bucket_of(ids, keys, n_buckets), ids, keys, starts.astype(np.uint32), n.astype(np.uint8))
    return [(p % to, MARK, np.int64(p).tobytes() + d) for p, _, d in rows]


def _scan(kind: Kind, n_parts: int, n_buckets: int):
    """Messages of a task: entries for match, and marks of what the task itself has seen before."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        data: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids, keys, starts, n, anchor, content, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, head, later = first_of_class(ids, keys, starts, content, kind)
            again, first = order[later], head[later]
            equal = same_bytes(np.concatenate(data), low[again], high[again], low[first], high[first])
            data.clear()
            done = np.sort(again[equal])
            on = np.ones(len(ids), dtype=bool)
            on[done] = False
            on = np.flatnonzero(on)
            rows = list(messages(ENTRY, (anchor[on] % np.uint64(n_parts)).astype(np.int64), ids[on], keys[on], *halves(starts[on]), n[on], *split_anchor(anchor[on])))
            yield batch_of(rows + marks(n_parts, n_buckets, ids[done], keys[done], starts[done], n[done]))

        waiting, size = 0, 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            keys = batch.column("__key").to_numpy(zero_copy_only=False)
            for at, run in tokens.steps(batch.column("text").to_pylist()):
                s = stream(run, kind)
                text, start, n, anchor, content, low, high = stretches(s, kind)
                if len(text):
                    held.append((ids[at + text], keys[at + text], start.astype(np.uint32), n.astype(np.uint8), anchor, content, low + size, high + size))
                    data.append(s.data)
                    waiting += len(text)
                    size += len(s.data)
                if waiting >= FLUSH:
                    yield from flush()
                    waiting, size = 0, 0
        yield from flush()

    return of


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=_MESSAGE)


def _match(kind: Kind, n_buckets: int, hot: int):
    """Requests for the bytes of all stretches whose anchor occurs again."""

    def of(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        rows = [(int(np.frombuffer(d, np.int64, 1)[0]), MARK, d[8:]) for k, d in zip(kinds, data, strict=True) if k == MARK]
        ids, keys, low, high, n, anchor, upper = unpack([d for k, d in zip(kinds, data, strict=True) if k == ENTRY], np.uint16, np.uint16, np.uint8, np.uint32, np.uint16)
        starts, anchor = low | high.astype(np.uint32) << np.uint32(16), whole_anchor(anchor, upper)
        del data
        order = np.argsort(anchor, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], anchor[order][1:] != anchor[order][:-1]))) if len(order) else order
        sizes = np.diff(np.concatenate((new, [len(order)])))
        again = sizes > 1
        if not kind.within and len(new):
            again &= np.maximum.reduceat(ids[order], new) > np.minimum.reduceat(ids[order], new)
        for which, chosen in ((REQUEST, again & (sizes <= hot)), (SPLIT, again & (sizes > hot))):
            on = np.sort(order[np.repeat(chosen, sizes)])
            rows += messages(which, bucket_of(ids[on], keys[on], n_buckets), ids[on], keys[on], starts[on], n[on], *split_anchor(anchor[on]))
        return pa.Table.from_batches([batch_of(rows)])

    return of


def _bodies(kind: Kind, texts: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    """First symbol of each text; the bytes of all of them, and where each symbol starts and ends in those."""
    if kind.words:
        words = tokens.Words(texts, lower=False)
        data, low, high = words.joined()
        return words.first, data.tobytes(), low, high
    low = np.arange(sum(map(len, texts)))
    return np.cumsum([0, *map(len, texts)]), b"".join(texts), low, low + 1


def _fetch(kind: Kind, n_shards: int, n_buckets: int):
    """Bytes of requested stretches for the shards of their anchors; of split ones, of each window by its own hash."""

    def of(table: pa.Table, wanted: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return pa.Table.from_batches([batch_of([])])
        _, _, texts, rows = texts_of(table)
        asked = wanted.column("kind").to_pylist(), wanted.column("data").to_pylist()
        read = lambda which: unpack([d for k, d in zip(*asked, strict=True) if k == which], np.uint32, np.uint8, np.uint32, np.uint16)
        ids, keys, starts, n, low, high = (np.concatenate(x) for x in zip(read(REQUEST), read(SPLIT), strict=True))
        split = np.arange(len(ids)) >= len(read(REQUEST)[0])
        pairs = list(zip(ids.tolist(), keys.tolist(), strict=True))
        needed = sorted({rows[p][0] for p in pairs})
        number = {row: i for i, row in enumerate(needed)}
        first, body, low_of, high_of = _bodies(kind, [texts[row] for row in needed])
        begin = first[np.array([number[rows[p][0]] for p in pairs])] + starts
        anchor, n = whole_anchor(low, high), n.astype(np.int64)
        out: list[tuple[int, int, bytes]] = []
        if split.any():  # windows instead of stretches; a bucket's first of equal ones goes on
            on = np.flatnonzero(split)
            step = np.arange(n[on].sum()) - np.repeat(np.cumsum(n[on]) - n[on], n[on])
            w_ids, w_keys, w_starts, w_begin = np.repeat(ids[on], n[on]), np.repeat(keys[on], n[on]), np.repeat(starts[on], n[on]) + step, np.repeat(begin[on], n[on]) + step
            seen: dict[bytes, int] = {}
            class_ = np.array([seen.setdefault(body[a:b], len(seen)) for a, b in zip(low_of[w_begin].tolist(), high_of[w_begin + kind.window - 1].tolist(), strict=True)], dtype=np.int64)
            order, _, later = first_of_class(w_ids, w_keys, w_starts, class_, kind)
            done, go = order[later], order[~later]
            out += marks(n_shards, n_buckets, w_ids[done], w_keys[done], w_starts[done], np.ones(len(done)))
            hashes = np.array([xxhash.xxh3_64_intdigest(w) >> (64 - _ANCHOR_BITS) for w in seen], dtype=np.uint64)
            ids, keys, starts, begin, anchor = (np.concatenate((x[~split], y[go])) for x, y in ((ids, w_ids), (keys, w_keys), (starts, w_starts), (begin, w_begin), (anchor, hashes[class_])))
            n = np.concatenate((n[~split], np.ones(len(go), dtype=np.int64)))
        shard = (anchor % np.uint64(n_shards)).astype(np.int64)
        order = np.lexsort((starts, keys, ids, shard))
        cuts = np.flatnonzero(np.concatenate(([True], shard[order][1:] != shard[order][:-1], [True])))
        packer = zstandard.ZstdCompressor(level=3)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            on = order[a:b]
            begins, ends = low_of[begin[on]], high_of[begin[on] + n[on] + kind.window - 2]
            head = pack(ids[on], keys[on], starts[on].astype(np.uint32), n[on].astype(np.uint8), *split_anchor(anchor[on]), (ends - begins).astype(np.uint32))
            data = b"".join(body[x:y] for x, y in zip(begins.tolist(), ends.tolist(), strict=True))
            out.append((int(shard[on[0]]), BODY, packer.compress(np.int64(len(head)).tobytes() + head + data)))
        return pa.Table.from_batches([batch_of(out)])

    return of


@dataclass
class Stretches:
    """Different stretches of anchors that have several, by anchor: anchors, ids and places of the first of each, windows, and bytes."""

    anchors: np.ndarray
    ids: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    n: np.ndarray
    bodies: list[bytes]


#: Finds, among stretches, (index, first window, windows) of runs of windows that also start earlier in another.
Find = Callable[[Stretches], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _compare(kind: Kind, n_buckets: int, find: Find):
    """Marks of a shard: of equal stretches, found by their bytes, and of windows that different ones share."""

    def of(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        rows = [(int(np.frombuffer(d, np.int64, 1)[0]), MARK, d[8:]) for k, d in zip(kinds, data, strict=True) if k == MARK]
        heads, class_, seen = [], [], {}
        for k, packed in zip(kinds, data, strict=True):
            if k == BODY:
                plain = zstandard.ZstdDecompressor().decompress(packed)
                size = int(np.frombuffer(plain, np.int64, 1)[0])
                heads.append(plain[8 : 8 + size])
                ends = 8 + size + np.cumsum(unpack([heads[-1]], np.uint32, np.uint8, np.uint32, np.uint16, np.uint32)[-1], dtype=np.int64)
                class_.append(np.array([seen.setdefault(plain[a:b], len(seen)) for a, b in zip([8 + size, *ends[:-1].tolist()], ends.tolist(), strict=True)], dtype=np.int64))
        del data
        ids, keys, starts, n, low, high, _ = unpack(heads, np.uint32, np.uint8, np.uint32, np.uint16, np.uint32)
        class_, anchor = np.concatenate(class_) if class_ else np.zeros(0, dtype=np.int64), whole_anchor(low, high)
        order, head, later = first_of_class(ids, keys, starts, class_, kind)
        done = order[later]
        rows += [(p, MARK, d) for p, _, d in messages(MARK, bucket_of(ids[done], keys[done], n_buckets), ids[done], keys[done], starts[done], n[done])]
        # Anchors with several different stretches; the first of each stands for all of it.
        first = order[order == head]
        by = first[np.argsort(anchor[first], kind="stable")]
        new = np.flatnonzero(np.concatenate(([True], anchor[by][1:] != anchor[by][:-1]))) if len(by) else by
        sizes = np.diff(np.concatenate((new, [len(by)])))
        on = by[np.repeat(sizes > 1, sizes)]
        if len(on):
            texts = list(seen)
            which, at, windows = find(Stretches(anchor[on], ids[on], keys[on], starts[on], n[on].astype(np.int64), [texts[c] for c in class_[on].tolist()]))
            del texts, seen
            # Marks of a class hold for every row of it that is not marked as a whole.
            left, its = order[~later], head[~later]
            by_head = np.argsort(its, kind="stable")
            a, b = np.searchsorted(its[by_head], on[which], side="left"), np.searchsorted(its[by_head], on[which], side="right")
            row = left[by_head[np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]]
            at, windows = np.repeat(at, b - a), np.repeat(windows, b - a)
            rows += [(p, MARK, d) for p, _, d in messages(MARK, bucket_of(ids[row], keys[row], n_buckets), ids[row], keys[row], (starts[row] + at).astype(np.uint32), windows.astype(np.uint8))]
        return pa.Table.from_batches([batch_of(rows)])

    return of


def runs_of(found: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first window, windows) of runs of found windows; found is flat, n[0] + n[1] + ... windows."""
    first = np.zeros(len(found), dtype=bool)
    first[np.cumsum(n) - n] = True
    begin = np.flatnonzero(found & (first | ~np.concatenate(([False], found[:-1]))))
    end = np.flatnonzero(found & np.concatenate((first[1:] | ~found[1:], [True]))) + 1
    stretch = np.searchsorted(np.cumsum(n), begin, side="right")
    return stretch, begin - (np.cumsum(n) - n)[stretch], end - begin


def _pack_documents(n_buckets: int):
    """Documents by bucket, compressed together: a third less to shuffle than row by row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush() -> pa.RecordBatch:
            out = []
            for bucket, rows in held.items():
                ids, keys = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
                sizes = np.array([len(r[2]) for r in rows], np.int64)
                head = np.array([len(rows)], np.int64).tobytes() + ids.tobytes() + keys.tobytes() + sizes.tobytes()
                out.append((bucket, zstandard.ZstdCompressor(level=3).compress(head + b"".join(r[2] for r in rows))))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["part", "packed"])

        waiting = 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            keys = batch.column("__key").to_numpy(zero_copy_only=False)
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for i, k, b, t in zip(ids.tolist(), keys.tolist(), bucket_of(ids, keys, n_buckets).tolist(), texts, strict=True):
                held.setdefault(b, []).append((i, k, t or b""))
                waiting += len(t or b"")
                if waiting >= PACKED_BYTES:
                    yield flush()
                    waiting = 0
        yield flush()

    return of


def texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes], dict[tuple[int, int], list[int]]]:
    """ids, keys, texts as bytes, and the rows of each (id, key) of packed documents."""
    all_ids, all_keys, texts = [], [], []
    for packed in table.column("packed").to_pylist():
        data = zstandard.ZstdDecompressor().decompress(packed)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        ids, keys, sizes = np.frombuffer(data, np.int64, 3 * n, 8).reshape(3, n)
        all_ids.append(ids)
        all_keys.append(keys)
        ends = 8 + 24 * n + np.cumsum(sizes)
        texts += [data[b - a : b] for a, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
    ids, keys = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (all_ids, all_keys))
    rows: dict[tuple[int, int], list[int]] = {}
    for i, pair in enumerate(zip(ids.tolist(), keys.tolist(), strict=True)):
        rows.setdefault(pair, []).append(i)
    return ids, keys, texts, rows


def doc_ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids == NO_ID)


def covered(marks: pa.Table, bounds: np.ndarray, rows: dict, window: int) -> np.ndarray:
    """Which symbols of the bucket's texts a marked window covers."""
    ids, keys, starts, n = unpack(marks.column("data").to_pylist(), np.uint32, np.uint8)
    edges = np.zeros(bounds[-1] + 1, dtype=np.int64)
    if len(ids):
        new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(ids)], strict=True):
            for row in rows[int(ids[a]), int(keys[a])]:
                begin = bounds[row] + starts[a:b].astype(np.int64)
                np.add.at(edges, begin, 1)
                np.add.at(edges, begin + n[a:b] - 1 + window, -1)
    return np.cumsum(edges[:-1]) > 0


def removals(docs: DataFrame, kind: Kind, find: Find, apply: Callable, result: str) -> DataFrame:
    """apply's rows for every row of docs: apply(kind, table, marks) makes the rows of a bucket of documents."""
    total = common.total_bytes(docs)
    n_parts, n_buckets, n_shards = (max(1, -(-total // size)) for size in (PART_BYTES, BUCKET_BYTES, SHARD_BYTES))
    keyed = docs.select("doc_id", "text", common.text_key().alias("__key"))
    scanned = keyed.mapInArrow(_scan(kind, n_parts, n_buckets), MESSAGE)
    matched = common.durable(scanned.groupBy("part").applyInArrow(_match(kind, n_buckets, HOT), MESSAGE))
    bucketed = keyed.mapInArrow(_pack_documents(n_buckets), "part int, packed binary")
    requests = matched.where(F.col("kind") != MARK)
    contents = bucketed.groupBy("part").cogroup(requests.groupBy("part")).applyInArrow(_fetch(kind, n_shards, n_buckets), MESSAGE)
    compared = contents.groupBy("part").applyInArrow(_compare(kind, n_buckets, find), MESSAGE)
    every = matched.where(F.col("kind") == MARK).unionByName(compared)

    def apply_bucket(table: pa.Table, found: pa.Table) -> pa.Table:
        return apply(kind, table, found)

    return bucketed.groupBy("part").cogroup(every.groupBy("part")).applyInArrow(apply_bucket, result)
