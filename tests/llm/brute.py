"""Plain, slow versions of what the operators compute."""

import hashlib


def substrings(docs: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    """doc_id: bytes, removed bytes, removed runs, SHA-256 of the rest."""
    data = {d: (t or "").encode() for d, t in docs}
    least: dict[bytes, int] = {}
    for d in sorted(data):
        for i in range(len(data[d]) - length + 1):
            least.setdefault(data[d][i : i + length], d)
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def phrases(docs: list[tuple[int, str | None]], length: int = 20) -> dict[int, tuple[int, int, str]]:
    """doc_id: words, removed words, SHA-256 of the rest."""
    words = {d: (t or "").encode().split() for d, t in docs}
    first: dict[tuple, tuple[int, int]] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), (d, i))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (d, i):
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id: set size, smallest doc_id reachable."""
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]
