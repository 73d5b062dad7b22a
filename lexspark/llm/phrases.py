"""Substring dedup on words, by prefix-partitioned suffix trees.

Stretches of windows (see repeats) bring together the places that can share a passage of 20 words. The
windows of the different ones are the suffixes of a shard, cut at 20 words. Words are numbered in lexical order, and suffixes
are split by prefixes of variable length: of one word, or where more than GROUP suffixes share that, of two, and so on, so
that each group fits in memory. Each group's subtree is built from its sorted suffixes and their common
prefixes: an internal node of depth d is a run of leaves with d words in common that more words do not keep together.
Nodes at the depth of a whole window are the repeats, of which the first leaf stays.

Edge cases: null or blank text has no words; fewer than 20 words are untouched; a very long text is read whole, in steps; rows
that share a doc_id are ordered by a hash of their text, and equal rows get equal results; of places that tie in that the
first stays; null doc_id counts as the largest; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats

#: Suffixes of a group, which share a prefix as long as it takes.
GROUP = 100_000


def numbered(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all bodies as numbers in lexical order, and how many words each body has."""
    lists = pc.split_pattern(pa.array(bodies, pa.binary()), pattern=b" ") if bodies else pa.array([], pa.list_(pa.binary()))
    words = lists.flatten().dictionary_encode()
    rank = np.empty(len(words.dictionary), dtype=np.int32)
    rank[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(rank), dtype=np.int32)
    return rank[words.indices.to_numpy()] if len(words) else np.zeros(0, dtype=np.int32), pc.list_value_length(lists).to_numpy().astype(np.int64)


def by_prefix(words: np.ndarray, starts: np.ndarray, depth: int, group: int, mine: np.ndarray | None = None, level: int = 0) -> Iterator[np.ndarray]:
    """The suffixes (indices into starts), split by their prefixes; none but those of depth equal words exceeds group.

    Groups come in lexical order of their prefixes; neighbours that are small together are one group.
    """
    mine = np.arange(len(starts)) if mine is None else mine
    if len(mine) <= group or level == depth:
        if len(mine):
            yield mine
        return
    symbol = words[starts[mine] + level]
    order = np.argsort(symbol, kind="stable")
    mine, symbol = mine[order], symbol[order]
    ends = np.flatnonzero(np.diff(symbol, append=-1)) + 1
    begin = last = 0
    for end in ends.tolist():
        if end - begin > group:  # with this prefix there would be too many
            if last > begin:
                yield mine[begin:last]
            begin = last
            if end - begin > group:
                yield from by_prefix(words, starts, depth, group, mine[begin:end], level + 1)
                begin = end
        last = end
    if last > begin:
        yield mine[begin:last]


def subtree(words: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves (indices into starts) in lexical order, and the common prefix of each with the one before."""
    columns = [words[starts + k] for k in range(depth)]
    order = np.lexsort(columns[::-1])
    common_words = np.zeros(len(order), dtype=np.int64)
    going = np.ones(len(order), dtype=bool)
    going[:1] = False
    for column in columns:
        sorted_ = column[order]
        going[1:] &= sorted_[1:] == sorted_[:-1]
        common_words += going
    return order, common_words


def internal_nodes(common_words: np.ndarray, least: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, first leaf, end leaf) of the internal nodes of each depth from least, the deepest first.

    common_words[i]: words that leaf i shares with the one before. A node of depth d spans the leaves that
    share d words with their neighbours, if two of them share no more.
    """
    for d in sorted({int(x) for x in np.unique(common_words) if x >= max(least, 1)}, reverse=True):
        inside = np.concatenate((common_words[1:] >= d, [False]))
        first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        end = np.flatnonzero(~inside & np.concatenate(([False], inside[:-1]))) + 1
        exact = np.concatenate(([0], np.cumsum(common_words == d)))
        own = exact[end] - exact[first + 1] > 0
        yield d, first[own], end[own]


def repeated(words: np.ndarray, starts: np.ndarray, place: tuple[np.ndarray, ...], depth: int, group: int) -> np.ndarray:
    """Which suffixes share depth words with an earlier one; place: doc_id, key, start of each."""
    out = np.zeros(len(starts), dtype=bool)
    for mine in by_prefix(words, starts, depth, group):
        order, common_words = subtree(words, starts[mine], depth)
        for _, first, end in internal_nodes(common_words, depth):
            sizes = end - first
            leaf = mine[order[np.repeat(first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]]
            node = np.repeat(np.arange(len(first)), sizes)
            by_place = np.lexsort((*(p[leaf] for p in place[::-1]), node))
            head = np.flatnonzero(np.diff(node[by_place], prepend=-1))
            out[leaf] = True
            out[leaf[by_place[head]]] = False
    return out


def _find(kind: repeats.Kind, group: int) -> repeats.Find:
    def of(s: repeats.Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, sizes = numbered(s.bodies)
        s.bodies.clear()
        step = np.arange(s.n.sum()) - np.repeat(np.cumsum(s.n) - s.n, s.n)
        starts = np.repeat(np.cumsum(sizes) - sizes, s.n) + step
        place = np.repeat(s.ids, s.n), np.repeat(s.keys, s.n), np.repeat(s.starts.astype(np.int64), s.n) + step
        return repeats.runs_of(repeated(words, starts, place, kind.window, group), s.n)

    return of


_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept binary"


def _apply(digest: bool):
    def of(kind: repeats.Kind, table: pa.Table, marks: pa.Table) -> pa.Table:
        ids, _, texts, rows = repeats.texts_of(table)
        split = [t.split() for t in texts]  # bytes split at the same characters as the word pattern
        bounds = np.cumsum([0, *map(len, split)])
        gone = repeats.covered(marks, bounds, rows, kind.window)
        out = []
        for words, a, b in zip(split, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            mine = gone[a:b]
            removed = int(np.count_nonzero(mine))
            kept = b" ".join(compress(words, (~mine).tolist()) if removed else words)
            out.append((b - a, removed, hashlib.sha256(kept).digest() if digest else kept))
        kinds = (pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
        return pa.table([repeats.doc_ids(ids), *columns], [x.split()[0] for x in _RESULT.split(", ")])

    return of


def remove_phrases(docs: DataFrame, digest: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words left of each text, joined by blanks, or with digest their SHA-256."""
    return repeats.removals(docs, repeats.WORDS, _find(repeats.WORDS, group), _apply(digest), _RESULT)


def op6_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    found = remove_phrases(common.documents(spark, sf_dir), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
  LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p WHERE g.p IS NULL GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
