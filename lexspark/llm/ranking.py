"""Ranked lexical search, exact: a dual-tree search over items and documents.

Every document becomes a sparse vector over the terms of the items: a coordinate's value is the document's saturated frequency of the term.
An item's vector has the weights of its terms, so a score is an inner product. Tasks put their documents, some thousand at a
time, into a tree: halves by likeness down to leaves, each node with the maxima of its coordinates; items are in trees of the same kind. From the two
roots down, a pair of nodes goes on only if the product of their maxima, which no score below it exceeds, reaches the weakest kth score
of the node's items. Pairs of leaves that are left are scored in 64-bit integers, the most promising first. What is cut off is below
an item's kth score for sure, so the results are those of a full scan. A first round over a bounded number of documents gives every task kth scores to begin with.

Benchmark texts go out with the tasks in groups of a bounded size, each with a pass of its own over the documents; tasks keep k rows an item.

Edge cases: null text, or text without terms, is no document for the statistics and ranks nowhere; an item without terms, or whose terms occur
nowhere, has no rows; every row of the items is an item, repeats included; ties in score go by doc_id, null last, and of rows
that share a doc_id each counts; a very long text is scanned whole; extra columns, whatever their names, are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

K, SCALE = 10, 1_000_000_000
#: Documents of a tree, of a leaf at least, items of a leaf, and children of a node.
BLOCK, DOC_LEAF, ITEM_LEAF, FAN = 4096, 32, 4, 8
#: Bytes of the items of a pass, terms of a tree of items (a longer item has its own), and cells of a matrix.
GROUP_BYTES, TREE_TERMS, CELLS = 8 << 20, 1 << 14, 1 << 22
#: Documents of the first round.
FIRST_ROUND = 16_384
#: Bytes that are no part of a term.
GAP = np.isin(np.arange(256), [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_VECTORS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
_VECTORS_DDL = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
_FOUND = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "item bigint, item_id bigint, doc_id bigint, score bigint"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, in order."""
    words = tokens.Words([(text or "").encode("utf-8", "surrogatepass")], True, GAP)
    data = _LOWER[words.data].tobytes()
    return [data[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges that start somewhere and have some size, one range after another."""
    ahead = np.cumsum(sizes) - sizes
    return np.repeat(starts - ahead, sizes) + np.arange(int(sizes.sum()))


class Vocabulary:
    """Terms by hash; what has a term's hash is compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        words = tokens.Words(terms, True, GAP)
        self.order = np.argsort(words.hashes, kind="stable")
        self.hashes, self.data = words.hashes[self.order], words.data
        self.starts, self.sizes = words.starts[self.order], (words.ends - words.starts)[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms have one hash")

    def find(self, words: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
        """(places of words, numbers of their terms) of the words that are terms."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        sizes = words.ends - words.starts
        place = np.flatnonzero((self.hashes[at] == words.hashes) & (self.sizes[at] == sizes))
        at, sizes = at[place], sizes[place]
        if len(place):
            alike = _LOWER[words.data[_ranges(words.starts[place], sizes)]] == self.data[_ranges(self.starts[at], sizes)]
            fine = np.logical_and.reduceat(alike, np.cumsum(sizes) - sizes)
            place, at = place[fine], at[fine]
        return place, self.order[at]


def vectors(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts: the numbers of the vocabulary's terms in the text, and how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size = max(1, len(known.hashes))
        for batch in batches:
            ids = batch.column("doc_id")
            done = 0
            for texts in tokens.slices(batch.column("text"), 256):
                for at, run in tokens.steps(texts):
                    words = tokens.Words(run, True, GAP)
                    place, term = known.find(words)
                    owner = np.searchsorted(words.first, place, "right") - 1
                    cell, count = np.unique(owner * size + term, return_counts=True)
                    ends = np.searchsorted(cell // size, np.arange(len(run) + 1)).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cell % size, count)]
                    yield pa.RecordBatch.from_arrays([ids.slice(done + at, len(run)), pa.array(np.diff(words.first).astype(np.int64)), *lists], schema=_VECTORS)
                done += len(texts)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(of, _VECTORS_DDL)


@dataclass
class Corpus:
    """What a score needs to know of all documents: how many, how many terms they have, and how many hold each term of the vocabulary."""

    documents: int
    length: int
    holding: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * int(df) + 1))) for df in self.holding], dtype=np.int64)

    def values(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Saturated frequencies; n is the length of the document of each count."""
        lengths, which = np.unique(n, return_inverse=True)
        middle = np.array([10 + 90 * int(x) * self.documents // self.length for x in lengths], dtype=np.int64)[which]
        counts = counts.astype(np.int64)
        return SCALE * counts // (1000 * counts + 8 * middle)


@dataclass
class Rows:
    """Sparse rows: row i has cells first[i]:first[i+1] of columns and values."""

    first: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.first[rows + 1] - self.first[rows]
        at = _ranges(self.first[rows], sizes)
        return Rows(np.concatenate(([0], np.cumsum(sizes))), self.columns[at], self.values[at])

    def only(self, column: np.ndarray) -> Rows:
        """With the columns renumbered by column, and without those that are -1 there."""
        new = column[self.columns]
        on = new >= 0
        return Rows(np.concatenate(([0], np.cumsum(on)))[self.first], new[on], self.values[on])

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def by_likeness(rows: Rows, width: int, leaf: int) -> np.ndarray:
    """An order of the rows in which leaves of neighbours are alike: halves again and again, by which of two unlike rows a row overlaps more."""
    n = len(rows.first) - 1
    order, dense, todo = np.arange(n), np.zeros(width), [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            continue
        own = rows.take(order[a:b])
        owner, size = own.owners(), b - a

        def overlap(i: int, own: Rows = own, owner: np.ndarray = owner, size: int = size) -> np.ndarray:
            cells = slice(own.first[i], own.first[i + 1])
            dense[own.columns[cells]] = own.values[cells]
            out = np.bincount(owner, own.values * dense[own.columns], size)
            dense[own.columns[cells]] = 0
            return out

        one = overlap(int(np.bincount(owner, own.values, size).argmax()))
        order[a:b] = order[a:b][np.argsort(overlap(int(one.argmin())) - one, kind="stable")]
        half = max(leaf, size // 2 // leaf * leaf)
        todo += [(a, a + half), (a + half, b)]
    return order


def maxima(rows: Rows, width: int, leaf: int) -> list[np.ndarray]:
    """The maxima of the coordinates of each node, level by level from the leaves of `leaf` rows to the root."""
    nodes = -(-(len(rows.first) - 1) // leaf)
    lowest = np.zeros((nodes, width))
    np.maximum.at(lowest.reshape(-1), rows.owners() // leaf * width + rows.columns, rows.values)
    levels = [lowest]
    while len(levels[-1]) > 1:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN)))
    return levels


class ItemTree:
    """Some items: their weights, in the order of the tree, and the maxima of its nodes."""

    def __init__(self, items: list[tuple[int, np.ndarray]], weights: np.ndarray):
        """items: (number, terms)."""
        self.terms = np.unique(np.concatenate([t for _, t in items]))
        column = np.full(len(weights), -1)
        column[self.terms] = np.arange(len(self.terms))
        rows = Rows(np.cumsum([0, *(len(t) for _, t in items)]), np.concatenate([column[t] for _, t in items]), np.concatenate([weights[t] for _, t in items]))
        order = by_likeness(rows, len(self.terms), ITEM_LEAF)
        self.column, self.rows = column, rows.take(order)
        self.numbers = np.array([n for n, _ in items])[order]
        self.levels = maxima(self.rows, len(self.terms), ITEM_LEAF)


class Search:
    """The k best documents of each item among those given so far; floor: kth scores known beforehand."""

    def __init__(self, items: list[tuple[int, np.ndarray]], weights: np.ndarray, floor: np.ndarray, k: int = K):
        """items: (number, numbers of distinct terms); the numbers of the items count from 0."""
        self.weights, self.k, self.floor = weights, k, floor
        self.score, self.doc = np.zeros((len(items), k), np.int64), np.zeros((len(items), k), np.int64)
        self.known = np.zeros((len(items), k), bool)
        self.scored = self.seen = 0
        self.trees, run, terms = [], [], 0
        for item in sorted((x for x in items if len(x[1])), key=lambda x: x[0]):
            if run and terms + len(item[1]) > TREE_TERMS:
                self.trees.append(ItemTree(run, weights))
                run, terms = [], 0
            run.append(item)
            terms += len(item[1])
        if run:
            self.trees.append(ItemTree(run, weights))

    def kth(self, numbers: np.ndarray) -> np.ndarray:
        """What a document must reach to rank among the k best of these items."""
        return np.maximum(np.maximum(self.score[numbers, -1], self.floor[numbers]), 1)

    def add(self, docs: Rows, ids: np.ndarray, known: np.ndarray) -> None:
        """docs: columns are terms, values saturated frequencies; known: whether there is an id."""
        for tree in self.trees:
            rows = docs.only(tree.column)
            some = np.flatnonzero(np.diff(rows.first))
            if len(some):
                rows = rows.take(some)
                width, leaf = len(tree.terms), DOC_LEAF
                while -(-len(some) // leaf) * width > CELLS:
                    leaf *= 2
                weighted = Rows(rows.first, rows.columns, rows.values * self.weights[tree.terms][rows.columns].astype(float))
                order = by_likeness(weighted, width, leaf)
                self._tree(tree, rows.take(order), ids[some[order]], known[some[order]], leaf)

    def _tree(self, tree: ItemTree, rows: Rows, ids: np.ndarray, known: np.ndarray, leaf: int) -> None:
        pairs_item, pairs_doc, bound = self._pairs(tree, maxima(rows, len(tree.terms), leaf))
        self.seen += len(ids) * len(tree.numbers)
        step = max(1, 512 // leaf)
        for node in np.unique(pairs_item).tolist():
            mine = np.flatnonzero(pairs_item == node)
            mine = mine[np.argsort(-bound[mine], kind="stable")]
            members = np.arange(node * ITEM_LEAF, min((node + 1) * ITEM_LEAF, len(tree.numbers)))
            own = tree.rows.take(members)
            columns, cell = np.unique(own.columns, return_inverse=True)
            weight = np.zeros((len(columns), len(members)), np.int64)
            weight[cell, own.owners()] = own.values
            column = np.full(len(tree.terms), -1)
            column[columns] = np.arange(len(columns))
            for at in range(0, len(mine), step):
                on = mine[at : at + step]
                on = on[bound[on] >= self.kth(tree.numbers[members]).min()]
                if not len(on):
                    break
                starts = pairs_doc[on] * leaf
                self._score(tree.numbers[members], weight, column, rows, _ranges(starts, np.minimum(leaf, len(ids) - starts)), ids, known)

    def _pairs(self, tree: ItemTree, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf of items, leaf of documents, bound) of the pairs that may hold a result."""
        i, d, least = len(tree.levels) - 1, len(docs) - 1, [self.kth(tree.numbers)]
        for size in [ITEM_LEAF, *[FAN] * i]:
            least.append(np.minimum.reduceat(least[-1], np.arange(0, len(least[-1]), size)))
        a, b = np.zeros(1, int), np.zeros(1, int)
        while True:
            (some_a, place_a), (some_b, place_b) = (np.unique(x, return_inverse=True) for x in (a, b))
            bound = (tree.levels[i][some_a] @ docs[d][some_b].T)[place_a, place_b] * (1 + 1e-9)  # sums beyond 2**53 are rounded
            on = bound >= least[i + 1][a]
            a, b, bound = a[on], b[on], bound[on]
            if not len(a) or i == d == 0:
                return a, b, bound
            down_a, down_b = (FAN if i else 1), (FAN if d else 1)
            a, b = np.repeat(a * down_a, down_a * down_b), np.repeat(b * down_b, down_a * down_b)
            a = a + np.tile(np.repeat(np.arange(down_a), down_b), len(on[on]))
            b = b + np.tile(np.arange(down_b), down_a * len(on[on]))
            i, d = max(0, i - 1), max(0, d - 1)
            on = (a < len(tree.levels[i])) & (b < len(docs[d]))
            a, b = a[on], b[on]

    def _score(self, numbers: np.ndarray, weight: np.ndarray, column: np.ndarray, rows: Rows, which: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        step = max(1, CELLS // max(1, len(weight)))
        for at in range(0, len(which), step):
            some = which[at : at + step]
            own = rows.take(some).only(column)
            dense = np.zeros((len(some), len(weight)), np.int64)
            dense[own.owners(), own.columns] = own.values
            scores = dense @ weight
            self.scored += scores.size
            for j, number in enumerate(numbers.tolist()):
                good = np.flatnonzero(scores[:, j] >= self.kth(numbers[j : j + 1])[0])
                if len(good):
                    score = np.concatenate((self.score[number], scores[good, j]))
                    doc, sure = np.concatenate((self.doc[number], ids[some[good]])), np.concatenate((self.known[number], known[some[good]]))
                    best = np.lexsort((doc, ~sure, -score))[: self.k]
                    self.score[number], self.doc[number], self.known[number] = score[best], doc[best], sure[best]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the item, doc_id, whether there is one, score)."""
        item, place = np.nonzero(self.score >= np.maximum(self.floor, 1)[:, None])
        return item, self.doc[item, place], self.known[item, place], self.score[item, place]


def _searched(found: DataFrame, items: list[tuple[int | None, np.ndarray]], corpus: Corpus, floor: np.ndarray, k: int) -> DataFrame:
    """item, item_id, doc_id, score of the k best documents of each item in each task."""
    shared = found.sparkSession.sparkContext.broadcast((items, corpus, floor))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, about, least = shared.value
        search = Search([(i, t) for i, (_, t) in enumerate(asked)], about.weights(), least, k)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ids, n, terms, counts = (batch.column(c).slice(at, BLOCK) for c in _VECTORS.names)
                first = np.concatenate(([0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False)))).astype(np.int64)
                lengths = np.repeat(n.to_numpy(zero_copy_only=False), np.diff(first))
                values = about.values(counts.flatten().to_numpy(), lengths) if len(lengths) else np.zeros(0, np.int64)
                rows = Rows(first, terms.flatten().to_numpy().astype(np.int64), values)
                search.add(rows, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False))
        item, doc, known, score = search.results()
        names = [asked[i][0] for i in item.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(names, pa.int64()), pa.array(doc, mask=~known), pa.array(score)], schema=_FOUND)

    return found.mapInArrow(of, _FOUND_DDL)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _corpus(found: DataFrame, size: int) -> Corpus:
    """One row of sums, and one row a term, reach the driver."""
    n, length = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    holding = np.zeros(size, dtype=np.int64)
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[r["term"]] = r["count"]
    return Corpus(n, length or 0, holding)


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = K, group_bytes: int = GROUP_BYTES, first_round: int = FIRST_ROUND) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0."""
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL")
    groups = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_bytes))
    out = None
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        found = _group(docs, [(r["item_id"], sorted(set(terms_of(r["text"])))) for r in rows], k, first_round)
        out = found if out is None else out.unionByName(found)
    return out


def _group(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int, first_round: int) -> DataFrame:
    terms = sorted({t for _, own in items for t in own})
    number = {t: i for i, t in enumerate(terms)}
    asked = [(item_id, np.array([number[t] for t in own], dtype=np.int64)) for item_id, own in items]
    found = common.written(vectors(docs, Vocabulary(terms)))
    corpus = _corpus(found, len(terms))
    some = found.where(F.size("terms") > 0)
    floor, share = np.zeros(len(asked), np.int64), first_round / max(1, corpus.documents)
    place = F.xxhash64(F.lit("first"), "doc_id", "n") if share < 1 else F.lit(-(2**63)).cast("bigint")
    first = some.where(place < int((share - 0.5) * 2**64)) if share < 1 else some.limit(0)
    for r in _ranked(_searched(first, asked, corpus, floor, k), k).where(F.col("rank") == k).select("item", "score").collect():
        floor[r["item"]] = r["score"]
    best = _ranked(_searched(some, asked, corpus, floor, k), k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score of the ten best documents of every benchmark item."""
    return ranked_documents(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
c AS (SELECT CAST(count(*) AS HUGEINT) AS n_docs, CAST(sum(n) AS HUGEINT) AS total FROM d),
q AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, c GROUP BY term, n_docs),
x AS (SELECT doc_id, term, w * CAST((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)) AS BIGINT) AS s FROM tf JOIN df USING (term), c),
s AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY item_id, doc_id HAVING sum(s) > 0),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {K}
"""
