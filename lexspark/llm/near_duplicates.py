"""Near duplicates by MinHash: universal hash minima, banding, verification, connected components.

Texts are sets of shingles of five lower-cased words. Equal sets are one class; only classes go on. Minima of 128
universal hash functions make 32 bands of four, and classes that share a band are a bucket. One rule holds for
buckets of every size, and none is expanded into all its pairs:

1. every member is verified against the bucket's pivot (its first member) on the full shingle sets. Pairs of a pivot are dealt to
   groups of bounded size, each of which gets the pivot's set once;
2. in buckets that then hold several components, the members outside the largest of them are compared with all members, block
   by block. Blocks of signatures (a byte of each minimum) come first; members of pairs that lie in different components and
   agree in LEAST_AGREEMENT of their signatures at least go on to blocks of full sets, which verify them
   and give only links that join components.

So two documents in one bucket end in the same component, or have been verified to differ, or have signatures that are too far
apart. At a similarity of 0.75, four in 10**6 pairs share no band, and one in 10**9 agree in less than half of the signature.

Edge cases: texts without words are linked with nothing, not even each other; fewer than five words are
one shingle; a very long text is one set, handled whole; rows that share a doc_id are one document, linked by each of its texts;
a row whose doc_id is null gets the component of its equals, null if there is none, and is not kept; equal rows get equal
results, and of documents that tie the smallest doc_id stays; extra columns, whatever their names, are ignored, or pass
through keep_one_of_each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens
from .components import connected_components

SHINGLE, MINIMA, ROWS, PERCENT = 5, 128, 4, 75
LEAST_AGREEMENT = 0.5
#: Members of a block, bytes of a group of blocks, and rows of equal sets from which a set is joined apart from the others.
BLOCK, GROUP_BYTES, HEAVY = 512, 8 << 20, 1_000
_WORD = tokens.constants(SHINGLE, 11)
_A, _B = tokens.constants(MINIMA, 12), tokens.constants(MINIMA, 13)
_BAND = tokens.constants(ROWS, 14)


def shingle_sets(texts: list) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, run in tokens.steps(texts):
        words = tokens.Words(run, lower=True)
        h = words.hashes
        n = max(0, len(h) - SHINGLE + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for k in range(SHINGLE):
            rolled += h[k : k + n] * _WORD[k]
        rolled = tokens.mix(rolled)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(rolled[a : b - SHINGLE + 1])
            else:
                yield tokens.mix((h[a:b] * _WORD[: b - a]).sum(keepdims=True) + np.uint64(b - a)) if b > a else h[:0]


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("set_id", pa.binary()), ("signature", pa.binary())])
_SIGNED_DDL = "doc_id bigint, key bigint, n bigint, set_id binary, signature binary"


def _minima(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and 128-bit ids of sets that are not empty."""
    flat = np.concatenate(group)
    at = np.cumsum([0, *(len(s) for s in group[:-1])])
    minima = np.empty((MINIMA, len(group)), dtype=np.uint32)
    buffer = np.empty_like(flat)
    for k in range(MINIMA):
        np.multiply(flat, _A[k], out=buffer)
        np.add(buffer, _B[k], out=buffer)
        minima[k] = np.minimum.reduceat(buffer, at) >> np.uint64(32)
    ids = np.stack([np.add.reduceat(tokens.mix(flat), at), np.add.reduceat(tokens.mix(flat + np.uint64(0x5851F42D4C957F2D)), at)], axis=1)
    return np.ascontiguousarray(minima.T), ids


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, set_ids, signatures = [], [], []
        group: list[np.ndarray] = []

        def flush() -> None:
            full = [s for s in group if len(s)]
            rows = iter(zip(*_minima(full), strict=True) if full else ())
            for s in group:
                sizes.append(len(s))
                minima, ids = next(rows) if len(s) else (None, None)
                set_ids.append(ids.tobytes() if len(s) else None)
                signatures.append(minima.tobytes() if len(s) else None)
            group.clear()

        n = 0
        for texts in tokens.slices(batch.column("text")):
            for s in shingle_sets(texts):
                group.append(s)
                n += len(s)
                if n > 1 << 16:
                    flush()
                    n = 0
        flush()
        columns = [pa.array(sizes, pa.int64()), pa.array(set_ids, pa.binary()), pa.array(signatures, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], schema=_SIGNED)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_bands = MINIMA // ROWS
    for batch in batches:
        if batch.num_rows:
            s = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, n_bands, ROWS)
            key = tokens.mix((s.astype(np.uint64) * _BAND).sum(axis=2) + np.arange(1, n_bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column("cid").to_numpy(), n_bands))], ["bucket", "cid"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte of each minimum; different minima agree in it once in 256 times, so no pair looks less alike than it is."""
    for batch in batches:
        short = [np.frombuffer(s, dtype=np.uint32).astype(np.uint8).tobytes() for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(short, pa.binary())], ["cid", "short"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [s.tobytes() for texts in tokens.slices(batch.column("text")) for s in shingle_sets(texts)]
        yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(found, pa.binary())], ["cid", "shingles"])


def sets_of(cids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cid and shingles of the classes named, read from one text of each."""
    first = common.durable(classes.join(cids, "cid", "left_semi").select("cid", F.col("rep").alias("first_id"), F.col("key").alias("first_key")))
    rows = docs.select("doc_id", common.text_key().alias("row_key"), "text")
    rows = rows.join(common.small(first), (F.col("doc_id") == F.col("first_id")) & (F.col("row_key") == F.col("first_key")))
    one = rows.groupBy("cid").agg(F.first("text").alias("text"))
    return common.durable(one.mapInArrow(_sets, "cid bigint, shingles binary"))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all of left with all of right, as blocks of a product of incidence matrices."""
    flat, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut = sum(map(len, left))
    shared = np.intersect1d(codes[:cut], codes[cut:])
    place = np.full(len(flat), -1, dtype=np.int64)
    place[shared] = np.arange(len(shared))
    sides = []
    for sets, c in ((left, place[codes[:cut]]), (right, place[codes[cut:]])):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        sides.append((row[c >= 0], c[c >= 0]))
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(shared), width):
        blocks = []
        for n, (row, c) in zip((len(left), len(right)), sides, strict=True):
            block = np.zeros((n, width), dtype=np.float32)
            mine = (c >= at) & (c < at + width)
            block[row[mine], c[mine] - at] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out.astype(np.int64)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(pairs: list[tuple[int, int]]) -> pa.Table:
    columns = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    return pa.table([pa.array(c) for c in columns], schema=_PAIRS)


def _verify(table: pa.Table) -> pa.Table:
    """Linked pairs of the pivots of this group; a pivot's own row has no b."""
    a, b, sets = (table.column(c).to_pylist() for c in ("a", "b", "shingles"))
    pivot = {x: np.frombuffer(s, dtype=np.uint64) for x, y, s in zip(a, b, sets, strict=True) if y is None}
    return _pairs([(x, y) for x, y, s in zip(a, b, sets, strict=True) if y is not None and similar(pivot[x], np.frombuffer(s, dtype=np.uint64))])


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b, n) whose full shingle sets are similar; n: at least as many as a has pairs."""
    dealt = pairs.withColumn("fan", F.ceil(F.col("n") / BLOCK)).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("fan"))).drop("n")
    dealt = common.durable(dealt)
    sets = sets_of(dealt.select(F.col("a").alias("cid")).union(dealt.select("b")).distinct(), classes, docs)
    mean = sets.agg(F.avg(F.octet_length("shingles"))).first()[0] or 0
    n_parts = max(1, int(-(-dealt.count() * (mean + 64) // GROUP_BYTES)))
    part = F.pmod(F.xxhash64("a", "fan", "salt"), F.lit(n_parts)).alias("part")
    heads = dealt.select("a", part).distinct().join(sets, F.col("a") == F.col("cid")).select("part", "a", F.lit(None).cast("bigint").alias("b"), "shingles")
    tails = dealt.select("a", "b", part).join(sets, F.col("b") == F.col("cid")).select("part", "a", "b", "shingles")
    return common.durable(heads.unionByName(tails).groupBy("part").applyInArrow(_verify, "a bigint, b bigint"))


def _groups(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the outside and of the inside block of each (bucket, i, j) of a table."""
    bucket, i, j, outside = (table.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j", "outside"))
    order = np.lexsort((outside, j, i, bucket))
    new = np.flatnonzero((np.diff(bucket[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
    for rows in np.split(order, new):
        yield rows[outside[rows]], rows[~outside[rows]]


_BLOCKS = "bucket bigint, i int, j int, outside boolean, cid bigint, component bigint"


def _agreeing(table: pa.Table) -> pa.Table:
    """Members of pairs in different components whose signatures agree enough."""
    component = table.column("component").to_numpy()
    short = np.frombuffer(b"".join(table.column("short").to_pylist()), dtype=np.uint8).reshape(-1, MINIMA)
    on = np.zeros(table.num_rows, dtype=bool)
    for left, right in _groups(table):
        theirs = short[right]
        for row in left:
            alike = right[((theirs == short[row]).sum(axis=1) >= LEAST_AGREEMENT * MINIMA) & (component[right] != component[row])]
            on[alike] = True
            on[row] |= len(alike) > 0
    return table.select([x.split()[0] for x in _BLOCKS.split(", ")]).filter(pa.array(on))


def _spanning(table: pa.Table) -> pa.Table:
    """Links that join components in each pair of blocks, found on full sets; one less than the components at most."""
    cid, comp = table.column("cid").to_numpy(), table.column("component").to_numpy()
    sets = [np.frombuffer(s, dtype=np.uint64) for s in table.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    out = []
    for left, right in _groups(table):
        both = intersections([sets[i] for i in left], [sets[j] for j in right])
        linked = 100 * both >= PERCENT * (sizes[left][:, None] + sizes[right][None, :] - both)
        linked &= comp[left][:, None] != comp[right][None, :]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for i, row in zip(left.tolist(), linked, strict=True):
            for c, j in zip(*(x.tolist() for x in np.unique(comp[right[row]], return_index=True)), strict=True):
                x, y = find(int(comp[i])), find(c)
                if x != y:
                    root[x] = y
                    out.append((int(cid[i]), int(cid[right[np.flatnonzero(row)[j]]])))
    return _pairs(out)


def _blocks(members: DataFrame, components: DataFrame) -> DataFrame:
    """_BLOCKS of the buckets that hold several components: each block of members outside the largest one with each block of all."""
    labelled = members.where("n > 2").join(components, F.col("cid") == F.col("node"), "left")
    labelled = common.durable(labelled.select("bucket", "cid", F.coalesce("component", "cid").alias("component")))
    sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    open_ = open_.select("bucket", F.col("largest.component").alias("largest"), F.ceil(F.col("n") / BLOCK).cast("int").alias("all"), F.ceil((F.col("n") - F.col("largest.n")) / BLOCK).cast("int").alias("out"))
    rows = labelled.join(common.small(common.durable(open_)), "bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    left = rows.where("component != largest").select("bucket", mine("out").alias("i"), every("all").alias("j"), F.lit(True).alias("outside"), "cid", "component")
    right = rows.select("bucket", every("out").alias("i"), mine("all").alias("j"), F.lit(False).alias("outside"), "cid", "component")
    return left.unionByName(right)


def _in_parts(blocks: DataFrame, bytes_: int) -> DataFrame:
    """blocks with part: pairs of blocks dealt to groups of bounded size."""
    return blocks.withColumn("part", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(max(1, -(-bytes_ // GROUP_BYTES)))))


def links_across(members: DataFrame, components: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links (a, b) between components that share a bucket."""
    blocks = common.durable(_blocks(members, components))
    shorts = classes.mapInArrow(_short, "cid bigint, short binary")
    signed = _in_parts(blocks.join(shorts, "cid"), blocks.count() * (MINIMA + 80))
    agreeing = common.durable(signed.groupBy("part").applyInArrow(_agreeing, _BLOCKS))
    if agreeing.isEmpty():
        return agreeing.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    sets = sets_of(agreeing.select("cid").distinct(), classes, docs)
    joined = agreeing.join(sets, "cid")
    total = agreeing.join(classes.select("cid", "n_shingles"), "cid").agg(F.sum(F.col("n_shingles") * 8 + 80)).first()[0]
    return common.durable(_in_parts(joined, total).groupBy("part").applyInArrow(_spanning, "a bigint, b bigint").distinct())


def _classes(signed: DataFrame) -> DataFrame:
    """cid, set_id, rep (smallest doc_id) and key of its text, n_shingles, signature and rows of each different set."""
    found = signed.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(
        F.min(F.struct("doc_id", "key")).alias("first"), F.first("n").alias("n_shingles"), F.first("signature").alias("signature"), F.count("*").alias("rows")
    )
    return common.durable(found.select(F.monotonically_increasing_id().alias("cid"), "set_id", F.col("first.doc_id").alias("rep"), F.col("first.key").alias("key"), "n_shingles", "signature", "rows"))


def _of_one_document(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of texts that share a doc_id."""
    several = signed.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo != hi").select("doc_id")
    texts = signed.join(common.small(common.durable(several)), "doc_id", "left_semi").select("doc_id", "set_id").distinct()
    named = common.durable(texts.join(classes.select("set_id", "cid"), "set_id").select("doc_id", "cid"))
    first = named.groupBy("doc_id").agg(F.min("cid").alias("a"))
    return named.join(first, "doc_id").select("a", F.col("cid").alias("b")).where("a != b")


def _labels(classes: DataFrame, components: DataFrame) -> DataFrame:
    """set_id, component_id and rows of each class; a component is named by its smallest doc_id."""
    of = classes.select("cid", "set_id", "rep", "rows").join(components, F.col("cid") == F.col("node"), "left")
    of = common.durable(of.select("set_id", "rep", "rows", "component"))
    joined = of.where("component IS NOT NULL")
    least = common.durable(joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("k")))
    large = joined.join(common.small(least.where(F.col("k") > HEAVY)), "component")
    other = joined.join(common.small(least.where(F.col("k") > HEAVY).select("component")), "component", "left_anti").join(least, "component")
    alone = of.where("component IS NULL").select("set_id", F.col("rep").alias("component_id"), "rows")
    return common.durable(alone.unionByName(large.unionByName(other).select("set_id", "component_id", "rows")))


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, key (text_key), n_shingles, component_id: one row for each row of docs."""
    docs = docs.select("doc_id", "text")
    signed = common.durable(docs.select("doc_id", common.text_key().alias("key"), "text").mapInArrow(_sign, _SIGNED_DDL))
    classes = _classes(signed)
    buckets = classes.select("cid", "signature").mapInArrow(_bands, "bucket bigint, cid bigint")
    shared = buckets.groupBy("bucket").agg(F.min("cid").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = common.durable(buckets.join(shared, "bucket"))
    pairs = members.where("cid != pivot").groupBy(F.col("pivot").alias("a"), F.col("cid").alias("b")).agg(F.max("n").alias("n"))
    links = common.durable(verify(pairs, classes, docs).unionByName(_of_one_document(signed, classes)))
    components = common.durable(connected_components(links))
    more = links_across(members, components, classes, docs)
    if not more.isEmpty():
        components = common.durable(connected_components(links.unionByName(more)))
    labels = _labels(classes, components)
    rows = signed.select("doc_id", "key", F.col("n").alias("n_shingles"), "set_id")
    heavy = common.small(labels.where(F.col("rows") > HEAVY).select("set_id", "component_id"))
    often = rows.join(heavy, "set_id")
    other = rows.where("set_id IS NOT NULL").join(heavy.select("set_id"), "set_id", "left_anti").join(labels.select("set_id", "component_id"), "set_id", "left")
    none = rows.where("set_id IS NULL").withColumn("component_id", F.col("doc_id"))
    return often.unionByName(other).unionByName(none).drop("set_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept: one row for each row of docs."""
    return _labelled(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents that are not the first of their component; the columns of docs.

    A row without doc_id goes if its component has a name, as it then is a copy of a document with one.
    """
    which = lambda key: F.when(F.col("id").isNull(), F.col(key)).otherwise(F.lit(0))
    found = _labelled(docs).where("component_id IS NOT NULL AND NOT doc_id <=> component_id").withColumnRenamed("doc_id", "id")
    gone = common.small(common.durable(found.select(F.col("id").alias("gone_id"), which("key").alias("gone_key")).distinct()))
    rows = docs.select(common.packed(docs).alias("row"), F.col("doc_id").alias("id"), common.text_key().alias("key"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (which("key") == F.col("gone_key")), "left_anti").select("row.*")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    return near_duplicates(common.documents(spark, sf_dir))


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(list_slice(w, i, i + 4), ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
least_root AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM s JOIN least_root l ON l.node = s.doc_id
"""
