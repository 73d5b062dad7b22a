"""Conversation prefix trie: rollups by bands of depths.

A node is a distinct sequence of first turns; its key is a chained digest of them. Subtree totals come by bands of HEIGHT depths: a node explodes
to its ancestors inside its band alone, which gives the totals of every band's top within the band. The tops are a tree of
1/HEIGHT of the depth, whose totals come in the same way; then each top's completed total goes to the ancestors in the band above it.
So a node makes at most HEIGHT rows a level, and there are as many levels as the depth has digits to the base HEIGHT.

Turns are chained conversation by conversation in a stream of sorted rows, of which a task holds the last few keys; a conversation is never held. Nodes,
children and totals are summed in tasks before they are shuffled, so a first turn or a whole conversation that very many share is one row a
task. The ids that end at a node are joined in blocks of a bounded size and digested block after block.

Edge cases: null turns come first, and rows of one turn go by the digest of role and text; null role or text is empty; equal rows are turns
each; rows without conv_id belong to no conversation and are left out; a conversation may have no turns once it is rebuilt, and then ends at the
root; very long texts are digested where they are read; extra columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

HEIGHT, HEADS, FAMILY = 8, 6, 100
#: Ids of a block, and bytes of a key.
IDS, KEY = 4096, 16
ROOT = bytes(KEY)
_CHAIN = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("size", pa.int64()), ("ends", pa.bool_()), ("up", pa.binary())])
_CHAIN_DDL = "conv bigint, depth bigint, key binary, parent binary, size bigint, ends boolean, up binary"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv, at (from 1), digest of role and text, size (code points of the text); texts are not shuffled."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv"), "turn", digest.alias("digest"), F.char_length(text).cast("bigint").alias("size"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")
    return turns.select("conv", F.row_number().over(order).cast("bigint").alias("at"), "digest", "size")


def rebuilt(turns: DataFrame, heads: int = HEADS, family: int = FAMILY) -> DataFrame:
    """conv, part, at, digest, size: each conversation with its first turns from the first of its family; part -1 is one row a conversation, without turn.

    turns is read several times. At most family - 1 conversations (twice that around 0) take at most heads - 1 rows of one.
    """
    h = F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % heads
    first = F.col("conv") - F.col("conv") % family
    ids = turns.where("at = 1").select("conv", h.alias("h"), first.alias("first"))
    lent = turns.where(F.col("at") < heads).select(F.col("conv").alias("first"), "at", "digest", "size")
    head = ids.where("conv != first AND h > 0").join(lent, "first").where("at <= h").select("conv", F.lit(0).alias("part"), "at", "digest", "size")
    own = turns.where((F.col("at") > h) | (F.col("conv") == first)).select("conv", F.lit(1).alias("part"), "at", "digest", "size")
    none = ids.select("conv", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("size"))
    return head.unionByName(own).unionByName(none)


class _Path:
    """The last keys of one conversation: of each level (depths that are multiples of height**level) the nearest `height` ancestors."""

    def __init__(self, height: int):
        self.height, self.depth, self.key = height, 0, ROOT
        self.near: list[list[bytes]] = [[ROOT]]

    def up(self) -> bytes:
        """The ancestors of the node inside its band, and for a band's top those in the band above, level by level, nearest first."""
        out, d, level = [], self.depth, 0
        while d:
            if level == len(self.near):
                self.near.append([ROOT])
            out += self.near[level][: d % self.height or self.height]
            if d % self.height:
                break
            d, level = d // self.height, level + 1
        return b"".join(out)

    def kept(self) -> None:
        d, level = self.depth, 0
        while d and level < len(self.near):
            self.near[level] = [self.key, *self.near[level][: self.height - 1]]
            if d % self.height:
                break
            d, level = d // self.height, level + 1


def _chained(height: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, conv, waiting = _Path(height), None, None
        for batch in batches:
            out: list[tuple] = []
            for c, digest, size in zip(*(batch.column(x).to_pylist() for x in ("conv", "digest", "size")), strict=True):
                if waiting:  # whether a turn is the last is known at the next row
                    out.append((*waiting[:5], c != conv, waiting[5]))
                if c != conv:
                    path, conv = _Path(height), c
                    waiting = (c, 0, ROOT, None, 0, b"")
                else:
                    parent = path.key
                    path.depth, path.key = path.depth + 1, hashlib.sha256(parent + digest).digest()[:KEY]
                    waiting = (c, path.depth, path.key, parent, size, path.up())
                    path.kept()
            yield _batch(out)
        if waiting:
            yield _batch([(*waiting[:5], True, waiting[5])])

    return of


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_CHAIN)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHAIN, strict=True)], schema=_CHAIN)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's blocks of ids, comma-joined; rows come by key and block."""
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    key, state = None, hashlib.sha256()
    for batch in batches:
        out = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], schema=schema)


def _ends(chain: DataFrame) -> DataFrame:
    """key and ends_sha256 of the nodes at which conversations end."""
    blocks = chain.where("ends").groupBy("key", F.floor(F.col("conv") / IDS).alias("block")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    blocks = blocks.select("key", "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_digests, "key binary, ends_sha256 string")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _to_ancestors(nodes: DataFrame, level: int, height: int) -> DataFrame:
    """leaves and saved of nodes, for each of their ancestors of this level in reach."""
    place = (F.col("depth") / height**level).cast("bigint") % height
    reach = F.when(place == 0, height).otherwise(place)
    ancestors = F.transform(F.sequence(F.lit(0), (reach - 1).cast("int")), lambda j: F.substring("up", (j + level * height) * KEY + 1, F.lit(KEY)))
    return nodes.where("depth > 0").select(F.explode(ancestors).alias("key"), "leaves", "saved")


def totals(nodes: DataFrame, deepest: int, height: int = HEIGHT, level: int = 0) -> DataFrame:
    """key, leaves, saved summed over each node's subtree. nodes: key, depth, up, leaves, saved; those of depths that are multiples of height**level."""
    step = height**level
    top = F.col("depth") % (step * height) == 0
    inside = common.written(_sums(nodes.select("key", "leaves", "saved").unionByName(_to_ancestors(nodes.where(~top), level, height))))
    if deepest < step * height:
        return inside
    tops = common.written(nodes.where(top).select("key", "depth", "up").join(inside, "key"))
    complete = totals(tops, deepest, height, level + 1)
    above = _to_ancestors(tops.select("key", "depth", "up").join(complete, "key"), level, height)
    return common.written(_sums(inside.unionByName(above)))


def prefix_trie(sequences: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes of the trie of sequences (as rebuilt gives them): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = sequences.repartition("conv").sortWithinPartitions("conv", "part", "at").select("conv", "digest", "size")
    chain = common.written(rows.mapInArrow(_chained(height), _CHAIN_DDL))
    nodes = chain.groupBy("key").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("depth", "parent", "size", "up")))
    nodes = common.written(nodes)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    own = common.written(own.withColumns({"leaves": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("size")}))
    deepest = own.agg(F.max("depth")).first()[0] or 0
    sums = totals(own.select("key", "depth", "up", "leaves", "saved"), deepest, height)
    parents = common.small(own.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    found = own.drop("leaves", "saved", "up").join(sums, "key").join(_ends(chain), "key", "left").join(parents, "parent", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    turns = common.written(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie(rebuilt(turns))


#: CRC-32 of a decimal number, bit by bit; the bytes of decimals are their code points.
_CRC = """xor(list_reduce([CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')], lambda a, b:
  list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(a, b)), 4294967295), 4294967295)"""
ORACLE = f"""
WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {_CRC} % {HEADS} AS h, c - c % {FAMILY} AS f FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT ids.c, 0 AS part, t.i, role, text FROM ids JOIN t ON t.c = ids.f AND t.i <= ids.h WHERE ids.c <> ids.f
  UNION ALL SELECT ids.c, 1, t.i, role, text FROM ids JOIN t ON t.c = ids.c WHERE t.i > ids.h OR ids.c = ids.f),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, role, text FROM r),
p AS (SELECT c, 0 AS d, '' AS key, '' AS parent, 0 AS size FROM ids
  UNION ALL SELECT n.c, n.d, sha256(p.key || strlen(n.role) || ':' || n.role || n.text), p.key, length(n.text) FROM p JOIN n ON n.c = p.c AND n.d = p.d + 1),
last AS (SELECT c, max(d) AS d FROM p GROUP BY c),
node AS (SELECT p.key, min(p.c) AS conv_id, any_value(p.d) AS depth, any_value(p.parent) AS parent, any_value(p.size) AS size, count(*) AS n_convs,
  string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (last.d = p.d) AS ends FROM p JOIN last ON last.c = p.c GROUP BY p.key),
kids AS (SELECT parent AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY parent),
v AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids ON kids.key = node.key),
s AS (SELECT p.key, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved FROM v JOIN p ON p.c = v.conv_id AND p.d <= v.depth GROUP BY p.key)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN s ON s.key = v.key LEFT JOIN v up ON up.key = v.parent AND v.depth > 0
"""
