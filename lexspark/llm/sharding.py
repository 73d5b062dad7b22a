"""Two-pass external shuffle into numbered shards.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash. Pass two sorts each
bucket into a canonical order and applies a seeded Fisher-Yates permutation. A record's place in the
whole shuffled order is its bucket's offset plus its place in the bucket; records are dealt to shards
round-robin by that place, so shard sizes differ by one row at most (the law "rows").

Edge cases: null doc_id or text are ordinary records (null text has size 1); equal rows are kept, each
with a slot of its own, and those that more than HEAVY rows share are spread over buckets; rows that tie in
every sortable column may change places between runs; an empty table gives no rows; input columns
named shard or slot are replaced, all others pass through whatever their names. A bucket holds whole records, so
one longer than bucket_bytes makes its bucket that much larger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

N_SHARDS, SEED, BUCKET_BYTES, HEAVY = 16, 20_240_501, 12 << 20, 1_000


def _scattered(kept: DataFrame, n_buckets: int, seed: int, heavy: int) -> DataFrame:
    """row (all columns) and bucket. Equal (doc_id, text) share a bucket, but for more than heavy of them."""
    rows = kept.select(common.packed(kept).alias("row"), F.col("doc_id").alias("id"), common.text_key().alias("key"))
    often = common.durable(rows.groupBy("id", "key").agg(F.count("*").alias("n")).where(F.col("n") > heavy))
    often = common.small(often.select(F.col("id").alias("often_id"), F.col("key").alias("often_key"), F.ceil(F.col("n") / heavy).alias("parts")))
    rows = rows.join(often, F.col("id").eqNullSafe(F.col("often_id")) & (F.col("key") == F.col("often_key")), "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.monotonically_increasing_id(), "parts")).otherwise(0)
    return rows.select("row", F.pmod(F.xxhash64(F.lit(seed), "id", "key", part), F.lit(n_buckets)).alias("bucket"))


def shard_records(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, heavy: int = HEAVY) -> DataFrame:
    """All columns of docs plus shard int and slot long (gapless from 0 in each shard)."""
    kept = docs.drop("shard", "slot")
    n_buckets = max(1, -(-common.total_bytes(docs) // bucket_bytes))
    bucketed = _scattered(kept, n_buckets, seed, heavy)
    # One row a bucket: the bucket count bounds what is summed and broadcast.
    counts = common.durable(bucketed.groupBy("bucket").agg(F.count("*").alias("n")))
    offsets = common.small(common.durable(common.with_sum_before(counts, "bucket", "n", "offset").select(F.col("bucket").alias("b"), "offset")))
    sortable = [i for i, (_, k) in enumerate(kept.dtypes) if k in ("string", "bigint", "int", "double", "date", "boolean")]
    order = sorted(sortable, key=lambda i: (kept.columns[i] not in ("doc_id", "text"), i))

    def fisher_yates(table: pa.Table) -> pa.Table:
        columns = table.column("row").combine_chunks().flatten()
        by = pa.table([columns[i] for i in order], [str(i) for i in order])
        sorted_ = pa.compute.sort_indices(by, sort_keys=[(str(i), "ascending") for i in order])
        rng = np.random.default_rng([seed, table.column("bucket")[0].as_py()])
        table = table.take(sorted_.take(pa.array(rng.permutation(table.num_rows))))
        return table.append_column("place", pa.array(np.arange(table.num_rows, dtype="int64")))

    schema = T.StructType([*bucketed.schema.fields, T.StructField("place", T.LongType())])
    shuffled = bucketed.groupBy("bucket").applyInArrow(fisher_yates, schema)
    place = F.col("offset") + F.col("place")
    return shuffled.join(offsets, F.col("bucket") == F.col("b")).select("row.*", (place % n_shards).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """One folder a shard, its rows in slot order in files of contiguous slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shard_records(common.documents(spark, sf_dir)).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
