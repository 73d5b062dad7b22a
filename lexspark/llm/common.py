"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of values up to which a table may be sent to every executor; beyond either Spark joins by shuffling.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share, as spark.checkpoint.dir names it.

    Only on a single machine (local master), and only where that is not set, a temporary folder is used.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark deletes the shuffle files of an execution that has ended, if this is set when its plan is made.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage there; the shuffle files that led there go."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """Write as Parquet to the shared checkpoint folder and read from there; smaller than a checkpoint, for tables that are read by columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(field.dataType, T.ArrayType):
        if isinstance(field.dataType.elementType, T.StringType):
            return F.octet_length(F.array_join(c, "")) + 4 * F.size(c)
        return F.size(c) * 8
    return F.lit(8)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the table's rows and the bytes of its values are within the limits for a broadcast."""
    width = sum((F.coalesce(_width(f), F.lit(0)) for f in df.schema.fields), F.lit(0))
    n, total = df.agg(F.count("*"), F.sum(width.cast("long"))).first()
    return n <= rows and (total or 0) <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a table that fits; else Spark shuffles. Give it one that is cheap to read twice, such as a durable one."""
    return F.broadcast(df) if fits(df, rows, size) else df


def sampled(share: Column | float, *salt: Column) -> Column:
    """Whether a row is of a sample of about this share, by 63 bits of a hash of the salt; true for all rows from a share of 1 on."""
    place = F.shiftrightunsigned(F.xxhash64(*salt), 1).cast("double") / float(1 << 63)
    return place < (F.lit(share) if isinstance(share, float) else share)


def text_key(text: str = "text") -> Column:
    """Tells rows apart that share a doc_id, and spreads rows whose doc_id is null."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no column beside it can clash with theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on the named columns, for joins."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def with_sum_before(counts: DataFrame, key: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """counts with the sum of value over all rows of smaller key (bigint, unique), in two levels.

    Blocks of keys are summed first, so that the one task that orders the blocks gets a row for each of them.
    """
    blocked = counts.withColumn("__block", F.floor(F.col(key) / block))
    every = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy("__block").agg(F.sum(value).alias("__sum")).select("__block", F.coalesce(F.sum("__sum").over(every), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy("__block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    running = blocked.withColumn("__own", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, "__block")
    return running.withColumn(out, F.col("__own") + F.col("__ahead")).drop("__block", "__own", "__ahead")


def total_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
