"""Mixing sources to target weights by weighted fair queueing.

Each document of a source, in a seeded shuffled order, gets a virtual finish time: the source's tokens
up to and including it, divided by the source's target. Documents may be repeated (epochs). All copies
are put into bins by finish time, so that the global order is a range sort, and the longest prefix of
that order that fits into the total budget is taken.

Running sums are two-level (sum of earlier ranges plus running sum within one), and ranges and bins grow in number with
the rows, so that no task gets a whole source however large it is. Only ids, sizes and hashes are shuffled, never texts.

Edge cases: null source is a source, ordered last; null or blank text has size 0 and is never needed to
fill a budget; a very long text is counted whole; rows that tie in doc_id and size are ordered by a hash of all their columns, and
those that are equal in all columns are separate documents; a null doc_id is placed by its text; other columns, whatever
their names, pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: Least hex digits of the hash that name a range of the shuffled order, rows of a range, bins of a unit of virtual time (for
#: so many digits; 16 times as many for each further one), and the time from which bins widen.
RANGE_DIGITS, RANGE_ROWS, BINS, LINEAR = 3, 50_000, 8_192, 8


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target. One row a source; weights go round by code point order, null last.

    Water filling: in ascending order of cap over weight, a source is capped while the level that the
    rest would get is at least its ratio.
    """
    per = common.durable(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rn") - 1) % len(weights) + 1)
    per = per.withColumn("rn", rank).withColumn("w", weight).withColumn("cap", F.col("source_size") * epochs)
    by = Window.orderBy(F.col("cap") / F.col("w"), "rn")
    earlier, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    per = per.withColumn("place", F.row_number().over(by)).withColumn("level", left / F.sum("w").over(onward))
    per = per.withColumn("capped", F.col("level") >= F.col("cap") / F.col("w"))
    level = F.min_by("level", F.when(~F.col("capped"), F.col("place"))).over(Window.partitionBy())
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("w")).alias("target"))


def _queued(docs: DataFrame, weights: tuple[int, ...], share: float, epochs: int, seed: str) -> DataFrame:
    """A row for each copy: the row's values, epoch, and taken, whether the copy lies within the budget."""
    by_id = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    base = docs.select("doc_id", "source", words().alias("size"), _row_key(docs).alias("key"), F.md5(F.concat(F.lit(f"{seed}:"), by_id)).alias("h"), F.monotonically_increasing_id().alias("rid"))
    base = common.durable(base)
    n, total = base.agg(F.count("*"), F.sum("size")).first()
    digits = max(RANGE_DIGITS, len(f"{n // RANGE_ROWS:x}"))
    n_bins = BINS << 4 * (digits - RANGE_DIGITS)
    base = base.withColumn("range", F.substring("h", 1, digits))
    targets = common.small(common.durable(source_targets(base, weights, share, epochs)))
    shuffled = ("h", "doc_id", "size", "key", "rid")
    ranges = base.groupBy("source", "range").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    within = Window.partitionBy("source", "range").orderBy(*shuffled).rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumn("run", F.sum("size").over(within))
    rows = rows.join(ranges, common.same(rows, ranges, "source", "range")).select(rows["*"], (F.col("run") + F.col("ahead")).alias("cum"))
    rows = rows.join(targets, common.same(rows, targets, "source")).select(rows["*"], "source_size", "target")
    copies = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    finish = F.when(F.col("target") > 0, (F.col("cum") + F.col("epoch") * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
    time = F.col("finish")
    even, widening = F.floor(time * n_bins), F.floor(F.log2(F.greatest(time, F.lit(LINEAR)) / LINEAR) * 1024) + LINEAR * n_bins
    copies = copies.withColumn("finish", finish).withColumn("bin", F.when(time < LINEAR, even).otherwise(widening))
    bins = common.durable(copies.groupBy("bin").agg(F.sum("size").alias("n")))
    bins = common.small(common.durable(common.with_sum_before(bins, "bin", "n", "before").select(F.col("bin").alias("b"), "before")))
    queue = Window.partitionBy("bin").orderBy("finish", F.col("source").asc_nulls_last(), *shuffled, "epoch").rowsBetween(Window.unboundedPreceding, 0)
    placed = copies.withColumn("run", F.sum("size").over(queue)).join(bins, F.col("bin") == F.col("b"))
    return placed.withColumn("taken", F.col("run") + F.col("before") <= F.lit(float(share * (total or 0))))


def _row_key(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed: rows with equal ones are the same for the mix."""
    return F.xxhash64(*(F.col(f"`{c}`") for c, k in docs.dtypes if "map<" not in k and k != "variant"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row for each row of docs."""
    return _queued(docs, weights, share, epochs, seed).groupBy("rid").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")), F.count_if("taken").alias("copies")
    ).drop("rid")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it was taken, with docs' own columns.

    What is taken of a source in an epoch is a prefix of its shuffled order, so the last place taken (a row for
    each source and epoch) decides for every row where it stands, and no text is shuffled. Rows that are equal in all
    columns are told apart by their place in docs, which must be the same when it is read twice (files are).
    """
    place = lambda d, k: F.struct(F.col("h"), F.col(d).alias("doc_id"), F.col("size"), F.col(k).alias("key"), F.col("rid"))
    queued = _queued(docs, weights, share, epochs, seed)
    last = common.durable(queued.where("taken").groupBy("source", "epoch").agg(F.max(place("doc_id", "key")).alias("last")))
    last = common.small(last.groupBy(F.col("source").alias("of")).agg(F.collect_list("last").alias("lasts")))
    by_id = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    own = F.struct(F.md5(F.concat(F.lit(f"{seed}:"), by_id)).alias("h"), F.col("doc_id"), words().alias("size"), _row_key(docs).alias("key"), F.monotonically_increasing_id().alias("rid"))
    rows = docs.select(common.packed(docs).alias("row"), F.col("source").alias("from"), own.alias("place"))
    rows = rows.join(last, F.col("from").eqNullSafe(F.col("of")))
    copies = F.size(F.filter("lasts", lambda x: F.col("place") <= x))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of every document."""
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = f"""
WITH base AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM per),
weighted AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, source_size * 2 AS cap FROM ranked),
levels AS (SELECT *, row_number() OVER (ORDER BY cap / w, rn) AS place,
  (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
marked AS (SELECT *, level >= cap / w AS capped FROM levels),
targets AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE)
  ELSE (SELECT arg_min(level, place) FROM marked WHERE NOT capped) * w END AS target FROM marked),
cums AS (SELECT b.*, t.source_size, t.target, sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, CASE WHEN target > 0 THEN (cum + epoch * source_size) / target ELSE 0.0 END AS finish FROM cums, (SELECT 0 AS epoch UNION ALL SELECT 1)),
queued AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, h, doc_id, size, epoch ROWS UNBOUNDED PRECEDING) AS run FROM copies)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(sum(CASE WHEN run <= 1.5 * (SELECT sum(size) FROM base) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM queued GROUP BY doc_id, size, source_size, target
"""
