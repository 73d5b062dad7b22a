"""Line dedup: levelled sorted runs of line hashes, in DataFrame operations alone.

A line's key is the line stripped of blanks at both ends, A-Z lower-cased; it is held as two 64-bit hashes. A run is a table of
(h1, h2, n documents, top doc_id), bucketed by the hashes and sorted in each bucket. A batch of documents sums its own keys, merge-anti-joins
every live run's settled keys (those that enough documents hold, of which no more need be known) and adds what is left as a run of level 0;
once a level has two runs, they are compacted into one of the next level, which sums n. As all runs have the same buckets, the one shuffle
is that of a batch's own sums: merging and compacting exchange nothing. Batches come by descending doc_id, so a settled key's top
is the largest doc_id that holds it. What the last compaction says is applied to the texts.

Edge cases: a null or empty text is one empty line; rows that share a doc_id are one document and count once (all of them
keep a key whose largest doc_id is theirs); null doc_ids are one document, smaller than all others; ties do not arise, as doc_ids are
distinct or one document; a very long text is split as a whole, its lines are rows; equal rows get equal results; extra columns, whatever
their names, are ignored, or pass through drop_lines; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, LEAST, BATCHES = 20, 3, 4
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of a bucket, about, and buckets of a run at most, as Spark bounds them; beyond, buckets are larger and their sorts spill.
BUCKET_ROWS, MAX_BUCKETS = 4 << 20, 65_536
#: Scans of bucketed tables tell that their files are sorted, if this is set when a plan is made.
_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_SORTED, "false")
    spark.conf.set(_SORTED, "true")
    try:
        yield
    finally:
        spark.conf.set(_SORTED, before)


class LineRuns:
    """Runs of line hashes as bucketed, sorted tables; batches must come by descending doc_id."""

    def __init__(self, spark: SparkSession, buckets: int, least: int = LEAST):
        self.spark, self.buckets, self.least = spark, buckets, least
        self.name, self.made = f"line_runs_{uuid.uuid4().hex}", 0
        self.levels: list[list[str]] = []

    def live(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.made}"
        self.made += 1
        with _sorted_scans(self.spark):
            rows.select("h1", "h2", "n", "top").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def unsettled(self, lines: DataFrame) -> DataFrame:
        """h1, h2, n, top of a batch's keys (h1, h2, doc_id; one row a document and key) that no run has settled."""
        rows = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        for table in self.live():
            settled = self.spark.table(table).where(F.col("n") >= self.least).select("h1", "h2")
            rows = rows.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        return rows

    def add(self, lines: DataFrame) -> None:
        """One more run, and a merge wherever a level has two."""
        self._write(self.unsettled(lines), 0)
        level = 0
        while len(self.levels[level]) > 1:
            self._merge(level, level)
            level += 1

    def _merge(self, one: int, other: int) -> None:
        """A run of each of two levels (or both of one) become one of the level above the second; their tables go.

        A full outer merge join of two sorted runs exchanges and sorts nothing. (A union of bucketed tables would do for any number, but
        Spark 4.1 takes its partitions to be theirs and then sums them apart: wrong sums.)
        """
        old = [self.levels[one].pop(0), self.levels[other].pop(0)]
        with _sorted_scans(self.spark):
            left, right = (self.spark.table(t).select("h1", "h2", F.col("n").alias(f"n{i}"), F.col("top").alias(f"top{i}")) for i, t in enumerate(old))
            both = left.hint("merge").join(right, ["h1", "h2"], "full")
            n = F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))
            self._write(both.select("h1", "h2", n.alias("n"), F.greatest("top0", "top1").alias("top")), other + 1)
        self._drop(old)

    def settled(self) -> DataFrame:
        """h1, h2, top of the keys that at least `least` documents hold, kept in the checkpoint folder; the runs go."""
        while len(self.live()) > 1:
            one, other = [k for k, level in enumerate(self.levels) if level][:2]
            self._merge(one, other)
        (last,) = self.live()
        out = common.written(self.spark.table(last).where(F.col("n") >= self.least).select("h1", "h2", "top"))
        self._drop([last])
        return out

    def _drop(self, tables: list[str]) -> None:
        for table in tables:
            self.spark.sql(f"DROP TABLE {table}")


def split_lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashes(key: str) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), F.col(key)).alias("h2")


def line_keys(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, h1, h2: one row for each document and distinct key of at least length code points."""
    repeated = common.written(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")))
    keys = docs.select("doc_id", F.explode(F.array_distinct(F.transform(split_lines(), _key))).alias("key"))
    lines = keys.where(F.char_length("key") >= length).select("doc_id", *_hashes("key"))
    if repeated.isEmpty():
        return lines
    same, rare = F.col("doc_id").eqNullSafe(F.col("again")), common.small(repeated)
    return lines.join(rare, same, "left_anti").unionByName(lines.join(rare, same, "left_semi").distinct())


def repeated_lines(docs: DataFrame, length: int = LENGTH, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """h1, h2, top of the keys that at least `least` documents hold; top is the largest doc_id among them."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    number = F.coalesce(sum((F.when(F.col("doc_id") < c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0)), F.lit(0))
    number = F.when(F.col("doc_id").isNull(), len(set(cuts))).otherwise(number)
    lines = common.written(line_keys(docs.select("doc_id", "text"), length).withColumn("batch", number).sortWithinPartitions("batch"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // BUCKET_ROWS))
    runs = LineRuns(spark, min(buckets, MAX_BUCKETS), least)
    for k in range(len(set(cuts)) + 1):
        runs.add(lines.where(F.col("batch") == k))
    return runs.settled()


def kept_lines(docs: DataFrame, length: int = LENGTH, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """row (all columns of docs), n_lines, n_kept and kept (the text without repeated lines; null text is empty)."""
    settled = common.small(repeated_lines(docs, length, least, batches))
    rows = docs.select(common.packed(docs).alias("row"), F.col("doc_id").alias("id"), common.text_key().alias("key"), "text")
    keys = rows.select("id", F.col("key").alias("text_key"), F.posexplode(F.transform(split_lines(), _key)).alias("at", "key"))
    keys = keys.where(F.char_length("key") >= length).select("id", "text_key", "at", *_hashes("key"))
    hits = keys.join(settled, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("top")))
    gone = hits.groupBy(F.col("id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(F.collect_list("at").alias("gone"))
    gone = common.small(common.written(gone))
    found = rows.join(gone, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    found = found.withColumn("lines", split_lines())
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    found = found.withColumn("places", F.when(F.col("gone").isNull(), places).otherwise(F.array_except(places, F.col("gone"))))
    kept = F.array_join(F.transform("places", lambda i: F.get("lines", i)), "\n")
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)
    return found.select("row", F.size("lines").cast("long").alias("n_lines"), F.size("places").cast("long").alias("n_kept"), kept.alias("kept"))


def drop_lines(docs: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """docs with their texts without repeated lines; the columns of docs. A null text stays null."""
    names = [F.col(f"row.`{c}`") for c in docs.columns]
    text = F.when(F.col("row.text").isNotNull(), F.col("kept")).alias("text")
    return kept_lines(docs, length, least).select(*(text if c == "text" else n for c, n in zip(docs.columns, names, strict=True)))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    found = kept_lines(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", (F.col("n_lines") - F.col("n_kept")).alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


_BLANKS = " || ".join(f"chr({ord(c)})" for c in BLANKS)
ORACLE = f"""
WITH l AS (SELECT doc_id, i, s[i] AS line, len(s) AS n FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
k AS (SELECT *, translate(trim(line, {_BLANKS}), '{UPPER}', '{LOWER}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST}),
f AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id <> g.top AS gone FROM k LEFT JOIN g ON g.key = k.key)
SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
