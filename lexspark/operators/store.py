"""Collections of chunks: upsert by deterministic id, delete, list."""

from __future__ import annotations

import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import point_id


def with_point_ids(chunks: DataFrame, id_: str = "chunk_id") -> DataFrame:
    return chunks.withColumn("point_id", point_id(F.col(id_))).withColumn("original_id", F.col(id_))


def latest(rows: DataFrame, key: str | list[str] = "point_id", seq: str = "ingest_seq") -> DataFrame:
    """The last version of each key, a column or several; of versions with one number, the greatest by a hash of all columns."""
    tie = F.xxhash64(*(F.col(f"`{c}`") for c, k in rows.dtypes if "map<" not in k))
    w = Window.partitionBy(key).orderBy(F.desc(seq), F.desc(tie))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(target: DataFrame, batch: DataFrame, key: str = "point_id", seq: str = "ingest_seq", replace_document: str | None = None) -> DataFrame:
    """The new snapshot: target without the batch's keys, plus the batch's latest rows.

    replace_document: a column; all of target's rows with a value of the batch go, so none is left over
    when a document has fewer chunks than before.
    """
    new = latest(batch, key, seq)
    kept = target.join(new.select(key), key, "left_anti")
    if replace_document:
        kept = kept.join(new.select(replace_document).distinct(), replace_document, "left_anti")
    return kept.unionByName(new)


def counts(batch: DataFrame, valid: str = "valid") -> DataFrame:
    """(stored, failed) of a batch."""
    return batch.agg(F.count_if(valid).alias("stored"), F.count_if(~F.col(valid)).alias("failed"))


def delete(target: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    return target.join(ids.select(key).distinct(), key, "left_anti")


def existing(ids: DataFrame, chunks: DataFrame, key: str = "point_id") -> DataFrame:
    return ids.join(chunks.select(key), key, "left_semi")


def fetch(ids: DataFrame, chunks: DataFrame, key: str = "point_id") -> DataFrame:
    """A row for each id, with nulls where there is no such chunk."""
    return ids.join(chunks, key, "left")


def full_documents(chunks: DataFrame, docs: DataFrame, dates: tuple[str, ...] = (), fields: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with their document's fields: the document wins, but for dates the chunk does; text falls back to the chunk."""
    renamed = docs.select("document_id", F.col("text").alias("__text"), *(F.col(c).alias(f"__{c}") for c in (*dates, *fields)))
    joined = chunks.join(renamed, "document_id", "left")
    merged = {c: F.coalesce(f"__{c}", c) for c in fields} | {c: F.coalesce(c, f"__{c}") for c in dates} | {"text": F.coalesce("__text", "text")}
    return joined.withColumns(merged).drop("__text", *(f"__{c}" for c in (*dates, *fields)))


def join_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors; the job fails at the first chunk without a vector, or vector without a chunk.

    One pass: an outer join whose unmatched rows raise, so neither side is counted or computed beforehand.
    """
    left, right = chunks.withColumn("__chunk", F.lit(True)), vectors.withColumn("__vector", F.lit(True))
    joined = left.join(right, "chunk_id", "full")
    whole = F.col("__chunk") & F.col("__vector")
    message = F.concat(F.lit("no pair for chunk "), F.coalesce(F.col("chunk_id").cast("string"), F.lit("null")))
    return joined.where(F.when(whole, True).otherwise(F.raise_error(message).cast("boolean"))).drop("__chunk", "__vector")


#: Bytes of values of a bucket, about; fewest and most buckets of a collection; how far it may outgrow its buckets before it gets more.
BUCKET_BYTES, FEWEST, MOST, OUTGROWN = 128 << 20, 8, 65_536, 4
#: What a change needs: only its partitions are replaced; buckets by document serve joins by document and point; and unions claim no partitions
#: (Spark 4.1 takes those of a union of bucketed tables to be the tables', and then sums and joins them apart).
_SETTINGS = {"spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.unionOutputPartitioning": "false"}


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def value_bytes(rows: DataFrame) -> Column:
    """Bytes of the values of a row, about."""
    width = F.lit(0).cast("long")
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        size = F.octet_length(c) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.size(c) * 8 if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.lit(8)
        width = width + F.coalesce(size, F.lit(0))
    return width


class Collections:
    """Named collections as managed tables, one for each, and the progress table beside them.

    A key belongs to one document, as ids are made from their document's. A table is bucketed and sorted by document_id (or by its key), with as many buckets as its bytes call for, and each bucket is a partition of its
    own. An upsert reads and writes the buckets of its documents alone, and joins them where they lie: only the batch is
    exchanged, once, by the buckets that it is written to, so a bucket has a file or two however many there are. A change is first written to a table of its own, which exists only once it is complete, and then put in place; if that is cut off,
    the next change of the collection puts it in place again.
    """

    def __init__(self, spark: SparkSession, database: str = "default", bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.database, self.bucket_bytes = spark, database, bucket_bytes

    def _table(self, name: str) -> str:
        return f"{self.database}.{name}"

    @staticmethod
    def _by(rows: DataFrame) -> str:
        return next((c for c in ("document_id", "point_id") if c in rows.columns), rows.columns[0])

    def buckets(self, name: str) -> int:
        """The buckets of a collection; none if it is not bucketed."""
        return int(self._said(name, "Num Buckets") or 0)

    def _said(self, name: str, what: str) -> str | None:
        found = self.spark.sql(f"DESCRIBE EXTENDED {self._table(name)}").where(F.col("col_name") == what).select("data_type").collect()
        return found[0][0] if found else None

    def file_bytes(self, name: str) -> int:
        """Bytes of a collection's files; they are listed, not read."""
        self.spark.sql(f"ANALYZE TABLE {self._table(name)} COMPUTE STATISTICS NOSCAN")
        return int((self._said(name, "Statistics") or "0").split(" ")[0])

    def _needed(self, size: int) -> int:
        return min(MOST, max(FEWEST, -(-size // self.bucket_bytes)))

    def _save(self, rows: DataFrame, table: str, buckets: int, mode: str = "error") -> None:
        """rows as a table of that many buckets; a row's bucket is also its partition."""
        by = self._by(rows)
        placed = rows.drop("part").withColumn("part", F.pmod(F.hash(by), F.lit(buckets)))
        placed.write.mode(mode).partitionBy("part").bucketBy(buckets, by).sortBy(by).saveAsTable(table)

    def _staged(self, name: str) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary and t.name.startswith(f"{name}__next_"))

    def _put(self, name: str, staged: str) -> None:
        """Put a complete staged table in place; doing so again changes nothing."""
        rows, table = self.spark.table(self._table(staged)), self._table(name)
        if staged.startswith(f"{name}__next_all") or not self.spark.catalog.tableExists(table):
            self._save(rows, table, self.buckets(staged), "overwrite")
        else:
            rows.select(*self.spark.table(table).columns).write.mode("overwrite").insertInto(table)
        self.spark.sql(f"DROP TABLE {self._table(staged)}")
        self.spark.catalog.refreshTable(table)

    def recover(self, name: str) -> None:
        """What a change that was cut off has left complete. For the one writer of the collection; readers leave it alone."""
        with _settings(self.spark):
            for staged in self._staged(name):
                self._put(name, staged)

    def _change(self, name: str, rows: DataFrame, scope: str, buckets: int) -> None:
        staged = f"{name}__next_{scope}_{uuid.uuid4().hex}"
        self._save(rows, self._table(staged), buckets)
        self._put(name, staged)

    def write(self, name: str, chunks: DataFrame) -> None:
        """A new snapshot, with as many buckets as it needs; the rows may come from the old one."""
        self.recover(name)
        with _settings(self.spark):
            buckets = self._needed(chunks.agg(F.sum(value_bytes(chunks))).first()[0] or 0)
            self._change(name, chunks.repartition(buckets, self._by(chunks)), "all", buckets)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name)).drop("part")

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._table(name))

    def upsert(self, name: str, batch: DataFrame, key: str = "point_id", seq: str = "ingest_seq", replace_document: str | None = None, valid: Column | None = None, held: bool = False) -> tuple[int, int]:
        """Rows by key, last write wins; (stored, failed). Only buckets that the batch falls into are read and written.

        valid: what a row must be to be stored; without it, it must have a key. The batch is computed once, while it is counted, and
        persisted until it is stored; held: that is done by the caller.
        """
        self.recover(name)
        fine = F.coalesce(F.col(key).isNotNull() if valid is None else F.col(key).isNotNull() & valid, F.lit(False))
        checked = batch.withColumn("__fine", fine)
        if not held:
            checked.persist()
        try:
            stored, failed, size = checked.agg(F.count_if("__fine"), F.count_if(~F.col("__fine")), F.sum(value_bytes(batch))).first()
            rows = checked.where("__fine").drop("__fine")
            with _settings(self.spark):
                if not self.exists(name):
                    buckets = self._needed(size or 0)
                    self._change(name, self._dealt(rows, key, seq, buckets), "all", buckets)
                elif stored:
                    self._merge(name, rows, key, replace_document, seq)
        finally:
            if not held:
                checked.unpersist()
        return stored, failed

    def _dealt(self, rows: DataFrame, key: str, seq: str, buckets: int, touched: int = MOST) -> DataFrame:
        """The last version of each key, all rows of a bucket in one task; of few touched buckets, in no more tasks than those."""
        by, part = self._by(rows), F.pmod(F.hash(self._by(rows)), F.lit(buckets))
        if 2 * touched > buckets:
            return latest(rows.repartition(buckets, by), list(dict.fromkeys([by, key])), seq)
        return latest(rows.withColumn("part", part).repartition(max(1, touched), "part"), list(dict.fromkeys(["part", by, key])), seq).drop("part")

    def merged(self, name: str, rows: DataFrame, key: str, replace_document: str | None = None, seq: str = "ingest_seq") -> DataFrame:
        """The buckets of the collection that rows fall into, with their last versions in place of what they replace; the collection's side is not exchanged."""
        old, by, buckets = self.spark.table(self._table(name)), self._by(rows), self.buckets(name)
        part = F.pmod(F.hash(by), F.lit(buckets))
        parts = [r[0] for r in rows.select(part.alias("part")).distinct().collect()]  # as many as there are buckets at most
        touched = old.where(F.col("part").isin(parts)).drop("part")
        on = [by] if by in (key, replace_document) else [by, key]
        gone = rows.select(*on)
        if 2 * len(parts) > buckets:  # by the collection's buckets, or Spark exchanges both sides where those are fewer than its shuffle partitions
            gone = gone.repartition(buckets, by)
        gone = gone.distinct()
        return touched.join(gone, on, "left_anti").unionByName(self._dealt(rows, key, seq, buckets, len(parts)))

    def _merge(self, name: str, rows: DataFrame, key: str, replace_document: str | None, seq: str) -> None:
        buckets = self.buckets(name)
        self._change(name, self.merged(name, rows, key, replace_document, seq), "parts", buckets)
        size = self.file_bytes(name)
        if size > OUTGROWN * buckets * self.bucket_bytes and buckets < MOST:
            more, whole = self._needed(size), self.read(name)
            self._change(name, whole.repartition(more, self._by(whole)), "all", more)

    def delete_points(self, name: str, ids: DataFrame) -> None:
        """Rows by point_id, idempotent; ids with a document_id beside it leave the buckets of other documents alone."""
        self.recover(name)
        with _settings(self.spark):
            old, buckets = self.spark.table(self._table(name)), self.buckets(name)
            by = self._by(old.drop("part"))
            if by not in ids.columns:
                return self._change(name, delete(old, ids), "all", buckets)
            part = F.pmod(F.hash(by), F.lit(buckets)).alias("part")
            parts = {r[0] for r in ids.select(part).distinct().collect()}
            on = list(dict.fromkeys([by, "point_id"]))
            kept = old.where(F.col("part").isin(*parts)).join(ids.select(*on).distinct(), on, "left_anti").persist()
            left = {r[0] for r in kept.select("part").distinct().collect()}
            self._change(name, kept, "parts", buckets)
            kept.unpersist()
            for k in sorted(parts - left):  # nothing is left of these
                self.spark.sql(f"ALTER TABLE {self._table(name)} DROP IF EXISTS PARTITION (part = {k})")

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary and "__next_" not in t.name)

    def drop(self, name: str, document_type: str | None = None, progress: str | None = None) -> None:
        """With document_type, its rows leave the progress table too, so that a new run starts clean."""
        for table in (name, *self._staged(name)):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(table)}")
        if document_type and progress and self.exists(progress):
            self.write(progress, self.read(progress).where(F.col("document_type") != document_type))
