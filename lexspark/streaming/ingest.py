"""Resumable ingestion of a folder of documents: file streams into a state machine, and work on what it hands out.

Three streams meet in the machine, by groups of documents: deliveries (the source folder), requests to take a document once more, and the outcomes of the
work, which the work itself writes. Its state stays in the state store, so no batch reads the log, however long it is. Each
transition is a row of the log, a table partitioned by stream and batch, of which a batch that runs again replaces its own part.
Chunks are upserted by deterministic ids before an outcome is written, so a batch that is cut off and runs again gives the same collection.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.tokenizers import quarter
from ..operators import progress, store
from ..operators.chunk import chunk_documents
from ..operators.embed import Embedder, Extractor, embed, extract_fields
from . import status

DOCUMENTS = "document_id string, text string"
OUTCOME = "document_id string, event string, error_message string, attempt bigint, flagged boolean"
STATES = "document_id string, document_type string, status string, error_message string, seq bigint, attempt bigint, requires_reprocessing boolean, at timestamp, stream string, batch bigint"
RUNS = "run_id string, document_type string, started_at timestamp, completed_at timestamp, total_documents bigint, completed_documents bigint, failed_documents bigint"
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


@dataclass(frozen=True)
class Documents:
    """What is delivered: its schema, the column of its id, and how it becomes document_id, text and metadata columns.

    version: a column by which the latest of several deliveries is known; without one, it is the time of the file. extract: whether citation
    lists, topics and flags are found in the text.
    """

    schema: str | StructType = DOCUMENTS
    key: str = "document_id"
    prepare: Callable[[DataFrame], DataFrame] = lambda raw: raw.select("document_id", "text")
    metadata: tuple[str, ...] = ()
    topics: str | None = None
    extract: bool = False
    version: str | None = None


@dataclass(frozen=True)
class Work:
    """What is done with documents. kind: how they are cut; fn: embedder; count: token counter; extractor: as in extract_fields."""

    kind: str = "order"
    dim: int = 64
    fn: Embedder | None = None
    count: Callable[[str], int] = quarter
    extractor: Extractor | None = None


def process(raw: DataFrame, of: Documents, work: Work) -> tuple[DataFrame, DataFrame]:
    """(chunks with ids, vectors, metadata and error_message, documents without content with the reason). A bad document does not stop the others: it
    gives one row that is no chunk, but says why. So both are made in one go."""
    docs = of.prepare(raw).select("document_id", *of.metadata, "text")
    found = extract_fields(docs, topics=of.topics, kind=work.kind, fn=work.extractor) if of.extract else docs.withColumn("requires_reprocessing", F.lit(False))
    ok = F.coalesce(F.col("text"), F.lit("")) != ""
    empty = docs.where(~ok).select("document_id", F.lit("no content").alias("error_message"))
    chunks = store.with_point_ids(chunk_documents(found.where(ok), work.kind, count=work.count, errors=True))
    return embed(chunks, "text", work.dim, work.fn), empty


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _table(spark: SparkSession, name: str, schema: str, *partitions: str) -> None:
    """The table, empty if it is new."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.partitionBy(*partitions).saveAsTable(name)


class Ingestion:
    """A folder's stream into a collection, with its log, its checkpoint, and beside that the outcomes and requests that the stream reads too."""

    def __init__(self, spark: SparkSession, source: str, checkpoint: str, collection: str, log: str, of: Documents | None = None, work: Work | None = None, timeout: float = 3600.0, skew: str = "1 hour"):
        self.spark, self.source, self.checkpoint, self.collection, self.log = spark, source, checkpoint, collection, log
        self.of, self.work, self.timeout, self.skew = of or Documents(), work or Work(), timeout, skew
        self.outcomes, self.requests, self.stream = f"{checkpoint}-outcomes", f"{checkpoint}-requests", hashlib.md5(checkpoint.encode()).hexdigest()
        self.tables, self.wrote = store.Collections(spark), False

    def _payload(self, rows: DataFrame, event: str, version: str | None) -> DataFrame:
        newest = F.col(version).cast("timestamp") if version else F.col("_metadata.file_modification_time")
        return rows.select(
            F.col(self.of.key).cast("string").alias("document_id"), F.lit(event).alias("event"), newest.alias("version"), F.lit(None).cast("string").alias("error_message"),
            F.lit(None).cast("bigint").alias("attempt"), F.lit(None).cast("boolean").alias("flagged"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("payload"),
        )

    def _events(self) -> DataFrame:
        read = self.spark.readStream
        ended = read.schema(OUTCOME).parquet(self.outcomes).withColumns({"version": F.lit(None).cast("timestamp"), "payload": F.lit(None).cast("string")})
        delivered = self._payload(read.schema(self.of.schema).parquet(self.source), status.DELIVERED, self.of.version)
        asked = self._payload(read.schema(self.of.schema).parquet(self.requests), status.RETRY, None)
        return delivered.unionByName(asked).unionByName(ended).withColumn("at", F.current_timestamp())

    def _known(self) -> DataFrame:
        """The last states that other streams have left in the log."""
        other = self.spark.table(self.log).where((F.col("stream") != self.stream) & (F.col("document_type") == self.work.kind))
        return progress.current(other).select("document_id", "status", "seq", "attempt")

    def _batch(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            rows = batch.withColumns({"document_type": F.lit(self.work.kind), "stream": F.lit(self.stream), "batch": F.lit(number).cast("bigint")})
            with _set(batch.sparkSession, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
                rows.select(*self.spark.table(self.log).columns).write.mode("overwrite").insertInto(self.log)
            todo = batch.where("payload IS NOT NULL")
            if not todo.isEmpty():
                self._work(todo, number)
        finally:
            batch.unpersist()

    def _work(self, todo: DataFrame, number: int) -> None:
        raw = todo.select(F.from_json("payload", self.of.schema).alias("raw")).select("raw.*")
        made, empty = process(raw, self.of, self.work)
        made = made.withColumn("ingest_seq", F.lit(number).cast("bigint")).persist()
        try:
            chunks, failed = made.where("error_message IS NULL").drop("error_message"), made.where("error_message IS NOT NULL").select("document_id", "error_message")
            self.tables.upsert(self.collection, chunks, replace_document="document_id", held=True)
            flags = chunks.groupBy("document_id").agg(F.max(F.col("embed_failed") | F.col("requires_reprocessing")).alias("flagged"))
            ended = todo.select("document_id", "attempt").join(empty.unionByName(failed), "document_id", "left").join(flags, "document_id", "left")
            event = F.when(F.col("error_message").isNull(), progress.COMPLETED).otherwise(progress.FAILED)
            ended = ended.select("document_id", event.alias("event"), "error_message", "attempt", F.coalesce("flagged", F.lit(False)).alias("flagged"))
            ended.write.mode("append").parquet(self.outcomes)
            self.wrote = True
        finally:
            made.unpersist()

    def _pass(self) -> None:
        with _set(self.spark, _PROVIDER, _ROCKS), _set(self.spark, _IDLE, "false"):  # timers go with the batches that bring something
            moves = status.transitions(self._events(), self._known(), self.timeout, self.skew)
            query = moves.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).outputMode("append").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:  # batches write from a session of their own
            for name in filter(self.spark.catalog.tableExists, (self.log, self.collection)):
                self.spark.catalog.refreshTable(name)

    def run(self) -> None:
        """Take what is new in the folders and stop; a later call takes up from there. The run is a row of the table {log}_runs."""
        _table(self.spark, self.log, STATES, "stream", "batch")
        _table(self.spark, f"{self.log}_runs", RUNS)
        for folder, schema in ((self.outcomes, OUTCOME), (self.requests, self.of.schema)):
            self.spark.createDataFrame([], schema).write.mode("append").parquet(folder)
        began, self.wrote = time.time(), False
        self._pass()
        if self.wrote:  # the outcomes of this pass
            self._pass()
        runs = self.spark.createDataFrame([(uuid.uuid4().hex, self.work.kind, began, time.time())], "run_id string, document_type string, started double, completed double")
        runs = runs.select("run_id", "document_type", F.timestamp_seconds("started").alias("started_at"), F.timestamp_seconds("completed").alias("completed_at"))
        runs = progress.close_run(runs, progress.current(self.states()).withColumn("processing_time_ms", F.lit(None).cast("bigint")))
        runs.select(*self.spark.table(f"{self.log}_runs").columns).write.mode("append").insertInto(f"{self.log}_runs")

    def states(self) -> DataFrame:
        return self.spark.table(self.log)

    def waiting(self) -> DataFrame:
        """Documents to take again: pending, failed, or completed with a flag. What is in work is pending again after its time."""
        last = progress.current(self.states()).where(F.col("document_type") == self.work.kind)
        return last.where(F.col("status").isin(progress.PENDING, progress.FAILED) | ((F.col("status") == progress.COMPLETED) & F.coalesce("requires_reprocessing", F.lit(False)))).select("document_id", "document_type", "status")

    def retry(self) -> int:
        """Ask once more for what is waiting, from the source folder, of which the stream has passed those files; the number of documents.

        Of several deliveries of a document the latest is asked for.
        """
        again = self.waiting()
        n = again.count()
        if n:
            rows = self.spark.read.schema(self.of.schema).parquet(self.source)
            version = F.col(self.of.version) if self.of.version else F.col("_metadata.file_modification_time")
            rows = rows.select(F.col(self.of.key).cast("string").alias("__id"), F.struct(version.alias("v"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")).alias("__row"))
            rows = rows.join(again.select(F.col("document_id").alias("__id")), "__id", "left_semi")
            last = rows.groupBy("__id").agg(F.max("__row").alias("last"))
            last.select("last.row.*").write.mode("append").parquet(self.requests)
            self.run()
        return n
