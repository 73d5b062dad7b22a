"""The ingestion log: what is pending, done or failed, and how fast it goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import duration_text
from .store import latest

PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"
KEYS = ["document_id", "document_type"]


def without_completed(documents: DataFrame, progress: DataFrame) -> DataFrame:
    return documents.join(progress.where(F.col("status") == COMPLETED).select(*KEYS), KEYS, "left_anti")


def append_new(progress: DataFrame, listed: DataFrame) -> DataFrame:
    """progress with the listed ids that it lacks as pending rows."""
    new = listed.dropDuplicates(KEYS).join(progress.select(*KEYS), KEYS, "left_anti")
    return progress.unionByName(new.withColumn("status", F.lit(PENDING)), allowMissingColumns=True)


def current(log: DataFrame) -> DataFrame:
    """The last state of each document of an append-only log (seq)."""
    keyed = log.withColumn("__key", F.concat_ws("\u0001", *KEYS))
    return latest(keyed, "__key", "seq").drop("__key")


def reset_interrupted(progress: DataFrame) -> DataFrame:
    """After a crash, what was in work is pending again."""
    return progress.withColumn("status", F.when(F.col("status") == PROCESSING, PENDING).otherwise(F.col("status")))


def pending(progress: DataFrame, limit: int | None = None, within: DataFrame | None = None) -> DataFrame:
    """Pending and failed documents, oldest first; within: only those of the present input."""
    found = progress.where(F.col("status").isin(PENDING, FAILED))
    found = found.join(within.select(*KEYS).distinct(), KEYS, "left_semi") if within is not None else found
    found = found.orderBy("created_at", "document_id")
    return found.limit(limit) if limit is not None else found


def recent_failures(progress: DataFrame, n: int = 10) -> DataFrame:
    return progress.where(F.col("status") == FAILED).orderBy(F.desc("updated_at"), "document_id").limit(n)


def last_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def statistics(progress: DataFrame) -> DataFrame:
    """Counts by status, success rate in percent and mean time of completed rows, for each document type."""
    n = lambda status: F.count_if(F.col("status") == status)
    ended = n(COMPLETED) + n(FAILED)
    mean = F.avg(F.when(F.col("status") == COMPLETED, F.col("processing_time_ms")))
    return progress.groupBy("document_type").agg(
        *(n(s).alias(s) for s in (PENDING, PROCESSING, COMPLETED, FAILED)), F.count("*").alias("total"),
        F.when(ended > 0, n(COMPLETED) / ended * 100).otherwise(0.0).alias("success_rate"), F.nullif(F.floor(mean).cast("long"), F.lit(0)).alias("avg_processing_time_ms"),
    )


def close_run(runs: DataFrame, progress: DataFrame) -> DataFrame:
    """Runs with the counts of their document type."""
    found = statistics(progress).select("document_type", F.col("total").alias("total_documents"), F.col(COMPLETED).alias("completed_documents"), F.col(FAILED).alias("failed_documents"))
    return runs.join(found, "document_type", "left").na.fill(0, ["total_documents", "completed_documents", "failed_documents"])


def throughput(progress: DataFrame, elapsed_seconds: float, total: int | None = None) -> DataFrame:
    """Processed, failed, success in percent, documents a minute, mean time, and with a total the rest and its time."""
    done, failed = F.count_if(F.col("status") == COMPLETED), F.count_if(F.col("status") == FAILED)
    out = progress.agg(done.alias("documents_processed"), failed.alias("documents_failed"), F.avg(F.when(F.col("status") == COMPLETED, F.col("processing_time_ms"))).alias("avg_processing_time_ms"))
    both = F.col("documents_processed") + F.col("documents_failed")
    out = out.withColumns({
        "total_processed": both, "success_rate": F.when(both > 0, F.col("documents_processed") / both * 100).otherwise(0.0),
        "throughput_per_minute": both / elapsed_seconds * 60 if elapsed_seconds > 0 else F.lit(0.0),
    })
    if total:
        left = F.lit(total) - F.col("total_processed")
        eta = F.when(F.col("total_processed") > 0, left / (F.col("total_processed") / elapsed_seconds))
        out = out.withColumns({"remaining_documents": left, "eta_seconds": eta, "eta_formatted": duration_text(eta), "completion_percentage": F.col("total_processed") / total * 100})
    return out
