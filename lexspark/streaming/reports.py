"""Reports on the ingestion log that grow with it: throughput by window of event time, and sketches of distinct documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.progress import COMPLETED, FAILED
from ..operators.store import latest

#: Registers of a sketch are 2**SKETCH; the standard error of an estimate is about 1.04 / sqrt(2**SKETCH), 1.6 % here.
SKETCH = 12


def counts(log: DataFrame, window: str, at: str = "at") -> DataFrame:
    """For each window of event time and document type: events, completed, failed, their times summed, and a sketch of the documents.

    Every figure can be merged with that of other windows. The same for a table and, with a watermark on `at`, for a stream.
    """
    done = F.col("status") == COMPLETED
    return log.groupBy(F.window(at, window).alias("window"), "document_type").agg(
        F.count("*").alias("n_events"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == FAILED).alias("failed"),
        F.sum(F.when(done, F.col("processing_time_ms"))).alias("time_ms"), F.count(F.when(done, F.col("processing_time_ms"))).alias("n_timed"),
        F.hll_sketch_agg("document_id", SKETCH).alias("documents"),
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *("document_type", "n_events", "completed", "failed", "time_ms", "n_timed", "documents"))


def rates(found: DataFrame) -> DataFrame:
    """Success in percent, mean time of completed events and events a minute of each window."""
    ended = F.col("completed") + F.col("failed")
    minutes = (F.unix_micros("window_end") - F.unix_micros("window_start")) / 60e6
    return found.withColumns({
        "success_rate": F.when(ended > 0, F.col("completed") / ended * 100).otherwise(0.0), "avg_processing_time_ms": F.try_divide("time_ms", "n_timed"), "throughput_per_minute": ended / minutes,
    })


def distinct_documents(found: DataFrame, *by: Column | str) -> DataFrame:
    """About how many documents there were in all windows, or by `by`: sketches are merged, the log is not read again."""
    return found.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("documents")).alias("n_distinct"))


class WindowReport:
    """A report kept up by a stream. A run takes what is new in the log; windows that no event can reach any more leave the state.

    lateness: how far behind the latest event one may come in a later batch and still be counted; older ones are dropped, as the watermark
    says. Each batch writes the windows that it changed to a folder of its own, which is overwritten if the batch runs again.
    """

    def __init__(self, spark: SparkSession, path: str, window: str, lateness: str):
        self.spark, self.path, self.window, self.lateness = spark, path, window, lateness

    def run(self, log: DataFrame, at: str = "at") -> None:
        """Take all that the stream `log` (document_id, document_type, status, processing_time_ms, at) has now, then stop."""
        changed = counts(log.withWatermark(at, self.lateness), self.window, at)
        keep = lambda rows, n: rows.withColumn("seq", F.lit(n)).write.mode("overwrite").parquet(f"{self.path}/windows/batch={n}")
        query = changed.writeStream.outputMode("update").option("checkpointLocation", f"{self.path}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()

    def read(self) -> DataFrame:
        """The last state of each window."""
        rows = self.spark.read.parquet(f"{self.path}/windows").drop("batch")
        keyed = rows.withColumn("__key", F.struct("window_start", "document_type"))
        return latest(keyed, "__key", "seq").drop("__key", "seq")
