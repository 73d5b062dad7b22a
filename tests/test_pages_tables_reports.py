"""Pages laid out by date, the table function of chunks, and reports that a stream keeps up."""

import glob
import json
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexspark.operators import chunk, table_function
from lexspark.sources import pages, records
from lexspark.streaming import reports

ORDER = "document_number string, title string, signing_date string, president struct<name:string>"


@pytest.fixture(scope="module")
def orders(spark):
    day = lambda i: None if i % 50 == 0 else f"2024-{i % 6 + 1:02d}-{i % 3 + 1:02d}"  # noqa: E731  # many on one day
    rows = [(str(i), f"t{i}", day(i), ("P",)) for i in range(400)] + [("7", "again", "2024-02-02", ("P",))] * 3
    return spark.createDataFrame(rows, ORDER)


@pytest.fixture(scope="module")
def folder(orders, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "in")
    pages.write_order_pages(orders, path, 20)
    return path


def keys(df):
    return sorted((r["document_number"], r["title"], r["signing_date"]) for r in df.collect())


def test_pages_hold_all_records_in_order(orders, folder):
    found = []
    for file in glob.glob(f"{folder}/*/*/*/*.json"):
        page = [json.loads(line) for line in open(file, encoding="utf-8")]
        assert len(page) == 1 and page[0]["count"] == len(page[0]["results"]) <= 20
        days = [r.get("signing_date") for r in page[0]["results"]]
        assert len({d is None for d in days}) == 1 and days == sorted(days, key=lambda d: d or "")
        if days[0]:
            assert f"first_date={days[0]}/last_date={days[-1]}/" in file
        found += [(r["document_number"], r["title"], r.get("signing_date")) for r in page[0]["results"]]
    assert sorted(found, key=str) == sorted(((r["document_number"], r["title"], r["signing_date"]) for r in orders.collect()), key=str)


def test_range_equals_a_scan(spark, orders, folder):
    for start, end in (("2024-02-02", "2024-04-01"), ("2024-01-01", "2024-12-31"), ("2024-02-02", "2024-02-02"), ("2030-01-01", "2030-01-02")):
        assert keys(pages.read_order_pages(spark, folder, start, end)) == keys(records.orders_in_range(orders, start, end))
    with pytest.raises(ValueError):
        pages.read_order_pages(spark, folder, "2024-02-02", "2024-02-01")


def test_pages_outside_the_range_are_never_opened(spark, orders, tmp_path):
    path = str(tmp_path / "in")
    pages.write_order_pages(orders, path, 20)
    broken = [f for f in glob.glob(f"{path}/*/*/*/*.json") if "first_date=2024-0" in f and f.split("first_date=")[1][:10] > "2024-03-03" or "first_date=0000" in f]
    assert len(broken) >= 5
    for file in broken:
        with open(file, "w", encoding="utf-8") as f:
            f.write("{broken")
        crc = "/".join([*file.split("/")[:-1], f".{file.split('/')[-1]}.crc"])
        open(crc, "wb").close()
    assert keys(pages.read_order_pages(spark, path, "2024-01-01", "2024-03-03")) == keys(records.orders_in_range(orders, "2024-01-01", "2024-03-03"))
    plan = pages.read_order_pages(spark, path, "2024-01-01", "2024-03-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(last_date" in plan
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        pages.read_order_pages(spark, path, "2024-01-01", "2024-12-31").collect()


def test_a_stream_takes_pages_that_come_later(spark, orders, tmp_path):
    path = str(tmp_path / "in")
    halves = [orders.where("signing_date < '2024-03-02'"), orders.where("signing_date >= '2024-03-02'")]
    for half in halves:
        pages.write_order_pages(half, path, 20, mode="append")
        stream = pages.stream_order_pages(spark, path, "2024-02-01", "2024-04-02", 3)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert keys(spark.read.parquet(str(tmp_path / "out"))) == keys(records.orders_in_range(orders, "2024-02-01", "2024-04-02"))


def test_no_orders_no_pages(spark, orders, tmp_path):
    path = str(tmp_path / "in")
    pages.write_order_pages(orders.where("false"), path)
    assert pages.read_order_pages(spark, path, "2024-01-01", "2024-12-31").count() == 0


def test_chunks_in_sql_are_those_of_the_plan(spark):
    long = "Section 1. Purpose. " + "A sentence of some words. " * 300 + "\nSec. 2. Policy. (a) one\n(b) two\n"
    docs = spark.createDataFrame([("a", long), ("b", ""), ("c", None), ("d", "short")], "document_id string, text string")
    table_function.register(spark)
    for kind in ("order", "opinion"):
        got = spark.sql("SELECT d.document_id, c.* FROM {docs} d, LATERAL chunk(d.segments, '" + kind + "') c", docs=table_function.segmented(docs, kind))
        want = chunk.chunk_documents(docs, kind)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_table_function_edges(spark):
    table_function.register(spark)
    call = lambda x: spark.sql(f"SELECT * FROM chunk({x})").collect()
    none = "cast(NULL AS array<struct<label: string, text: string>>)"
    assert call(f"{none}, 'order'") == []
    assert [tuple(r) for r in call("array(named_struct('label', 'x', 'text', cast(NULL AS string))), 'order'")] == [(0, "x", "", 0, 0, 0)]
    with pytest.raises(PySparkException, match="kind must be one of"):
        call(f"{none}, 'letter'")


LOG = "document_id string, document_type string, status string, processing_time_ms double, at timestamp"
DAY = datetime(2024, 5, 1)


def _log(spark, rows):
    return spark.createDataFrame([(f"d{i}", "order", status, ms, DAY + timedelta(hours=h)) for i, status, ms, h in rows], LOG)


@pytest.fixture
def deliver(spark, tmp_path):
    report = reports.WindowReport(spark, str(tmp_path / "report"), "1 day", "12 hours")

    def of(rows):
        _log(spark, rows).write.mode("append").parquet(str(tmp_path / "log"))
        report.run(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")))
        return {r["window_start"].day: r for r in reports.rates(report.read()).collect()}

    return of


def test_windows_over_batches_late_and_too_late_events(deliver):
    first = deliver([(0, "completed", 10.0, 1), (1, "failed", None, 2), (2, "completed", None, 23), (3, "processing", 5.0, 30)])
    assert (first[1]["n_events"], first[1]["completed"], first[1]["failed"], first[1]["avg_processing_time_ms"]) == (3, 2, 1, 10.0)
    assert first[2]["success_rate"] == 0.0 and first[2]["avg_processing_time_ms"] is None
    late = deliver([(4, "completed", 30.0, 20), (5, "completed", 1.0, 60)])  # 20 h is 10 h behind the latest event so far
    assert (late[1]["n_events"], late[1]["avg_processing_time_ms"], late[1]["throughput_per_minute"]) == (4, 20.0, 4 / 1440)
    gone = deliver([(6, "completed", 99.0, 3), (7, "failed", None, 61)])  # the first day is over
    assert gone[1]["n_events"] == 4 and (gone[3]["completed"], gone[3]["failed"]) == (1, 1)


def test_a_stream_counts_what_a_table_counts(spark, deliver, tmp_path):
    rows = [(i % 300, ("completed", "failed", "processing")[i % 3], float(i), i / 40) for i in range(2000)]
    deliver(rows[:1200])
    found = deliver(rows[1200:])
    whole = {r["window_start"].day: r for r in reports.rates(reports.counts(_log(spark, rows), "1 day")).collect()}
    assert found.keys() == whole.keys()
    for day, r in whole.items():
        for c in ("n_events", "completed", "failed", "success_rate", "throughput_per_minute"):
            assert found[day][c] == pytest.approx(r[c])


def test_sketches_merge_within_their_error(spark):
    log = spark.range(60_000).select(
        F.concat(F.lit("d"), (F.col("id") % 20_000).cast("string")).alias("document_id"), F.lit("order").alias("document_type"), F.lit("completed").alias("status"), F.lit(1.0).alias("processing_time_ms"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 10).alias("at"),
    )
    windows = reports.counts(log, "1 day")
    assert windows.count() >= 7
    assert reports.distinct_documents(windows).first()[0] == pytest.approx(20_000, rel=0.05)
    by = {r["document_type"]: r["n_distinct"] for r in reports.distinct_documents(windows, "document_type").collect()}
    assert by == {"order": pytest.approx(20_000, rel=0.05)}
    few = reports.counts(log.limit(0), "1 day")
    assert reports.distinct_documents(few).first()[0] in (0, None)
