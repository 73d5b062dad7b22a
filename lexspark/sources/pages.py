"""Paged envelopes of order records, laid out by signing date, so that a range of dates opens its own pages alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import PRESIDENT_STRUCT, PRESIDENT_TEXT, check_range, orders_in_range

#: Folders of a page: the dates of its first and last record, and its number.
LAYOUT = ("first_date", "last_date", "page")
_NO_DATE = "0000-00-00"


def write_order_pages(orders: DataFrame, path: str, page_size: int = 500, date: str = "signing_date", key: str = "document_number", mode: str = "error") -> None:
    """orders as envelopes {count, results: [...]} of at most page_size records in order of date, a file each, in folders by LAYOUT.

    One range sort; pages are cut inside its partitions, so no task numbers all rows. Equal dates and keys are told apart by the
    digest of the row, so a task that is run again cuts the same pages. Records without a date have pages of their own, which no range opens. mode "append" adds pages to those that are there.
    """
    day = F.coalesce(F.col(date), F.lit(_NO_DATE))
    row = F.struct(*orders.columns)
    ranked = orders.select(row.alias("__row"), day.alias("__day"), F.col(key).alias("__key"), F.xxhash64(F.to_json(row)).alias("__tie"))
    placed = ranked.repartitionByRange("__day", "__key", "__tie").sortWithinPartitions("__day", "__key", "__tie").withColumn("__at", F.monotonically_increasing_id())
    # The upper bits of the id are the partition, the lower 33 the row in it; a page never mixes dated and undated records.
    page = F.concat_ws("-", F.shiftright("__at", 33).cast("string"), F.expr(f"((__at & ((1L << 33) - 1)) div {int(page_size)})").cast("string"), (F.col("__day") == _NO_DATE).cast("int").cast("string"))
    entry = F.struct("__day", "__key", "__tie", "__row")
    pages = placed.groupBy(page.alias("page")).agg(F.min("__day").alias("first_date"), F.max("__day").alias("last_date"), F.count("*").cast("int").alias("count"), F.array_sort(F.collect_list(entry)).alias("__rows"))
    pages.select("count", F.transform("__rows", lambda e: e["__row"]).alias("results"), *LAYOUT).write.mode(mode).partitionBy(*LAYOUT).json(path)


def _schema(president_as_text: bool) -> str:
    order = PRESIDENT_TEXT if president_as_text else PRESIDENT_STRUCT
    return f"count int, results array<struct<{','.join(f'{n}:{k}' for n, k in (x.split(' ', 1) for x in order.split(', ')))}>>, first_date string, last_date string, page string"


def _inside(pages: DataFrame, start: str, end: str) -> DataFrame:
    """The records of pages whose folders say that they may hold some of the range."""
    near = pages.where((F.col("last_date") >= start) & (F.col("first_date") <= end))
    return near.select(F.explode("results").alias("r")).select("r.*")


def read_order_pages(spark: SparkSession, path: str, start: str, end: str, limit: int | None = None, president_as_text: bool = False) -> DataFrame:
    """Order records of such pages signed from start to end; a page outside is dropped by its folder and never opened. A broken page in the range fails the job."""
    check_range(start, end)
    pages = spark.read.schema(_schema(president_as_text)).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return orders_in_range(_inside(pages, start, end), start, end, limit)


def stream_order_pages(spark: SparkSession, path: str, start: str, end: str, pages_a_batch: int = 1000, president_as_text: bool = False) -> DataFrame:
    """The same as a stream: pages that arrive later are taken up, the checkpoint's log of files being the offset."""
    check_range(start, end)
    pages = spark.readStream.schema(_schema(president_as_text)).option("multiLine", True).option("mode", "FAILFAST").option("maxFilesPerTrigger", pages_a_batch).json(path)
    return _inside(pages, start, end).where(F.col("signing_date").between(start, end))
