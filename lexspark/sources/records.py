"""Bulk readers for raw records, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import valid_date
from ..functions.textclean import clean_raw_text

OPINION = (
    "id bigint, absolute_url string, cluster string, cluster_id bigint, author string, author_str string, per_curiam boolean, joined_by array<string>, joined_by_str string, "
    "type string, sha1 string, page_count int, download_url string, local_path string, plain_text string, html_with_citations string, opinions_cited array<string>, date_created string, date_modified string"
)
CLUSTER = (
    "id bigint, docket string, docket_id bigint, court string, sub_opinions array<string>, citations array<struct<volume:int,reporter:string,page:string,type:string>>, judges string, "
    "date_filed string, case_name string, case_name_short string, case_name_full string, scdb_votes_majority int, scdb_votes_minority int, citation_count int, precedential_status string, docket_number string"
)
ORDER = (
    "document_number string, title string, type string, subtype string, executive_order_number string, presidential_document_number string, president {president}, publication_date string, "
    "signing_date string, citation string, start_page int, end_page int, agencies array<struct<id:int,name:string,slug:string,url:string>>, topics array<string>, raw_text_url string, html_url string, pdf_url string"
)
PRESIDENT_STRUCT, PRESIDENT_TEXT = ORDER.format(president="struct<name:string>"), ORDER.format(president="string")
RAW_TEXT = "raw_text_url string, value string"
NEEDED = ("id", "html_with_citations", "type", "author_str", "cluster_id", "cluster", "per_curiam", "joined_by", "joined_by_str", "download_url", "page_count", "date_created")


def read_opinions(spark: SparkSession, path: str, columns: tuple[str, ...] = NEEDED) -> DataFrame:
    """Opinion records of JSON lines; only the named columns are parsed."""
    return spark.read.schema(OPINION).json(path).select(*columns)


def published_clusters(clusters: DataFrame, court: str, start: str, end: str) -> DataFrame:
    """Published cases of a court filed in a range, newest first."""
    found = clusters.where((F.col("court") == court) & (F.col("precedential_status") == "Published") & F.col("date_filed").between(start, end))
    return found.orderBy(F.desc("date_filed"), "id")


def read_clusters(spark: SparkSession, path: str, court: str, start: str, end: str) -> DataFrame:
    check_range(start, end)
    return published_clusters(spark.read.schema(CLUSTER).json(path), court, start, end)


def orders_in_range(orders: DataFrame, start: str, end: str, limit: int | None = None) -> DataFrame:
    found = orders.where(F.col("signing_date").between(start, end)).orderBy("signing_date", "document_number")
    return found.limit(limit) if limit is not None else found


def read_orders(spark: SparkSession, path: str, start: str, end: str, limit: int | None = None, president_as_text: bool = False) -> DataFrame:
    """Order records of paged envelopes ({count, results: [...]}), in a signing-date range."""
    check_range(start, end)
    order = PRESIDENT_TEXT if president_as_text else PRESIDENT_STRUCT
    pages = spark.read.schema("count int, results array<struct<" + ",".join(f"{n}:{k}" for n, k in (x.split(" ", 1) for x in order.split(", "))) + ">>").option("multiLine", True).json(path)
    return orders_in_range(pages.select(F.explode("results").alias("r")).select("r.*"), start, end, limit)


def read_raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """raw_text_url (the file's path) and the cleaned text of each file. Every file is listed and opened by itself; for many texts, pack them."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("raw_text_url"), clean_raw_text(F.col("value")).alias("raw_text"))


def pack_raw_texts(texts: DataFrame, path: str) -> None:
    """texts (raw_text_url, value) into packs of many texts each, so that files grow with the bytes and not with the number of texts."""
    texts.select("raw_text_url", "value").write.parquet(path)


def read_packed_texts(spark: SparkSession, path: str) -> DataFrame:
    """raw_text_url and the cleaned text of each text of such packs, as read_raw_texts gives them for files."""
    packs = spark.read.schema(RAW_TEXT).parquet(path)
    return packs.select("raw_text_url", clean_raw_text(F.col("value")).alias("raw_text"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def check_range(start: str, end: str) -> None:
    """Both must be dates, in order."""
    from datetime import date

    if date.fromisoformat(start) > date.fromisoformat(end):
        raise ValueError(f"{start} is after {end}")


def valid_dates(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("valid", valid_date(F.col(column)))
