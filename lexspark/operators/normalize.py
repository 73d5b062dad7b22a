"""Raw records to flat document rows, payload validity, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.textclean import strip_html

# Opinion type codes.
OPINION_TYPES = {"010combined": "majority", "020lead": "majority", "030concurrence": "concurrence", "040dissent": "dissent", "050concurrence_dissent": "concurrence_dissent"}


def last_path_part(url: Column) -> Column:
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)


def explode_opinions(clusters: DataFrame) -> DataFrame:
    """One row for each sub-opinion url of a cluster; clusters without any give none."""
    return clusters.select(*[c for c in clusters.columns if c != "sub_opinions"], F.explode("sub_opinions").alias("opinion_url")).withColumn("opinion_id", last_path_part(F.col("opinion_url")))


def opinion_metadata(opinions: DataFrame) -> DataFrame:
    """Flat opinion rows with clean text and plain dates."""
    return opinions.select(
        "id", strip_html(F.col("html_with_citations")).alias("content"), "type", F.coalesce("author_str", F.lit("")).alias("author_str"),
        F.coalesce("per_curiam", F.lit(False)).alias("per_curiam"), F.coalesce("joined_by_str", F.lit("")).alias("joined_by_str"),
        dates.date_of_timestamp(F.col("date_created")).alias("date"), "download_url", "page_count",
    )


def agency_names(agencies: Column) -> Column:
    """Names of an array of structs with a name and more; null gives an empty array."""
    return F.coalesce(F.transform(agencies, lambda a: F.coalesce(a["name"], F.lit(""))), F.array().cast("array<string>"))


def president_name(record: Column | None, text: Column | None) -> Column:
    """From a struct or a plain string; `Unknown` without either."""
    found = [c for c in (record["name"] if record is not None else None, text) if c is not None]
    return F.coalesce(*found, F.lit("Unknown"))


def type_name(code: Column) -> Column:
    """Readable opinion type; an unknown code stays."""
    names = F.create_map(*[F.lit(x) for pair in OPINION_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(names, code), code)


def _named(c: Column, raw: str, name: str) -> Column:
    return F.when(F.lower(c) == raw, name).otherwise(c)


def normalize_opinions(docs: DataFrame, default_year: int, zone: str = "UTC", also: dict[str, Column] | None = None) -> DataFrame:
    """Court rows: case name over title, type codes as names, url fallbacks, epoch dates; also: more columns, of the raw ones."""
    case = F.coalesce("case_name", "title")
    return docs.select(
        F.col("id").alias("document_id"), case.alias("title"), dates.epoch_of(F.col("date"), zone).alias("publication_date"), dates.year_of(F.col("date"), default_year).alias("year"),
        _named(F.col("source"), "courtlistener", "CourtListener").alias("source"), _named(F.col("type"), "scotus_opinion", "Supreme Court Opinion").alias("type"),
        F.coalesce(F.nullif("url", F.lit("")), "absolute_url", "download_url", F.lit("")).alias("url"), case.alias("case_name"), type_name(F.nullif("opinion_code", F.lit(""))).alias("opinion_type"),
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("judges", "author_str", "joined_by_str")), F.coalesce("per_curiam", F.lit(False)).alias("per_curiam"), "docket_number",
        *(c.alias(name) for name, c in (also or {}).items()),
    )


def normalize_orders(docs: DataFrame, default_year: int, zone: str = "UTC", also: dict[str, Column] | None = None) -> DataFrame:
    """Order rows: order number by fallback, president's name, both dates as epoch seconds; also: more columns, of the raw ones."""
    number = F.coalesce(F.nullif("executive_order_number", F.lit("")), F.nullif("presidential_document_number", F.lit("")), F.lit(""))
    return docs.select(
        F.col("id").alias("document_id"), "title", dates.epoch_of(F.col("date"), zone).alias("publication_date"), dates.year_of(F.col("date"), default_year).alias("year"),
        _named(F.col("source"), "federal_register", "Federal Register").alias("source"), _named(F.col("type"), "executive_order", "Executive Order").alias("type"),
        F.coalesce(F.nullif("url", F.lit("")), "html_url", "pdf_url", F.lit("")).alias("url"), number.alias("executive_order_number"), F.coalesce("president", F.lit("")).alias("president"),
        F.coalesce("agencies", F.array().cast("array<string>")).alias("agencies"), dates.epoch_of(F.coalesce("signing_date", "date"), zone).alias("signing_date"),
        *(c.alias(name) for name, c in (also or {}).items()),
    )


def route(kind: Column, source: Column) -> Column:
    """`opinion`, `order` or null; the court wins where both match."""
    kind, source = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(source, F.lit("")))
    court = (kind == "supreme court opinion") | kind.contains("scotus") | source.contains("court")
    order = kind.contains("executive") | source.contains("federal")
    return F.when(court, "opinion").when(order, "order")


def summary_view(docs: DataFrame) -> DataFrame:
    """Metadata alone: no content, titles of 100 characters."""
    return docs.withColumn("content", F.lit("")).withColumn("title", F.substring("title", 1, 100))


def valid_payload(id_: Column, text: Column, embedding: Column | None = None, dim: int | None = None) -> Column:
    """Non-empty id and text; the vector, if the collection needs one, of its dimension."""
    ok = (F.length(F.coalesce(id_, F.lit(""))) > 0) & (F.length(F.coalesce(text, F.lit(""))) > 0)
    if dim is not None and embedding is not None:
        ok = ok & F.coalesce(F.size(embedding) == dim, F.lit(False))
    return ok


def flatten_payload(payloads: DataFrame) -> DataFrame:
    """struct column metadata to columns beside the rest; original_id is kept."""
    rest = [c for c in payloads.columns if c not in ("metadata", "id")]
    return payloads.select(F.col("id").alias("original_id"), *rest, "metadata.*")


def join_cases(opinions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Opinions with their case; a missing one is `Unknown Case` without a date."""
    cases = explode_opinions(clusters).select("opinion_id", "case_name", "date_filed", "judges")
    joined = opinions.join(cases, "opinion_id", "left")
    return joined.withColumn("case_name", F.coalesce("case_name", F.lit("Unknown Case"))).withColumn("date_filed", F.coalesce("date_filed", F.lit("")))


def join_raw_text(orders: DataFrame, texts: DataFrame) -> DataFrame:
    """Orders with their text by url and, where it is missing, the reason."""
    joined = orders.join(texts.dropDuplicates(["raw_text_url"]), "raw_text_url", "left")
    reason = F.when(F.coalesce("raw_text_url", F.lit("")) == "", "no text url").when(F.coalesce("raw_text", F.lit("")) == "", "no text")
    return joined.withColumn("error_message", reason)


def with_content_check(docs: DataFrame, text: str) -> DataFrame:
    """docs with error_message: `no content` where the text is null or empty."""
    return docs.withColumn("error_message", F.when(F.coalesce(F.col(text), F.lit("")) == "", "no content"))
