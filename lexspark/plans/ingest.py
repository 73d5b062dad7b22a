"""End-to-end plans: raw records to a searchable collection, and questions to rendered pages."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.textclean import strip_html
from ..operators import filters, normalize, render, search, store
from ..operators.chunk import chunk_documents
from ..operators.embed import Embedder, Extractor, embed, extract_fields
from ..streaming.ingest import Documents
from .corpora import corpus


@dataclass(frozen=True)
class Kind:
    """What is particular to a kind of document: how it is read and normalized, where it goes, what its chunks carry."""

    collection: str
    #: Raw rows to document_id, text and metadata.
    prepare: Callable[[DataFrame], DataFrame]
    metadata: tuple[str, ...]
    topics: str | None
    #: A line of a search result.
    line: Callable[[], Column]


def _orders(raw: DataFrame) -> DataFrame:
    """Orders with their raw text, normalized; those without a text are left out here, and logged by the stream."""
    found = normalize.normalize_orders(raw, 2000, also={"text": F.col("raw_text"), "topics": F.col("topics")})
    return found.select("document_id", "title", "president", "agencies", "signing_date", "executive_order_number", "url", "text", "topics")


def _opinions(raw: DataFrame) -> DataFrame:
    """Opinions joined with their cases: stripped of HTML and normalized."""
    found = normalize.normalize_opinions(raw, 2000, also={"text": strip_html(F.col("html"))})
    return found.select("document_id", "case_name", "opinion_type", "publication_date", F.col("author_str").alias("majority_author"), "url", "text")


KINDS = {
    "order": Kind(
        "executive_orders", _orders, ("title", "president", "agencies", "topics", "signing_date", "executive_order_number"), "topics",
        lambda: render.order_result(F.col("rank"), F.col("title"), F.col("executive_order_number"), F.col("president"), F.col("signing_date"), F.col("text"), F.col("score"), F.col("section_label"), None, {"policy_topics": F.col("topics"), "impacted_agencies": F.col("agencies")}),
    ),
    "opinion": Kind(
        "supreme_court_opinions", _opinions, ("case_name", "opinion_type", "publication_date", "majority_author"), None,
        lambda: render.opinion_result(F.col("rank"), F.col("case_name"), F.col("opinion_type"), F.col("majority_author"), F.col("text"), F.col("score"), None, F.col("section_label"), {"constitutional_provisions": F.col("constitution_cited"), "statutes_interpreted": F.col("federal_statutes_cited")}),
    ),
}


def build_collection(docs: DataFrame, kind: str, dim: int = 64, fn: Embedder | None = None, extract: Extractor | None = None) -> DataFrame:
    """Chunks with ids, vectors and document metadata, of prepared documents. Fields are extracted once a document, before chunks are made."""
    of = KINDS[kind]
    own = extract_fields(docs.select("document_id", *of.metadata, "text"), topics=of.topics, kind=kind, fn=extract)
    chunks = store.with_point_ids(chunk_documents(own, kind)).withColumn("collection", F.lit(of.collection))
    return embed(chunks, "text", dim, fn)


def streamed(kind: str, schema: str | StructType) -> Documents:
    """Raw records of a kind as a stream takes them, with the metadata, citations and topics that build_collection gives them."""
    of = KINDS[kind]
    return Documents(schema, "id", of.prepare, of.metadata, of.topics, extract=True)


def dry_run(docs: DataFrame, kind: str, **how) -> DataFrame:
    """Everything but the write: the caller decides what to do with the rows."""
    return build_collection(docs, kind, **how)


def stored(chunks: DataFrame) -> DataFrame:
    """The collection, written once to the shared warehouse folder and read from there by all that follows."""
    path = f"{chunks.sparkSession.conf.get('spark.sql.warehouse.dir')}/collection-{uuid.uuid4().hex}"
    chunks.write.parquet(path)
    return chunks.sparkSession.read.parquet(path)


def hits(questions: DataFrame, collection: DataFrame, k: int = 5, condition: Column | None = None, dim: int = 64, fn: Embedder | None = None) -> DataFrame:
    """The k best chunks of each question (query_id, query), with all their columns: only ids and vectors are scanned, then the hits are joined."""
    vectors = embed(questions, "query", dim, fn).select("query_id", "embedding")
    found = search.vector_search(vectors, collection, k, condition)
    return found.join(collection.drop("embedding"), "point_id")


def answer(questions: DataFrame, collection: DataFrame, kind: str, k: int = 5, condition: Column | None = None, dim: int = 64, fn: Embedder | None = None) -> DataFrame:
    """(query_id, page) for questions (query_id, query) over the chunks of a kind, with a hint where few are good."""
    found = hits(questions, collection, k, condition, dim, fn)
    title = F.col("case_name") if kind == "opinion" else F.col("title")
    lines = found.select("query_id", "rank", "score", "document_id", "chunk_id", "collection", title.alias("title"), KINDS[kind].line().alias("line"))
    return render.result_page(lines, questions.select("query_id", "query"), KINDS[kind].collection, render.document_hints(lines))


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def raw_orders(docs: DataFrame) -> DataFrame:
    """The derived orders as raw records with their texts, joined by url as they come from two sources."""
    none = F.lit(None).cast("string")
    records = docs.select(
        F.col("document_id").alias("id"), F.concat(F.lit("Order "), "document_id").alias("title"), F.col("signing_date").alias("date"), F.lit("federal_register").alias("source"), F.lit("executive_order").alias("type"), "url",
        none.alias("html_url"), none.alias("pdf_url"), F.col("order_number").alias("executive_order_number"), F.concat(F.lit("P"), "document_id").alias("presidential_document_number"), "president", "agencies", "signing_date", "topics", F.col("url").alias("raw_text_url"),
    )
    return normalize.join_raw_text(records, docs.select(F.col("url").alias("raw_text_url"), F.col("order_text").alias("raw_text"))).where("error_message IS NULL")


def raw_opinions(docs: DataFrame) -> DataFrame:
    """The derived opinions as raw records with HTML, joined with the cases that list them."""
    none = F.lit(None).cast("string")
    records = docs.select(
        F.col("document_id").alias("opinion_id"), F.col("document_id").alias("id"), F.lit("Untitled").alias("title"), F.col("signing_date").alias("date"), F.lit("courtlistener").alias("source"), F.lit("scotus_opinion").alias("type"), "url",
        none.alias("absolute_url"), none.alias("download_url"), "opinion_code", F.col("justice").alias("author_str"), none.alias("joined_by_str"), F.lit(None).cast("boolean").alias("per_curiam"), none.alias("docket_number"),
        F.concat(F.lit("<p>"), F.replace(F.replace(F.replace("court_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p>")).alias("html"),
    )
    cases = docs.groupBy(F.col("case_id").alias("id")).agg(F.max("case_name").alias("case_name"), F.max("signing_date").alias("date_filed"), F.max("justice").alias("judges"), F.collect_list("url").alias("sub_opinions"))
    return normalize.join_cases(records, cases)


def ingest_and_search(spark: SparkSession, sf_dir: str, kind: str = "order") -> DataFrame:
    """Raw records to a stored collection; benchmark texts as questions to filtered, ranked, rendered results."""
    raw = {"order": raw_orders, "opinion": raw_opinions}[kind](corpus(spark, sf_dir))
    collection = stored(build_collection(KINDS[kind].prepare(raw), kind))
    condition = filters.any_of("agencies", ["State", "Energy"]) if kind == "order" else filters.opinion_filter(start=1640995200)
    return answer(questions_of(spark, sf_dir), collection, kind, condition=condition)
