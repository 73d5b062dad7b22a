"""Ids, vectors, topics, extraction records and other scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS name space of RFC 4122.
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"
#: Topics that fill up short lists of orders.
GENERIC_TOPICS = ("federal policy", "executive action", "government regulation")
EXTRACTION = (
    "document_summary string, agencies_impacted array<string>, constitution_cited array<string>, federal_statutes_cited array<string>, federal_regulations_cited array<string>, "
    "cases_cited array<string>, topics_or_policy_areas array<string>, holding_plain string, outcome_simple string, issue_plain string, reasoning string"
)


def point_id(c: Column) -> Column:
    """Version 5 UUID of the id in the DNS name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_DNS)), F.encode(c, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for zero vectors and for different lengths."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), _dot(a, b) / norm)


def bounded_topics(topics: Column, fill: bool = False) -> Column:
    """At most eight topics; with fill, fewer than five get generic ones that they lack."""
    topics = F.coalesce(topics, F.array().cast("array<string>"))
    cut = F.slice(topics, 1, 8)
    if not fill:
        return cut
    generic = F.array(*map(F.lit, GENERIC_TOPICS))
    return F.when(F.size(topics) < 5, F.slice(F.concat(topics, F.array_except(generic, topics)), 1, 5)).otherwise(cut)


# What a document gets whose fields could not be extracted.
FALLBACK = {
    "document_summary": "Unable to generate summary.", "holding_plain": "Unable to extract holding.", "outcome_simple": "Unable to extract outcome.",
    "issue_plain": "Unable to extract issue.", "reasoning": "Unable to extract reasoning.",
}
FALLBACK_TOPICS = {"opinion": ("supreme court", "legal opinion", "court decision"), "order": ("executive order", "federal policy", "presidential action")}


def parse_extraction(json: Column, kind: str | None = None) -> Column:
    """struct of EXTRACTION plus failed: defaults for missing fields, a fallback record for null or unparsable text.

    kind ("opinion", "order"): the fallback record of an extraction of that kind; without it, a plain one.
    """
    failing = FALLBACK if kind else {"document_summary": FALLBACK["document_summary"]}
    failing_topics = FALLBACK_TOPICS[kind] if kind else GENERIC_TOPICS[:2]
    parsed = F.from_json(json, EXTRACTION, {"mode": "PERMISSIVE"})
    valid = F.coalesce(F.get_json_object(json, "$").startswith("{"), F.lit(False))
    fields = []
    for name, type_ in (x.rsplit(" ", 1) for x in EXTRACTION.split(", ")):
        empty = F.lit("") if type_ == "string" else F.array().cast("array<string>")
        fallback = F.array(*map(F.lit, failing_topics)) if name == "topics_or_policy_areas" else F.lit(failing[name]) if name in failing else empty
        fields.append(F.when(valid, F.coalesce(parsed[name], empty)).otherwise(fallback).alias(name))
    return F.struct(*fields, (~valid).alias("failed"))


def title_case(name: str) -> str:
    return name.replace("_", " ").title()
