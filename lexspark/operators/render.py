"""Search results and documents as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import display_date
from ..functions.scalars import title_case
from .search import first_of_document, hint_gate

EXCERPT = 1000
# Fields shown for each collection.
FIELDS = {
    "supreme_court_opinions": ("opinion_type", "justice", "section", "publication_date", "legal_topics", "constitutional_provisions", "statutes_interpreted", "vote_breakdown"),
    "executive_orders": ("president", "signing_date", "chunk_type", "section_title", "policy_topics", "impacted_agencies", "legal_authorities", "economic_sectors"),
}
DATES = ("publication_date", "signing_date", "argued_date", "decided_date", "effective_date")


def _has(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _lines(*lines: Column) -> Column:
    """Lines that are not null, one under another."""
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def excerpt(text: Column, n: int = EXCERPT) -> Column:
    text = F.when(_has(text), text).otherwise("No text available")
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def _score(score: Column) -> Column:
    return F.concat(F.lit("\n*Relevance Score: "), F.format_string("%.3f", score), F.lit("*"))


def detect_type(tag: Column, case_name: Column, opinion_type: Column, order_number: Column, president: Column) -> Column:
    """The tag, or what the filled columns tell."""
    return F.coalesce(tag, F.when(case_name.isNotNull() | opinion_type.isNotNull(), "scotus").when(order_number.isNotNull() | president.isNotNull(), "executive_order"))


def _listed(label: str, values: Column | None, most: int | None = None) -> Column:
    """`- **Label:** a, b`; null for an empty or missing list."""
    if values is None:
        return F.lit(None).cast("string")
    shown = F.slice(values, 1, most) if most else values
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"- **{label}:** "), F.array_join(shown, ", ")))


def _said(label: str, value: Column | None, cut: int | None = None) -> Column:
    """`- **Label:** text`, cut with dots after so many characters; null for an empty or missing text."""
    if value is None:
        return F.lit(None).cast("string")
    shown = F.concat(F.substring(value, 1, cut), F.lit("...")) if cut else value
    return F.when(_has(value), F.concat(F.lit(f"- **{label}:** "), shown))


def _titled(words: Column) -> Column:
    """Every run of letters with a capital first and small letters after it; what is no letter ends a run."""
    runs = F.regexp_extract_all(words, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.char_length(r))))), "")


def _numbered(rank: Column, name: Column) -> Column:
    return F.concat(F.lit("### "), rank.cast("string"), F.lit(". "), name)


def opinion_result(
    rank: Column, case_name: Column, opinion_type: Column, justice: Column, text: Column, score: Column, citation: Column | None = None, section: Column | None = None, detail: dict[str, Column] | None = None
) -> Column:
    """One result. detail: legal_topics, constitutional_provisions, statutes_interpreted (lists), vote_breakdown, holding (texts)."""
    none = F.lit(None).cast("string")
    citation, section = (none if c is None else c for c in (citation, section))
    kind = F.concat(F.lit("**"), _titled(opinion_type), F.lit(" Opinion**"), F.when(_has(justice), F.concat(F.lit(" by Justice "), justice)).otherwise(""), F.when(_has(section), F.concat(F.lit(" (Section "), section, F.lit(")"))).otherwise(""))
    lines = [_numbered(rank, F.coalesce(case_name, F.lit("Unknown Case"))), F.when(_has(citation), F.concat(F.lit("*"), citation, F.lit("*"))), F.when(_has(opinion_type), kind), F.lit("\n**Excerpt:**"), excerpt(text)]
    if detail is not None:
        of = detail.get
        lines += [F.lit("\n**Legal Context:**"), _listed("Legal Topics", of("legal_topics")), _listed("Constitutional Provisions", of("constitutional_provisions")), _listed("Statutes", of("statutes_interpreted"))]
        lines += [_said("Vote", of("vote_breakdown")), _said("Key Holding", of("holding"), 200)]
    return _lines(*lines, _score(score))


def order_result(
    rank: Column, title: Column, number: Column, president: Column, signed: Column, text: Column, score: Column, section_title: Column | None = None, chunk_type: Column | None = None, detail: dict[str, Column] | None = None
) -> Column:
    """One result; signed: epoch seconds. detail: summary (text), policy_topics, impacted_agencies, legal_authorities, economic_sectors (lists)."""
    none = F.lit(None).cast("string")
    section_title, chunk_type = (none if c is None else c for c in (section_title, chunk_type))
    date = display_date(signed)
    info = F.concat_ws(" | ", F.when(_has(president), F.concat(F.lit("President "), president)), F.when(_has(date), F.concat(F.lit("Signed "), date)))
    part = F.when(_has(section_title), F.concat(F.lit("\n**"), section_title, F.lit("**"))).when(_has(chunk_type), F.concat(F.lit("\n**Document Part: "), _titled(chunk_type), F.lit("**")))
    lines = [
        _numbered(rank, F.coalesce(title, F.lit("Unknown Executive Order"))), F.when(_has(number), F.concat(F.lit("**EO Number:** "), number)),
        F.when(_has(info), F.concat(F.lit("**"), info, F.lit("**"))), part, F.lit("\n**Excerpt:**"), excerpt(text),
    ]
    if detail is not None:
        of = detail.get
        lines += [F.lit("\n**Policy Context:**"), _said("Summary", of("summary"), 200), _listed("Policy Topics", of("policy_topics")), _listed("Agencies", of("impacted_agencies"))]
        lines += [_listed("Legal Authorities", of("legal_authorities"), 3), _listed("Economic Sectors", of("economic_sectors"))]
    return _lines(*lines, _score(score))


def generic_result(rank: Column, text: Column, score: Column, **named: Column) -> Column:
    """A result of unknown kind; named: title, name, document_id or id, of which the first that is filled is shown."""
    shown = [F.when(named[k].isNotNull(), F.concat(F.lit(f"**{k.title()}:** "), named[k].cast("string"))) for k in ("title", "name", "document_id", "id") if k in named]
    who = F.coalesce(*shown) if shown else F.lit(None).cast("string")
    return _lines(_numbered(rank, F.lit("Document Chunk")), who, F.concat(F.lit("\n**Content:**\n"), excerpt(text)), _score(score))


# Headings of result pages, what is counted, and the sentence where there is nothing.
_PAGES = {
    "all": ("", "relevant document chunks", "No results found for query: '"),
    "supreme_court_opinions": ("## Supreme Court Opinion Search Results", "relevant opinion chunks", "No Supreme Court opinions found for query: '"),
    "executive_orders": ("## Executive Order Search Results", "relevant order chunks", "No Executive Orders found for query: '"),
}


def result_page(results: DataFrame, queries: DataFrame, kind: str = "all", hints: DataFrame | None = None) -> DataFrame:
    """(query_id, page): all rendered results (column line) of a query in order, and its hint; a sentence where there are none.

    kind: "all" or a collection; hints: query_id, hint.
    """
    title, counted, nothing = _PAGES[kind]
    pages = results.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: F.concat(r["line"], F.lit("\n"))), "\n")
    found = F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(f" {counted}.\n\n"))
    head = F.concat(F.lit('## Search Results for: "'), F.col("query"), F.lit('"\n\n'), found) if kind == "all" else F.concat(F.lit(f'{title}\n\nQuery: "'), F.col("query"), F.lit('"\n'), found)
    none = F.concat(F.lit(nothing), F.col("query"), F.lit("'"))
    joined = queries.join(pages, "query_id", "left")
    tail = F.lit("")
    if hints is not None:
        joined = joined.join(hints, "query_id", "left")
        tail = F.coalesce(F.concat(F.lit("\n"), F.col("hint")), F.lit(""))
    return joined.select("query_id", F.when(F.col("n") > 0, F.concat(head, body, tail)).otherwise(none).alias("page"))


# What stands before and after the calls of a hint.
_HINT_HEAD = "\n---\n\n## 📄 Full Document Access\n\n"
_HINT_END = "\n\nLoading the full document enables comprehensive follow-up questions without additional searches."


def document_hints(results: DataFrame) -> DataFrame:
    """(query_id, hint): how to load whole documents, for queries with few and good results.

    results: query_id, rank, score, document_id, chunk_id, collection, title.
    """
    gated = hint_gate(results).where(_has(F.col("document_id")))
    one = first_of_document(gated)
    call = F.concat(
        F.lit("**"), "title", F.lit(':**\n```\nget_document_by_id(\n    document_id="'), F.coalesce("chunk_id", F.concat("document_id", F.lit("_chunk_0"))),
        F.lit('",\n    collection="'), "collection", F.lit('",\n    full_document=true\n)\n```'),
    )
    hints = one.withColumn("call", call).groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "call", "collection"))).alias("rows"))
    which = F.when(F.col("n") == 1, "this case").otherwise(F.concat(F.lit("these "), F.col("n").cast("string"), F.lit(" documents")))
    what = F.when(F.element_at("rows", 1)["collection"] == "supreme_court_opinions", "opinion").otherwise("document")
    intro = F.concat(F.lit("For detailed analysis of "), which, F.lit(", you can load the complete "), what, F.lit(" text:"))
    calls = F.array_join(F.transform("rows", lambda r: r["call"]), "\n")
    return hints.select("query_id", F.concat(F.lit(_HINT_HEAD), intro, F.lit("\n\n"), calls, F.lit(_HINT_END)).alias("hint"))


def relevant_metadata(collection: str, columns: dict[str, str]) -> Column:
    """map of readable names to text of the collection's filled fields. columns: name to Spark type of what there is."""
    pairs = []
    for name in FIELDS[collection]:
        if name in columns:
            c = F.col(name)
            value = display_date(c) if name in DATES else F.array_join(c, ", ") if columns[name].startswith("array") else c.cast("string")
            pairs.append(F.struct(F.lit(title_case(name)), F.coalesce(value, F.lit(""))))
    return F.map_filter(F.map_from_entries(F.array(*pairs)), lambda _, v: v != "")


def document_markdown(fields: dict[str, Column], metadata: dict[str, Column]) -> Column:
    """A document as markdown: title, identity, content, metadata lines."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    head = [F.concat(F.lit("# "), text(fields["title"]), F.lit("\n"))]
    for label, name in (("Document ID", "id"), ("Type", "type"), ("Source", "source"), ("Date", "date"), ("URL", "url")):
        head.append(F.concat(F.lit(f"**{label}:** "), text(fields[name])))
    body = [F.lit("\n---\n\n## Document Content\n"), text(fields["content"]), F.lit("\n---\n\n## Metadata\n")]
    return F.concat_ws("\n", *head, *body, *(F.concat(F.lit(f"- **{k}:** "), text(v)) for k, v in metadata.items()))
