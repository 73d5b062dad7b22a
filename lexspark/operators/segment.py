"""Splitting opinions and orders into labelled segments, with built-in functions only.

A separator character is put before each marker, the text is split at it, and the pieces are labelled.
parity=True drops text before the first marker and keeps the loose patterns of the source rules;
by default that text is kept and the patterns are bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.textclean import trim_space

MARK = "\u0001"
# Section markers and labels.
SYLLABUS = r"\bSyllabus\b"
MAJORITY = r"(?:Justice\s+\w+\s+delivered\s+the\s+opinion\s+of\s+the\s+Court\.?|Per\s+Curiam\.?)"
JUSTICE = r"Justice\s+\w+,\s+(?:with\s+whom{gap}joins?,\s+)?"
CONCURRING = JUSTICE + r"concurring(?!\s+in\s+part\s+and\s+dissenting)"
DISSENTING = JUSTICE + r"dissenting(?!\s+in\s+part)"
MIXED = JUSTICE + r"concurring\s+in\s+part\s+and\s+dissenting\s+in\s+part"
LABELS = {"S": "Syllabus", "M": "Majority Opinion", "C": "Concurring Opinion", "D": "Dissenting Opinion", "X": "Concurring in Part, Dissenting in Part"}
PART = r"\s+([IVX]+|[A-Z])\s+(?=[A-Z]|\w)"
SECTION = r"^\s*(Sec(?:tion)?\.?\s*\d+[A-Za-z\-]*\.)"
SECTION_NUMBER = r"(?iU)^\s*Sec(?:tion)?\.?\s*(\d+[A-Za-z\-]*)"
SECTION_TITLE = r"(?U)^Sec(?:tion)?\.?\s*\d+[A-Za-z\-]*\.\s*([^.]+)\."
LETTER = r"^\s*\([a-z]\)\s*"
ROMAN = r"^\s*\((?:i|ii|iii|iv|v|vi|vii|viii|ix|x)+\)\s*"

_SEGMENT = "array<struct<label:string,text:string>>"


def _segment(label: Column, text: Column) -> Column:
    return F.struct(label.alias("label"), text.alias("text"))


def _none() -> Column:
    return F.array().cast(_SEGMENT)


def _filled(segments: Column) -> Column:
    return F.filter(segments, lambda s: F.length(s["text"]) > 0)


def _with(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where value is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _rest(pieces: Column) -> Column:
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))


def _split(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, f"({pattern})", MARK + "$1"), MARK)


def opinion_sections(text: Column, parity: bool = False) -> Column:
    """array<struct<label, text>>: the first syllabus and majority, and all other opinions, by position."""
    gap = ".*?" if parity else r"[^.]*?"
    marked = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(""))
    for code, pattern in (("S", SYLLABUS), ("M", MAJORITY)):
        marked = F.regexp_replace(marked, rf"(?idU)\A((?s:.*?))({pattern})", "$1" + MARK + code + "$2")
    for code, pattern in (("C", CONCURRING), ("D", DISSENTING), ("X", MIXED)):
        marked = F.regexp_replace(marked, rf"(?idU)({pattern.format(gap=gap)})", MARK + code + "$1")
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])

    def of(pieces: Column) -> Column:
        found = F.transform(_rest(pieces), lambda p: _segment(F.element_at(labels, F.substring(p, 1, 1)), trim_space(F.substring(p, 2, 2_000_000_000))))
        lead = F.array(_segment(F.lit("Preamble"), trim_space(pieces[0])))
        return F.when(F.size(pieces) == 1, F.array(_segment(F.lit("Opinion"), trim_space(pieces[0])))).otherwise(found if parity else _filled(F.concat(lead, found)))

    return _with(F.split(marked, MARK), of)


def _parts(section: Column, parity: bool) -> Column:
    """A section's parts by inline Roman or letter markers, if there are two or more."""
    pattern = PART if parity else r"(?<=[.?!:;”\"])" + PART
    marker = lambda p: F.regexp_extract(p, r"(?U)^\s+([IVX]+|[A-Z])\s", 1)

    def of(pieces: Column) -> Column:
        parts = F.transform(_rest(pieces), lambda p: _segment(F.concat(section["label"], F.lit(" - Part "), marker(p)), trim_space(p)))
        lead = F.array(_segment(section["label"], trim_space(pieces[0])))
        return F.when(F.size(pieces) > 2, parts if parity else _filled(F.concat(lead, parts))).otherwise(F.array(section))

    return _with(_split(section["text"], f"(?dU:{pattern})"), of)


def opinion_segments(text: Column, parity: bool = False) -> Column:
    """Sections, split into their parts."""
    return F.flatten(F.transform(opinion_sections(text, parity), lambda s: _parts(s, parity)))


def syllabus_text(text: Column) -> Column:
    """The syllabus without its first line, or, where it has one line, without its heading word; null if none."""
    found = F.filter(opinion_sections(text), lambda s: s["label"] == "Syllabus")

    def of(body: Column) -> Column:
        rest = F.when(body.contains("\n"), F.regexp_replace(body, r"\A[^\n]*\n?", "")).otherwise(F.regexp_replace(body, r"(?i)\ASyllabus", ""))
        return F.nullif(trim_space(rest), F.lit(""))

    return _with(F.try_element_at(found, F.lit(1))["text"], of)


def order_sections(text: Column) -> Column:
    """Preamble and numbered sections; the whole text as `Executive Order` if there are none."""
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(""))
    title = lambda p: F.nullif(trim_space(F.regexp_extract(p, SECTION_TITLE, 1)), F.lit(""))
    number = lambda p: F.concat(F.lit("Sec. "), F.regexp_extract(p, SECTION_NUMBER, 1))

    def of(pieces: Column) -> Column:
        sections = F.transform(_rest(pieces), lambda p: _segment(F.concat_ws(" - ", number(p), title(p)), p))
        lead = _filled(F.array(_segment(F.lit("Preamble"), pieces[0])))
        return F.when(F.size(pieces) == 1, F.array(_segment(F.lit("Executive Order"), pieces[0]))).otherwise(F.concat(lead, sections))

    return _with(F.transform(_split(clean, f"(?imdU:{SECTION})"), trim_space), of)


def _lettered(section: Column, parity: bool) -> Column:
    """A section's lettered subsections, if there are two or more, and their Roman paragraphs."""
    label = lambda p: F.concat(section["label"], F.lit("("), F.regexp_extract(p, r"\(([a-z])\)", 1), F.lit(")"))

    def of(pieces: Column) -> Column:
        subsections = F.transform(_rest(pieces), lambda p: _segment(label(p), p))
        split = F.flatten(F.transform(subsections, lambda s: _paragraphs(s, parity)))
        lead = _filled(F.array(_segment(section["label"], pieces[0])))
        return F.when((F.size(pieces) > 2) & (section["label"] != "Preamble"), split if parity else F.concat(lead, split)).otherwise(F.array(section))

    return _with(F.transform(_split(section["text"], f"(?mdU:{LETTER})"), trim_space), of)


def _paragraphs(subsection: Column, parity: bool) -> Column:
    def of(pieces: Column) -> Column:
        parts = F.transform(_rest(pieces) if parity else pieces, lambda p: _segment(subsection["label"], p))
        return F.when(F.size(pieces) > 2, parts if parity else _filled(parts)).otherwise(F.array(subsection))

    return _with(F.transform(_split(subsection["text"], f"(?mdU:{ROMAN})"), trim_space), of)


def order_segments(text: Column, parity: bool = False) -> Column:
    """Sections, split into lettered subsections and Roman paragraphs."""
    return F.flatten(F.transform(order_sections(text), lambda s: _lettered(s, parity)))
