"""Legal citations: extraction to arrays of structs, and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Citation patterns and the names of the amendments.
_SECTION = r"(\d+(?:\.\d+)?(?:\([a-z0-9]+\))*)"
CFR = r"(?i)(\d{1,2})\s*C\.?\s*F\.?\s*R\.?\s*(?:Part\s*|§\s*)?" + _SECTION
USC = r"(?i)(\d{1,2})\s*U\.?\s*S\.?\s*C\.?\s*(?:§§?\s*)?" + _SECTION
ARTICLE = r"(?:U\.?S\.?\s*Const\.?\s*)?[Aa]rt(?:icle)?\.?\s+([IVX]+)(?:,?\s*§\s*(\d+))?(?:,?\s*cl\.?\s*(\d+))?"
AMENDMENT = r"(?:U\.?S\.?\s*Const\.?\s*)?[Aa]mend(?:ment)?\s+([IVX]+)(?:,?\s*§\s*(\d+))?"
STRICT_AMENDMENT = AMENDMENT.replace(r"(?:ment)?", r"(?:ment)?\.?")
AMENDMENTS = {
    "first": "I", "second": "II", "third": "III", "fourth": "IV", "fifth": "V", "sixth": "VI", "seventh": "VII", "eighth": "VIII", "ninth": "IX",
    "tenth": "X", "eleventh": "XI", "twelfth": "XII", "thirteenth": "XIII", "fourteenth": "XIV", "fifteenth": "XV", "sixteenth": "XVI",
    "seventeenth": "XVII", "eighteenth": "XVIII", "nineteenth": "XIX", "twentieth": "XX", "twenty-first": "XXI", "twenty-second": "XXII",
    "twenty-third": "XXIII", "twenty-fourth": "XXIV", "twenty-fifth": "XXV", "twenty-sixth": "XXVI", "twenty-seventh": "XXVII",
}
_BY_LETTER = "|".join(f"{first}(?:{'|'.join(w[1:] for w in AMENDMENTS if w[0] == first)})" for first in sorted({w[0] for w in AMENDMENTS}))
#: Most words are passed over by their first letter; those left try the ordinals that begin so.
ORDINAL = rf"(?i)\b(?=[{''.join(sorted({w[0] for w in AMENDMENTS}))}])({_BY_LETTER})\s+amendment\b"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _part(match: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(match, pattern, group), F.lit(""))


def _code(text: Column, pattern: str, strict: bool) -> Column:
    pattern = pattern.replace(r"(\d{1,2})", r"\b(\d{1,2})", 1) if strict else pattern
    return F.transform(
        _all(text, pattern),
        lambda m: F.struct(_part(m, pattern, 1).alias("title"), _part(m, pattern, 2).alias("section"), F.trim(m).alias("full_citation")),
    )


def cfr_citations(text: Column, strict: bool = False) -> Column:
    """array<struct<title, section, full_citation>> in text order; strict: the title starts a word."""
    return _code(text, CFR, strict)


def usc_citations(text: Column, strict: bool = False) -> Column:
    return _code(text, USC, strict)


def constitution_citations(text: Column, strict: bool = False) -> Column:
    """array<struct<type, number, section, clause, full_citation>>: articles, amendments, amendments by word.

    strict: article and amendment start a word, and `amend.` may have its dot.
    """
    none = F.lit(None).cast("string")
    article = (r"\b" + ARTICLE) if strict else ARTICLE
    amendment = (r"\b" + STRICT_AMENDMENT) if strict else AMENDMENT
    make = lambda kind, number, section, clause, m: F.struct(
        F.lit(kind).alias("type"), number.alias("number"), section.alias("section"), clause.alias("clause"), F.trim(m).alias("full_citation")
    )
    numbers = F.create_map(*[F.lit(x) for pair in AMENDMENTS.items() for x in pair])
    return F.concat(
        F.transform(_all(text, article), lambda m: make("article", _part(m, article, 1), _part(m, article, 2), _part(m, article, 3), m)),
        F.transform(_all(text, amendment), lambda m: make("amendment", _part(m, amendment, 1), _part(m, amendment, 2), none, m)),
        F.transform(_all(text, ORDINAL), lambda m: make("amendment", F.element_at(numbers, F.lower(_part(m, ORDINAL, 1))), none, none, m)),
    )


def format_code(title: Column, code: str, section: Column, year: Column | None = None) -> Column:
    """`14 C.F.R. § 91.817 (2024)`; a null or empty year is left out."""
    plain = F.concat(title, F.lit(f" {code} § "), section)
    if year is None:
        return plain
    return F.concat(plain, F.coalesce(F.concat(F.lit(" ("), F.nullif(year, F.lit("")), F.lit(")")), F.lit("")))


def format_cfr(title: Column, section: Column, year: Column | None = None) -> Column:
    return format_code(title, "C.F.R.", section, year)


def format_usc(title: Column, section: Column, year: Column | None = None) -> Column:
    return format_code(title, "U.S.C.", section, year)


def format_constitution(article: Column, amendment: Column, section: Column, clause: Column) -> Column:
    """`U.S. Const. art. I, § 9, cl. 7`; null unless just one of article and amendment is given."""
    given = lambda c: F.nullif(c, F.lit(""))
    article, amendment = given(article), given(amendment)
    head = F.when(article.isNotNull() & amendment.isNull(), F.concat(F.lit("U.S. Const. art. "), article)).when(
        article.isNull() & amendment.isNotNull(), F.concat(F.lit("U.S. Const. amend. "), amendment)
    )
    tail = F.concat(F.coalesce(F.concat(F.lit(", § "), given(section)), F.lit("")), F.coalesce(F.concat(F.lit(", cl. "), given(clause)), F.lit("")))
    return F.concat(head, tail)


def citation_lists(text: Column, strict: bool = False) -> dict[str, Column]:
    """The three citation columns of a document: formatted, distinct, in order of appearance."""
    none = F.lit(None).cast("string")
    code = lambda found, how: F.array_distinct(F.transform(found, lambda c: how(c["title"], c["section"])))
    constitution = F.transform(
        constitution_citations(text, strict),
        lambda c: format_constitution(F.when(c["type"] == "article", c["number"]), F.when(c["type"] == "amendment", c["number"]), c["section"], F.coalesce(c["clause"], none)),
    )
    return {
        "constitution_cited": F.array_distinct(constitution),
        "federal_statutes_cited": code(usc_citations(text, strict), format_usc),
        "federal_regulations_cited": code(cfr_citations(text, strict), format_cfr),
    }
