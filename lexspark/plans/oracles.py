"""SQL for segments, chunks, citations and pages: the rules of the library written once more, for DuckDB."""

from __future__ import annotations

from .corpora import CORPUS_SQL

#: Unicode white space, as in the library.
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORDLIKE = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{BLANK}+', ''), '{BLANK}+$', '')"


def normalized(x: str) -> str:
    return rf"regexp_replace({trim(x)}, '\n{BLANK}*\n+', chr(10) || chr(10), 'g')"


def _pieces(x: str) -> str:
    """The pieces of a text between marks, with their number from 1."""
    return f"unnest(string_split({x}, chr(1))) AS piece, generate_subscripts(string_split({x}, chr(1)), 1) AS pos"


def order_sections(source: str = "SELECT doc_id, order_text AS t FROM c") -> str:
    """Tables ending in `sec`: doc_id, pos, label, text of the sections of orders."""
    marked = rf"regexp_replace(t, '(?im)(^{BLANK}*Sec(?:tion)?\.?{BLANK}*\d+[A-Za-z\-]*\.)', chr(1) || '\1', 'g')"
    number = rf"regexp_extract(p, '^Sec(?:tion)?\.?{BLANK}*(\d+[A-Za-z\-]*)', 1, 'i')"
    title = trim(rf"regexp_extract(p, '^Sec(?:tion)?\.?{BLANK}*\d+[A-Za-z\-]*\.{BLANK}*([^.]+)\.', 1)")
    return f"""order_pieces AS (SELECT doc_id, {_pieces("m")}, len(string_split(m, chr(1))) AS n FROM (SELECT doc_id, {marked} AS m FROM ({source}))),
sec AS (SELECT doc_id, pos, CASE WHEN n = 1 THEN 'Executive Order' WHEN pos = 1 THEN 'Preamble' ELSE 'Sec. ' || {number} || coalesce(' - ' || nullif({title}, ''), '') END AS label, p AS text
  FROM (SELECT doc_id, pos, n, {trim("piece")} AS p FROM order_pieces) WHERE n = 1 OR pos > 1 OR p <> '')"""


def order_segments() -> str:
    """Tables ending in `seg`: doc_id, no (from 1), label, text."""
    lettered = rf"regexp_replace(text, '(?im)(^{BLANK}*\([a-z]\){BLANK}*)', chr(1) || '\1', 'g')"
    roman = rf"regexp_replace(text, '(?im)(^{BLANK}*\((?:i|ii|iii|iv|v|vi|vii|viii|ix|x)+\){BLANK}*)', chr(1) || '\1', 'g')"
    return f"""{order_sections()},
let AS (SELECT doc_id, pos, label, text, {lettered} AS m FROM sec),
sub AS (SELECT doc_id, pos, 1 AS a2, label, text, false AS split FROM let WHERE len(string_split(m, chr(1))) <= 2 OR label = 'Preamble'
  UNION ALL SELECT doc_id, pos, a2, CASE WHEN a2 = 1 THEN label ELSE label || '(' || regexp_extract(p, '\\(([a-z])\\)', 1) || ')' END, p, a2 > 1
  FROM (SELECT doc_id, pos, label, a2, {trim("piece")} AS p FROM (SELECT doc_id, pos, label, {_pieces("m").replace("AS pos", "AS a2")} FROM let WHERE len(string_split(m, chr(1))) > 2 AND label <> 'Preamble')) WHERE a2 > 1 OR p <> ''),
par AS (SELECT *, {roman} AS m FROM sub),
every AS (SELECT doc_id, pos, a2, 1 AS a3, label, text FROM par WHERE NOT split OR len(string_split(m, chr(1))) <= 2
  UNION ALL SELECT doc_id, pos, a2, a3, label, p FROM (SELECT doc_id, pos, a2, a3, label, {trim("piece")} AS p FROM (SELECT doc_id, pos, a2, label, {_pieces("m").replace("AS pos", "AS a3")} FROM par WHERE split AND len(string_split(m, chr(1))) > 2)) WHERE p <> ''),
seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, a2, a3) AS no, label, text FROM every)"""


def opinion_sections(source: str = "SELECT doc_id, court_text AS t FROM c") -> str:
    """Tables ending in `sec`: doc_id, pos, label, text of the opinions of a court text."""
    b = BLANK
    name = rf"Justice{b}+{WORDLIKE}+,{b}+(?:with{b}+whom[^.]*?joins?,{b}+)?"
    majority = rf"(?:Justice{b}+{WORDLIKE}+{b}+delivered{b}+the{b}+opinion{b}+of{b}+the{b}+Court\.?|Per{b}+Curiam\.?)"
    # Without look-ahead: concurring and dissenting are marked everywhere, then the longer phrase takes the mark over.
    steps = "t"
    steps = rf"regexp_replace({steps}, '(?i)\bSyllabus\b', chr(1) || 'S' || '\0')"
    steps = rf"regexp_replace({steps}, '(?i){majority}', chr(1) || 'M' || '\0')"
    steps = rf"regexp_replace({steps}, '(?i){name}concurring', chr(1) || 'C' || '\0', 'g')"
    steps = rf"regexp_replace({steps}, '(?i)' || chr(1) || 'C({name}concurring{b}+in{b}+part{b}+and{b}+dissenting)', '\1', 'g')"
    steps = rf"regexp_replace({steps}, '(?i){name}dissenting', chr(1) || 'D' || '\0', 'g')"
    steps = rf"regexp_replace({steps}, '(?i)' || chr(1) || 'D({name}dissenting{b}+in{b}+part)', '\1', 'g')"
    steps = rf"regexp_replace({steps}, '(?i){name}concurring{b}+in{b}+part{b}+and{b}+dissenting{b}+in{b}+part', chr(1) || 'X' || '\0', 'g')"
    label = "CASE substr(piece, 1, 1) WHEN 'S' THEN 'Syllabus' WHEN 'M' THEN 'Majority Opinion' WHEN 'C' THEN 'Concurring Opinion' WHEN 'D' THEN 'Dissenting Opinion' ELSE 'Concurring in Part, Dissenting in Part' END"
    return f"""court_pieces AS (SELECT doc_id, {_pieces("m")}, len(string_split(m, chr(1))) AS n FROM (SELECT doc_id, {steps} AS m FROM ({source}))),
sec AS (SELECT * FROM (SELECT doc_id, pos, CASE WHEN n = 1 THEN 'Opinion' WHEN pos = 1 THEN 'Preamble' ELSE {label} END AS label, CASE WHEN pos = 1 THEN {trim("piece")} ELSE {trim("substr(piece, 2)")} END AS text, n FROM court_pieces) WHERE n = 1 OR text <> '')"""


def opinion_segments(source: str = "SELECT doc_id, court_text AS t FROM c") -> str:
    b = BLANK
    marked = rf"regexp_replace(text, '([.?!:;”\"])({b}+(?:[IVX]+|[A-Z]){b}+)({WORDLIKE})', '\1' || chr(1) || '\2\3', 'g')"
    return f"""{opinion_sections(source)},
part AS (SELECT doc_id, pos, label, text, {marked} AS m FROM sec),
every AS (SELECT doc_id, pos, 1 AS a2, label, text FROM part WHERE len(string_split(m, chr(1))) <= 2
  UNION ALL SELECT doc_id, pos, a2, CASE WHEN a2 = 1 THEN label ELSE label || ' - Part ' || regexp_extract(piece, '^{b}+([IVX]+|[A-Z]){b}', 1) END, {trim("piece")}
  FROM (SELECT doc_id, pos, label, {_pieces("m").replace("AS pos", "AS a2")} FROM part WHERE len(string_split(m, chr(1))) > 2)),
seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, a2) AS no, label, text FROM every WHERE a2 > 1 OR text <> '' OR label = 'Opinion')"""


def chunks(least: int, target: int, most: int, overlap: int, gap_free: bool, long_token: int = 40) -> str:
    """Tables ending in `chunk`: doc_id, chunk_index, label, text, tokens, first, last; reads `seg`. A step of the recursion is a window."""
    width, step = target * 4, max(1, target - overlap) * 4
    tokens = lambda x: f"(length({x}) // 4)"
    rfind = lambda mark: f"CASE WHEN instr(reverse(w), '{mark[::-1]}') > 0 THEN length(w) - instr(reverse(w), '{mark[::-1]}') - 1 ELSE -1 END"
    ahead = f"greatest(start + {1 if gap_free else step}, stop - {overlap * 4})" if overlap else "stop"
    return f"""whole AS (SELECT doc_id, no, label, {normalized("text")} AS t FROM seg),
walk AS (
  SELECT doc_id, no, label, t, 0 AS i, 0 AS start, 0 AS stop, '' AS rest, CASE WHEN {tokens("t")} <= {max(least, target)} THEN 'whole' ELSE 'begin' END AS how FROM whole
  UNION ALL
  SELECT doc_id, no, label, t, i + 1, start, stop, rest,
    CASE WHEN rest <> '' AND {tokens("rest")} BETWEEN 1 AND {least - 1} AND i > 0 THEN CASE WHEN {tokens(trim("substr(t, start + 1)"))} <= {most} * 1.2 THEN 'merged' ELSE 'apart' END WHEN stop >= length(t) THEN 'last' ELSE 'more' END
  FROM (SELECT *, CASE WHEN length(t) - stop <= {least * long_token} THEN {trim("substr(t, stop + 1)")} ELSE '' END AS rest
    FROM (SELECT doc_id, no, label, t, i, start, CASE WHEN full_stop < length(t) AND cut > (full_stop - start) * 0.8 THEN start + cut + 2 ELSE full_stop END AS stop
      FROM (SELECT *, CASE WHEN full_stop < length(t) THEN greatest({rfind(". ")}, {rfind("? ")}, {rfind("! ")}) ELSE -1 END AS cut
        FROM (SELECT *, substr(t, start + 1, full_stop - start) AS w FROM (SELECT doc_id, no, label, t, i, start, least(start + {width}, length(t)) AS full_stop
          FROM (SELECT doc_id, no, label, t, i, CASE WHEN how = 'begin' THEN 0 WHEN stop < length(t) THEN {ahead} ELSE stop END AS start FROM walk WHERE how IN ('begin', 'more')) WHERE start < length(t))))))
),
windows AS (
  SELECT doc_id, no, i, 0 AS sub, label, t AS text, {tokens("t")} AS tokens, 0 AS first, length(t) AS last FROM walk WHERE how = 'whole'
  UNION ALL SELECT doc_id, no, i, 0, label, {normalized("substr(t, start + 1, stop - start)")}, {tokens("substr(t, start + 1, stop - start)")}, start, stop FROM walk WHERE how IN ('more', 'last'{", 'apart'" if gap_free else ""})
  UNION ALL SELECT doc_id, no, i, 0, label, {normalized("substr(t, start + 1)")}, {tokens(trim("substr(t, start + 1)"))}, start, length(t) FROM walk WHERE how IN ('merged'{"" if gap_free else ", 'apart'"})
  UNION ALL SELECT doc_id, no, i, 1, label, {normalized("rest")}, {tokens("rest")}, length(t) - length(rest), length(t) FROM walk WHERE how = 'apart'
),
chunk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no, i, sub) - 1 AS chunk_index, label, text, tokens, first, last FROM windows)"""


ORDER_CHUNKS = f"WITH RECURSIVE {CORPUS_SQL}, {order_segments()}, {chunks(240, 340, 400, 34, True)}"
OPINION_CHUNKS = f"WITH RECURSIVE {CORPUS_SQL}, {opinion_segments()}, {chunks(500, 600, 800, 90, True)}"
WHOLE_CHUNKS = f"WITH RECURSIVE seg AS (SELECT doc_id, 1 AS no, 'Opinion' AS label, text FROM documents), {chunks(500, 600, 800, 90, False)}"

#: Bytes of the DNS name space of RFC 4122 before the id, and the digest with its version and variant bits.
_DIGEST = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({x}))"
_VARIANT = "substr('89ab', (strpos('0123456789abcdef', substr({d}, 17, 1)) - 1) % 4 + 1, 1)"


def point_id(x: str) -> str:
    d = _DIGEST.format(x=x)
    return f"substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-5' || substr({d}, 14, 3) || '-' || {_VARIANT.format(d=d)} || substr({d}, 18, 3) || '-' || substr({d}, 21, 12)"


def hashed_words(source: str, dim: int) -> str:
    """Tables ending in `vec`: chunk_id and embedding (rounded) of the signed, hashed words of source's chunk_id, text."""
    return f"""word AS (SELECT chunk_id, unnest(string_split_regex({trim("lower(text)")}, '{BLANK}+')) AS word FROM ({source})),
hashed AS (SELECT word, ('0x' || substr(md5('0:' || word), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT word FROM word WHERE word <> '')),
placed AS (SELECT chunk_id, h % {dim} AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS v FROM word JOIN hashed USING (word) GROUP BY ALL),
made AS (SELECT chunk_id, map_from_entries(list((place, v))) AS seen, sqrt(sum(v * v)) AS length FROM placed GROUP BY chunk_id),
vec AS (SELECT s.chunk_id, list_transform(range({dim}), lambda i: round((coalesce(seen[i], 0) / greatest(length, 1e-12))::FLOAT::DOUBLE, 5)) AS embedding FROM ({source}) s LEFT JOIN made USING (chunk_id))"""


def code_citations(x: str, code: str, mark: str) -> str:
    """A list of (title, section, full_citation), in text order."""
    p = rf"(?i)(\d{{1,2}}){BLANK}*{code}{BLANK}*{mark}(\d+(?:\.\d+)?(?:\([a-z0-9]+\))*)"
    return f"list_transform(regexp_extract_all({x}, '{p}'), lambda m: {{'title': regexp_extract(m, '{p}', 1), 'section': regexp_extract(m, '{p}', 2), 'full_citation': trim(m)}})"


def cfr(x: str) -> str:
    return code_citations(x, rf"C\.?{BLANK}*F\.?{BLANK}*R\.?", rf"(?:Part{BLANK}*|§{BLANK}*)?")


def usc(x: str) -> str:
    return code_citations(x, rf"U\.?{BLANK}*S\.?{BLANK}*C\.?", rf"(?:§§?{BLANK}*)?")


# Amendments by their words, and their numerals.
_AMENDMENTS = {
    "first": "I",
    "second": "II",
    "third": "III",
    "fourth": "IV",
    "fifth": "V",
    "sixth": "VI",
    "seventh": "VII",
    "eighth": "VIII",
    "ninth": "IX",
    "tenth": "X",
    "eleventh": "XI",
    "twelfth": "XII",
    "thirteenth": "XIII",
    "fourteenth": "XIV",
    "fifteenth": "XV",
    "sixteenth": "XVI",
    "seventeenth": "XVII",
    "eighteenth": "XVIII",
    "nineteenth": "XIX",
    "twentieth": "XX",
    "twenty-first": "XXI",
    "twenty-second": "XXII",
    "twenty-third": "XXIII",
    "twenty-fourth": "XXIV",
    "twenty-fifth": "XXV",
    "twenty-sixth": "XXVI",
    "twenty-seventh": "XXVII",
}


def constitution(x: str) -> str:
    """A list of (type, number, section, clause, full_citation): articles, amendments, amendments by word."""
    b = BLANK
    article = rf"(?:U\.?S\.?{b}*Const\.?{b}*)?[Aa]rt(?:icle)?\.?{b}+([IVX]+)(?:,?{b}*§{b}*(\d+))?(?:,?{b}*cl\.?{b}*(\d+))?"
    amendment = rf"(?:U\.?S\.?{b}*Const\.?{b}*)?[Aa]mend(?:ment)?{b}+([IVX]+)(?:,?{b}*§{b}*(\d+))?"
    ordinal = rf"(?i)\b({'|'.join(_AMENDMENTS)}){b}+amendment\b"
    group = lambda p, k: f"nullif(regexp_extract(m, '{p}', {k}), '')"
    make = lambda kind, number, section, clause: f"{{'type': '{kind}', 'number': {number}, 'section': {section}, 'clause': {clause}, 'full_citation': trim(m)}}"
    numerals = ", ".join(f"'{word}': '{numeral}'" for word, numeral in _AMENDMENTS.items())
    numeral = f"map_extract_value(MAP {{{numerals}}}, lower(regexp_extract(m, '{ordinal}', 1)))"
    none = "cast(NULL AS VARCHAR)"
    return f"""list_concat(list_concat(list_transform(regexp_extract_all({x}, '{article}'), lambda m: {make("article", group(article, 1), group(article, 2), group(article, 3))}),
list_transform(regexp_extract_all({x}, '{amendment}'), lambda m: {make("amendment", group(amendment, 1), group(amendment, 2), none)})), list_transform(regexp_extract_all({x}, '{ordinal}'), lambda m: {make("amendment", numeral, none, none)}))"""


def first_of_each(x: str) -> str:
    """A list without repeats, in the order of first appearance."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


#: cite: doc_id and the three lists of formatted citations of orders.
CITATION_LISTS = f"""found AS (SELECT doc_id, topics, list_transform({usc("order_text")}, lambda r: r.title || ' U.S.C. § ' || r.section) AS u, list_transform({cfr("order_text")}, lambda r: r.title || ' C.F.R. § ' || r.section) AS f,
  list_transform({constitution("order_text")}, lambda r: 'U.S. Const. ' || CASE r.type WHEN 'article' THEN 'art. ' ELSE 'amend. ' END || r.number || coalesce(', § ' || r.section, '') || coalesce(', cl. ' || r.clause, '')) AS k FROM c),
cite AS (SELECT doc_id, topics, {first_of_each("k")} AS constitution_cited, {first_of_each("u")} AS federal_statutes_cited, {first_of_each("f")} AS federal_regulations_cited FROM found)"""
