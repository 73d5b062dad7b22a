"""Derived legal corpora: the given tables hold none, so the same expressions make one in Spark and in SQL.

Every derived text holds the whole of a document's text, dealt in about equal parts to the places that the document has;
how many sections, letters, paragraphs, opinions and citations there are varies by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import spread

#: First step: numbers that decide on a document's structure. {S} is the string type, {DIV} whole division.
_NUMBERS = {
    "k": "doc_id % 4 + 1",
    "l": "CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END",
    "s": "CASE WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END",
    "m": "CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN 2 ELSE 1 END",
    "c": "CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END",
    "d": "CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END",
    "x": "CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END",
    "usc": "cast(doc_id % 50 + 1 as {S}) || ' U.S.C. § ' || cast(doc_id % 900 + 100 as {S})",
    "usc2": "cast(doc_id % 50 + 1 as {S}) || ' USC ' || cast(doc_id % 7 + 1000 as {S}) || '(a)'",
    "cfr": "cast(doc_id % 40 + 1 as {S}) || ' C.F.R. § ' || cast(doc_id % 300 + 1 as {S}) || '.' || cast(doc_id % 90 + 1 as {S})",
}
#: Second step: parts of an order (sections by k, letters by l) and of a set of opinions.
_COUNTS = {"n_order": "CASE k WHEN 1 THEN 1 WHEN 2 THEN 1 + l WHEN 3 THEN 2 + l ELSE 3 + l END", "n_court": "s + m + c + d + x"}


def _part(i: str, n: str) -> str:
    """Part i of n of the text; all parts together are the whole of it."""
    at = lambda i: f"(char_length(text) * ({i}) {{DIV}} ({n}))"
    return f"substr(text, cast({at(i)} as int) + 1, cast({at(f'({i}) + 1')} - {at(i)} as int))"


def _order() -> str:
    p = lambda i: _part(i, "n_order")
    letters = f"""'(a) ' || {p("1")} || chr(10) || '(b) Under ' || cfr || ', ' || {p("2")} || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '(i) first thing' || chr(10) || '(ii) second thing' || chr(10) ELSE '' END
|| CASE WHEN l = 3 THEN '(c) ' || {p("3")} || chr(10) ELSE '' END"""
    return f"""CASE WHEN doc_id % 13 = 0 THEN text ELSE CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'By the authority vested in me as President.' || chr(10) END || 'Section 1. Purpose. ' || {p("0")} || chr(10)
|| CASE WHEN k >= 2 THEN 'Sec. 2. Policy. See ' || usc || ' and ' || usc2 || '.' || chr(10) || CASE WHEN l = 1 THEN {p("1")} || chr(10) ELSE {letters} END ELSE '' END
|| CASE WHEN k >= 3 THEN 'Sec. 3. General. Article II, § 3, cl. 1 and the Fifth Amendment apply, with ' || usc || ' and U.S. Const. amendment XIV, § 1. ' || {p("1 + l")} || chr(10) ELSE '' END
|| CASE WHEN k >= 4 THEN 'Sec. 4a. ' || {p("2 + l")} ELSE '' END END"""


def _court() -> str:
    p = lambda i: f"replace({_part(i, 'n_court')}, chr(10), ' ')"
    majority = f"'Justice Alpha delivered the opinion of the Court. ' || {p('s')} || CASE WHEN m = 2 THEN '. I Under the law ' || {p('s + 1')} || '. II We hold so.' ELSE '' END || ' '"
    return f"""CASE WHEN n_court = 0 THEN text ELSE CASE WHEN s = 1 THEN 'Syllabus Held: ' || {p("0")} || ' ' ELSE '' END || CASE WHEN m > 0 THEN {majority} ELSE '' END
|| CASE WHEN c = 1 THEN 'Justice Beta, with whom Justice Delta joins, concurring. ' || {p("s + m")} || ' ' ELSE '' END || CASE WHEN x = 1 THEN 'Justice Epsilon, concurring in part and dissenting in part. ' || {p("s + m + c")} || ' ' ELSE '' END
|| CASE WHEN d = 1 THEN 'Justice Gamma, dissenting. ' || {p("s + m + c + x")} ELSE '' END END"""


_PRESIDENT = "CASE doc_id % 3 WHEN 0 THEN 'Ada Alpha' WHEN 1 THEN 'Ben Beta' ELSE 'Cy Gamma' END"
_JUSTICE = "CASE doc_id % 9 WHEN 0 THEN 'Roberts' WHEN 1 THEN 'Thomas' WHEN 2 THEN 'Alito' WHEN 3 THEN 'Kagan' ELSE 'Barrett' END"
_TYPE = "CASE doc_id % 6 WHEN 0 THEN '020lead' WHEN 1 THEN '030concurrence' WHEN 2 THEN '040dissent' WHEN 3 THEN '010combined' WHEN 4 THEN '060other' END"
_ARRAYS = {
    "agencies": (["State", "Labor"], ["Energy"], ["State", "Energy", "Justice"], []),
    "topics": (["trade", "work"], ["power", "trade", "law", "work", "tax", "land"], ["law"], ["a", "b", "c", "d", "e", "f", "g", "h", "i"]),
}


def _array(name: str, spark: bool) -> str:
    values = _ARRAYS[name]
    lit = lambda v: ("array(" if spark else "[") + ", ".join(f"'{x}'" for x in v) + (")" if spark else "]")
    empty = "cast(array() as array<string>)" if spark else "cast([] as varchar[])"
    return "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {lit(v) if v else empty}" for i, v in enumerate(values)) + " END"


def _steps(spark: bool) -> list[dict[str, str]]:
    """The columns that each step adds, or for the last one has."""
    s, div = ("string", "div") if spark else ("varchar", "//")
    day = "date_add(DATE'2021-01-20', cast(doc_id % 1400 as int))" if spark else "DATE '2021-01-20' + cast(doc_id % 1400 as integer)"
    case = "doc_id div 3" if spark else "doc_id // 3"
    last = {
        "doc_id": "doc_id", "document_id": "cast(doc_id as {S})", "text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars",
        "order_text": _order(), "court_text": _court(), "president": _PRESIDENT, "justice": _JUSTICE, "opinion_code": _TYPE,
        "agencies": _array("agencies", spark), "topics": _array("topics", spark), "signing_date": f"cast({day} as {s})", "case_id": f"cast({case} as bigint)",
        "order_number": "CASE WHEN doc_id % 11 = 0 THEN '' ELSE cast(14000 + doc_id as {S}) END",
        "case_name": f"CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'Case ' || cast({case} as {s}) END",
        "url": "'https://example.org/opinions/' || cast(doc_id as {S}) || '/'",
    }
    return [{n: e.replace("{S}", s).replace("{DIV}", div) for n, e in step.items()} for step in (_NUMBERS, _COUNTS, last)]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with an order text, a court text and legal metadata."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))  # small tables have one split
    numbers, counts, last = _steps(True)
    for step in (numbers, counts):
        docs = docs.select("*", *(F.expr(e).alias(n) for n, e in step.items()))
    return docs.select(*(F.expr(e).alias(n) for n, e in last.items()))


def _sql() -> str:
    source = "documents"
    numbers, counts, last = _steps(False)
    for step in (numbers, counts):
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {source})"
    return f"c AS (SELECT {', '.join(f'{e} AS {n}' for n, e in last.items())} FROM {source})"


#: The same as a common table expression `c`.
CORPUS_SQL = _sql()


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status log from events: the last event of a user and type is the state of a document."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    status = F.expr("CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'pending' ELSE 'processing' END")
    return events.select(
        F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("document_id"), F.expr("CASE user_id % 2 WHEN 0 THEN 'opinion' ELSE 'order' END").alias("document_type"),
        status.alias("status"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_at"), F.col("value").alias("processing_time_ms"),
    )


LOG_SQL = """log AS (SELECT 'd' || cast(user_id as varchar) AS document_id, CASE user_id % 2 WHEN 0 THEN 'opinion' ELSE 'order' END AS document_type,
CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'pending' ELSE 'processing' END AS status,
event_id AS seq, epoch_us(ts) AS created_at, epoch_us(ts) AS updated_at, value AS processing_time_ms FROM events),
state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, document_type ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)"""
