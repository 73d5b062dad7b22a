"""Literal expectations of scalar functions."""

import uuid

import pytest
from pyspark.sql import functions as F

from lexspark.functions import citations, dates, scalars, textclean


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "text"),
    [
        ('<pre class="inline">This is a test.</pre>', "This is a test."), ("", ""), ("<pre></pre>", ""), ("   ", ""), (None, ""),
        ("<p>a&nbsp;&amp; b</p>\n<b>c</b>", "a & b c"), ("x&lt;y", "x"), ("<p>one</p><p>two</p>", "onetwo"),
    ],
)
def test_strip_html(spark, raw, text):
    assert one(spark, textclean.strip_html(F.col("c").cast("string")), c=raw) == text.replace("x", "x<y" if raw == "x&lt;y" else "x")


def test_raw_text(spark):
    raw = '<html><pre>\n a &lt;b&gt; &amp;amp; <a href="u">link</a>&quot;q&quot; </pre><pre>2</pre></html>'
    assert one(spark, textclean.clean_raw_text(F.col("c")), c=raw) == 'a <b> &amp; "q"'
    assert one(spark, textclean.clean_raw_text(F.col("c")), c="plain &lt;") == "plain &lt;"


def test_normalize_space(spark):
    assert one(spark, textclean.normalize_space(F.col("c")), c=" \n a\n \n\n b\nc  ") == "a\n\n b\nc"


@pytest.mark.parametrize(("raw", "year"), [("2024-01-15", 2024), ("1789-09-24", 1789), ("2024/01/15", 2024), ("invalid", 1900), ("01-15-2024", 1900), ("", 1900), ("2024", 1900), (None, 1900)])
def test_year(spark, raw, year):
    assert one(spark, dates.year_of(F.col("c").cast("string"), 1900), c=raw) == year


def test_epochs(spark):
    c = F.col("c")
    assert one(spark, dates.epoch_of(c, "America/New_York"), c="1954-05-17") == -493156800
    assert one(spark, dates.epoch_of(c), c="1954-05-17") == -493171200
    assert one(spark, dates.epoch_of(c), c="") is None
    assert one(spark, dates.epoch_of(c, strict=False), c="2024-13-01") is None
    assert one(spark, dates.display_date(F.col("c")), c=1705276800) == "January 15, 2024"
    assert one(spark, dates.display_date(F.lit(None).cast("long"))) == ""
    assert str(one(spark, dates.date_of_timestamp(c), c="2024-05-16T23:30:00-07:00")) == "2024-05-16"


@pytest.mark.parametrize(("seconds", "text"), [(30.5, "30.5s"), (90.0, "1m 30s"), (3665.0, "1h 1m")])
def test_duration(spark, seconds, text):
    assert one(spark, dates.duration_text(F.col("c")), c=seconds) == text


@pytest.mark.parametrize(("raw", "ok"), [("2024-01-15", True), ("2024-02-30", False), ("2024/01/15", False), ("24-01-15", False), ("", False), (None, False)])
def test_valid_date(spark, raw, ok):
    assert one(spark, dates.valid_date(F.col("c").cast("string")), c=raw) is ok


def test_code_citations(spark):
    found = one(spark, citations.cfr_citations(F.col("c")), c="See 14 C.F.R. § 91.817 and 40 CFR Part 60, not C.F.R.")
    assert [(r["title"], r["section"]) for r in found] == [("14", "91.817"), ("40", "60")]
    found = one(spark, citations.usc_citations(F.col("c")), c="8 U.S.C. § 1182(f); 42 USC 1983")
    assert [(r["title"], r["section"], r["full_citation"]) for r in found] == [("8", "1182(f)", "8 U.S.C. § 1182(f)"), ("42", "1983", "42 USC 1983")]
    assert one(spark, citations.cfr_citations(F.col("c")), c="none") == []
    assert [r["title"] for r in one(spark, citations.cfr_citations(F.col("c"), strict=True), c="2014 CFR 5")] == []


def test_constitution_citations(spark):
    found = one(spark, citations.constitution_citations(F.col("c")), c="Art. I, § 9, cl. 7, amendment XIV and the Fifth Amendment, U.S. Const. amend. X")
    assert [(r["type"], r["number"], r["section"], r["clause"]) for r in found] == [("article", "I", "9", "7"), ("amendment", "XIV", None, None), ("amendment", "V", None, None)]
    strict = one(spark, citations.constitution_citations(F.col("c"), strict=True), c="Part III, U.S. Const. amend. X")
    assert [(r["type"], r["number"]) for r in strict] == [("amendment", "X")]
    assert [citations.AMENDMENTS[w] for w in ("fourth", "nineteenth", "twenty-seventh")] == ["IV", "XIX", "XXVII"] and len(citations.AMENDMENTS) == 27


def test_formats(spark):
    c = lambda v: F.lit(v).cast("string")
    assert one(spark, citations.format_cfr(c("14"), c("91.817"), c("2024"))) == "14 C.F.R. § 91.817 (2024)"
    assert one(spark, citations.format_usc(c("42"), c("1983"))) == "42 U.S.C. § 1983"
    assert one(spark, citations.format_constitution(c("I"), c(None), c("9"), c("7"))) == "U.S. Const. art. I, § 9, cl. 7"
    assert one(spark, citations.format_constitution(c(None), c("XIV"), c("1"), c(None))) == "U.S. Const. amend. XIV, § 1"
    assert one(spark, citations.format_constitution(c("I"), c("XIV"), c(None), c(None))) is None
    assert one(spark, citations.format_constitution(c(None), c(""), c(None), c(None))) is None


def test_point_ids(spark):
    ids = ["12345_chunk_0", "", "é", "x" * 300]
    got = {r["c"]: r["x"] for r in spark.createDataFrame([(i,) for i in ids], "c string").select("c", scalars.point_id(F.col("c")).alias("x")).collect()}
    assert got == {i: str(uuid.uuid5(uuid.NAMESPACE_DNS, i)) for i in ids}
    assert got["12345_chunk_0"] == "3ee1e09f-402f-5039-b753-2f8499d674e7"


def test_topics_and_extraction(spark):
    t = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    assert one(spark, scalars.bounded_topics(t(*"abcdefghij"))) == list("abcdefgh")
    assert one(spark, scalars.bounded_topics(t("a", "federal policy"), fill=True)) == ["a", "federal policy", "executive action", "government regulation"]
    failed = one(spark, scalars.parse_extraction(F.lit("{broken")))
    assert failed["failed"] and failed["topics_or_policy_areas"] == ["federal policy", "executive action"]
    order = one(spark, scalars.parse_extraction(F.lit("{broken"), "order"))
    assert order["topics_or_policy_areas"] == ["executive order", "federal policy", "presidential action"] and order["reasoning"] == "Unable to extract reasoning."
    fine = one(spark, scalars.parse_extraction(F.lit('{"holding_plain": "h"}')))
    assert not fine["failed"] and fine["holding_plain"] == "h" and fine["cases_cited"] == []


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, scalars.cosine(v(1.0, 0.0), v(1.0, 1.0))) == pytest.approx(2**-0.5)
    assert one(spark, scalars.cosine(v(0.0, 0.0), v(1.0, 1.0))) is None
