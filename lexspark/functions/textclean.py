"""Cleaning of HTML and raw text, as Column expressions."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.spread import sliced

#: Unicode white space, as (?U)\s of the JVM sees it.
SPACE = r"(?U)\s"
#: The same as characters.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TAG = "<[^>]+>"


@F.arrow_udf(T.StringType())
def decode_entities(texts: pa.Array) -> pa.Array:
    """HTML entities decoded; the JVM has no built-in for it."""
    parts = [pa.array([html.unescape(t) if t and "&" in t else t for t in part], pa.string()) for part in sliced(texts)]
    return pa.concat_arrays([pa.array([], pa.string()), *parts])


def trim_space(c: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.btrim(c, F.lit(SPACES))


def strip_html(c: Column, entities: bool = True) -> Column:
    """Entities decoded, tags deleted, white space collapsed; null gives ''."""
    text = F.coalesce(c, F.lit(""))
    text = decode_entities(text) if entities else text
    return F.trim(F.regexp_replace(F.regexp_replace(text, TAG, ""), rf"{SPACE}+", " "))


def clean_raw_text(c: Column) -> Column:
    """The first <pre> of a text that starts as HTML: four entities decoded, links deleted with their content."""
    body = F.regexp_extract(c, "(?s)<pre>(.*?)</pre>", 1)
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        body = F.replace(body, F.lit(entity), F.lit(sign))
    whole = c.startswith("<html>") & c.rlike("(?s)<pre>.*?</pre>")
    return F.when(whole, trim_space(F.regexp_replace(body, "(?s)<a[^>]*>.*?</a>", ""))).otherwise(c)


def normalize_space(c: Column) -> Column:
    """Trimmed, with runs of blank lines as one blank line."""
    return F.regexp_replace(trim_space(c), r"(?U)\n\s*\n+", "\n\n")


def token_count(c: Column) -> Column:
    """Four characters a token."""
    return F.floor(F.char_length(c) / 4).cast("int")
