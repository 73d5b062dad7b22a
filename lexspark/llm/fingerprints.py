"""Document fingerprints: a wide digest of the canonical text, checked byte by byte.

The canonical text is NFKC-normalised and case-folded with every run of white space as one blank, none
at the ends. Its 128-bit xxh3 and its length in bytes make the fingerprint. Wherever a fingerprint is
shared, the canonical texts are compared as bytes: a different text under the same digest gets a
fingerprint with a suffix. Which digests are shared is told by a bitmap of fixed size, so that only texts that may share one
are brought together; equal bytes are combined in each task before that.

Neighbours are found by a range sort of ids: inside a sorted partition each text meets the next, and only the first and
the last text of each partition are exchanged.

Edge cases: a null text counts as empty; empty and blank texts share a fingerprint; equal rows have equal
fingerprints; rows that share a doc_id are ordered by a hash of their text, and equal ones follow each other, in any
order; null doc_id comes last; a very long text is handled whole, as one value; extra columns, whatever their names, are ignored; an
empty table gives no rows. Likeness of two such fingerprints is 1.0 if the canonical texts are equal byte by byte, else 0.0,
as the digest is exact.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

#: Bytes of text in a range of neighbouring documents, and bits (as a power of 2) of the bitmap of shared digests.
RANGE_BYTES, BITS = 24 << 20, 25


def canonical(text: str | None) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest_of_form(form: bytes) -> str:
    return f"{xxhash.xxh3_128_hexdigest(form)}{len(form):x}"


def digest(text: str | None) -> str:
    return digest_of_form(canonical(text))


@F.pandas_udf(T.StringType())
def digest_of(texts: pd.Series) -> pd.Series:
    return texts.map(digest)


def shared_digests(digests: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the digests that several rows have, by their leading bits; it takes 2 ** bits bits whatever the number of rows."""
    shared = digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    bit = F.shiftrightunsigned(F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint"), 32 - bits)
    words = shared.select(F.shiftright(bit, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(31).cast("int")).alias("bits"))
    out = np.zeros(1 << max(0, bits - 5), dtype=np.uint32)
    rows = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # 2 ** (bits - 5) rows at most
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return out


_FORM = "doc_id bigint, key bigint, digest string, form binary"


def clashes(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """digest, form, variant: canonical texts that differ from the first text with their digest.

    digests: digest of each row of docs. Rows whose digest no other row has go no further than the bitmap, but for the
    few that share a bit with one that has.
    """
    bits = BITS
    shared = docs.sparkSession.sparkContext.broadcast(shared_digests(digests, bits))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(t) for texts in tokens.slices(batch.column("text")) for t in texts]
            found = np.array([digest_of_form(f) for f in forms], dtype=object)
            bit = np.array([int(d[:8], 16) >> (32 - bits) for d in found], dtype=np.int64)
            on = np.flatnonzero(shared.value[bit >> 5] >> (bit & 31).astype(np.uint32) & 1)
            take = lambda x: pa.array([x[i] for i in on])
            kept = batch.select(["doc_id", "key"]).take(pa.array(on))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found[on], pa.string()), take(forms).cast(pa.binary())], ["doc_id", "key", "digest", "form"])

    forms = docs.select("doc_id", common.text_key().alias("key"), "text").mapInArrow(of, _FORM)
    distinct = forms.groupBy("digest", "form").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    order = Window.partitionBy("digest").orderBy("first", "form")  # one row for each different text of a digest
    return distinct.withColumn("variant", F.row_number().over(order) - 1).where("variant > 0").select("digest", "form", "variant")


def with_variants(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """digests (doc_id, key, digest and more) with fingerprint: the digest, with a suffix where it clashes."""
    variants = common.durable(clashes(docs, digests))
    if variants.isEmpty():
        return digests.withColumn("fingerprint", F.col("digest"))
    form = F.pandas_udf(lambda texts: texts.map(canonical), T.BinaryType())
    forms = docs.select("doc_id", common.text_key().alias("key"), form("text").alias("form")).join(common.small(variants), "form")
    named = common.durable(forms.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), F.col("digest").alias("of"), "variant").distinct())
    joined = digests.join(common.small(named), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")) & (F.col("digest") == F.col("of")), "left")
    name = F.when(F.col("variant").isNull(), F.col("digest")).otherwise(F.concat_ws("-", "digest", F.col("variant").cast("string")))
    return joined.withColumn("fingerprint", name).drop("id", "k", "of", "variant")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and group (smallest doc_id with that fingerprint) of each row."""
    docs = docs.select("doc_id", "text")
    digests = common.durable(docs.select("doc_id", common.text_key().alias("key"), digest_of("text").alias("digest")))
    named = with_variants(docs, digests)
    groups = common.durable(named.groupBy("fingerprint").agg(F.min("doc_id").alias("group"), F.count("*").alias("n")))
    alone = named.join(groups.where("n = 1"), "fingerprint").select("doc_id", "fingerprint", "group")
    often = named.join(common.small(groups.where("n > 1")), "fingerprint").select("doc_id", "fingerprint", "group")
    return alone.unionByName(often)


#: kind DONE: a row of results; FIRST and LAST: a text at the edge of a partition.
DONE, FIRST, LAST = 0, 1, 2
_EDITED = (
    "kind int, part int, doc_id bigint, key bigint, n_chars bigint, edited_sha256 string, digest string, edited_digest string, "
    "near_edited double, near_next double, text string"
)
_NAMES = [x.split()[0] for x in _EDITED.split(", ")]
_SCHEMA = pa.schema([(x.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in _EDITED.split(", ")])


def _edit(text: str, form: bytes, following: str, next_form: bytes) -> tuple[int, str, str, str, float, float]:
    """Of a text and the next: n_chars, edited_sha256, both digests, and whether the canonical texts are the same."""
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed = canonical(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, digest_of_form(form), digest_of_form(changed), float(changed == form), float(next_form == form)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)] if rows else [pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all texts of a sorted partition but the last, and the texts at its edges."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        out = []
        for i, k, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
            text = text or ""
            form = canonical(text)
            if held is None:
                out.append((FIRST, part, i, k, *[None] * 6, text))
            else:
                out.append((DONE, part, *held[:2], *_edit(*held[2:], text, form), None))
            held = i, k, text, form
        yield _rows(out)
    if held is not None:
        yield _rows([(LAST, part, *held[:2], *[None] * 6, held[2])])


def _edited(texts: pd.Series, following: pd.Series) -> pd.DataFrame:
    rows = [_edit(a, canonical(a), b, canonical(b)) for a, b in zip(texts, following, strict=True)]
    return pd.DataFrame(rows, columns=_NAMES[4:10])


def edit_documents(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The columns of _EDITED but kind, part and text for every row: each text with the next one's head as its tail.

    The order is descending doc_id, null last; after the last document comes the first.
    """
    n = max(1, -(-common.total_bytes(docs) // range_bytes))
    keyed = docs.select("doc_id", "text", common.text_key().alias("key"), F.monotonically_increasing_id().alias("rid"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").desc(), F.col("rid")]
    sorted_ = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "key", "text")
    made = common.durable(sorted_.mapInArrow(_neighbours, _EDITED))
    columns = [c for c in _NAMES if c not in ("kind", "part", "text")]
    # Partitions that hold rows, one row for each: which comes after which, and the first again after the last.
    parts = made.where(F.col("kind") == FIRST).select("part")
    first = F.min("part").over(Window.partitionBy())
    then = parts.withColumn("then", F.coalesce(F.lead("part").over(Window.orderBy("part")), first))
    edges = made.where(F.col("kind") != DONE).select("kind", "part", "doc_id", "key", "text")
    last = edges.where(F.col("kind") == LAST).join(then, "part")
    head = edges.where(F.col("kind") == FIRST).select(F.col("part").alias("then"), F.col("text").alias("following"))
    edited = F.pandas_udf(_edited, "n_chars bigint, edited_sha256 string, digest string, edited_digest string, near_edited double, near_next double")
    joined = last.join(head, "then").select("doc_id", "key", edited("text", "following").alias("e"))
    return made.where(F.col("kind") == DONE).select(*columns).unionByName(joined.select("doc_id", "key", "e.*"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    named = with_variants(docs, edit_documents(docs))
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")
