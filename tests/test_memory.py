"""How much of a batch Python holds at a time, and expressions that were made faster against their first forms."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from lexspark.functions import citations, textclean, tokenizers
from lexspark.operators import chunk, embed, search, spread, table_function

TEXTS = [None, ""] + [f"{i} " * (i % 997) for i in range(4000)]


def _peak(of):
    tracemalloc.start()
    try:
        return of(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_slices_are_the_whole_batch():
    for n, size in ((0, 0), (1, 0), (1, 1 << 40), (1000, 1000), (1000, 1 << 30), (257, 1 << 21)):
        found = list(spread.slices(n, size))
        assert [i for at, k in found for i in range(at, at + k)] == list(range(n))
        assert all(k <= spread.SLICE_ROWS and (k == 1 or k * size <= n * spread.SLICE_BYTES) for _, k in found)


def test_token_counts_hold_a_slice():
    column = pa.array(TEXTS)
    got, peak = _peak(lambda: tokenizers.counted(column, len))
    assert got.to_pylist() == [len(t or "") for t in TEXTS]
    assert peak < column.nbytes / 2


def test_chunks_leave_by_slices():
    segments = pa.array([[{"label": "a", "text": t}] for t in TEXTS], pa.list_(pa.struct([("label", pa.string()), ("text", pa.string())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), segments], ["id", "__segments"])
    got = list(chunk._windows_of(chunk.ORDER, True, ["id"], tokenizers.quarter, False)(iter([batch])))
    rows = [r for b in got for r in zip(b["id"].to_pylist(), b["chunk_index"].to_pylist(), b["__text"].to_pylist(), strict=True)]
    assert rows == [(i, k, w[0]) for i, t in enumerate(TEXTS) for k, w in enumerate(chunk.windows(t or "", chunk.ORDER))]
    assert len(got) > 10 and max(len(set(b["id"].to_pylist())) for b in got) <= spread.SLICE_ROWS


def test_sql_chunks_take_rows_not_arrow_batches():
    assert table_function.Chunks.evalType == PythonEvalType.SQL_TABLE_UDF


def test_vectors_of_a_batch_are_packed():
    assert embed.hashed_features(8)(["a b", ""]).shape == (2, 8)


def test_pairs_of_blocks_are_read_where_they_lie():
    data = pa.array([search._packed(pa.table({"id": list(range(100_000)), "v": [[0.5]] * 100_000}))], pa.binary())
    (ids, _), peak = _peak(lambda: search._unpacked(data[0].as_buffer()))
    assert len(ids) == 100_000 and peak < data.nbytes / 2


def test_trimming_as_the_pattern_does(spark):
    s = textclean.SPACE
    by_pattern = lambda c: F.regexp_replace(F.regexp_replace(c, rf"(?<!{s}){s}++$", ""), rf"^{s}+", "")
    one = spark.range(0x10000).where("id NOT BETWEEN 55296 AND 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    for e in (F.col("c"), F.concat("c", F.lit("a"), "c"), F.concat(F.lit("a  "), "c", F.lit(" \n"))):
        assert one.where(~by_pattern(e).eqNullSafe(textclean.trim_space(e))).count() == 0
    assert "regexp" not in one.select(textclean.trim_space(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sign", ["{} amendment", "{}\n Amendments", "x{} amendment", "-{} Amendment.", "{}th amendment", "the {} fifth amendment"])
def test_ordinals_as_the_plain_list_finds_them(spark, sign):
    plain = rf"(?i)\b({'|'.join(citations.AMENDMENTS)})\s+amendment\b"
    rows = spark.createDataFrame([(f(sign.format(w)),) for w in citations.AMENDMENTS for f in (str, str.upper, str.title)], "t string")
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(1))
    assert rows.where(~found(plain).eqNullSafe(found(citations.ORDINAL))).count() == 0 and "(?=" in citations.ORDINAL
