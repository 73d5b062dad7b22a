"""Sliding-window chunks of labelled segments, and chunk tables of whole documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokenizers import quarter
from . import segment
from .spread import slices, spread

CHARS = 4
#: Characters that a token has at most on average, in a rest that may be too short to stand alone.
LONG_TOKEN = 40
CHUNKS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("text", T.StringType()), T.StructField("tokens", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_LEAD, _TAIL, _BLANK = re.compile(r"\A\s+"), re.compile(r"\s+\Z"), re.compile(r"\n\s*\n+")


@dataclass(frozen=True)
class ChunkConfig:
    """Token bounds of a kind of document."""

    min_tokens: int
    target_tokens: int
    max_tokens: int
    overlap_ratio: float

    def __post_init__(self) -> None:
        if min(self.min_tokens, self.target_tokens, self.max_tokens) <= 0:
            raise ValueError("token bounds must be positive")
        if self.min_tokens > self.max_tokens:
            raise ValueError("min_tokens must not exceed max_tokens")
        if not 0 <= self.overlap_ratio < 1:
            raise ValueError("overlap_ratio must be in [0, 1)")

    @property
    def overlap_tokens(self) -> int:
        return int(self.target_tokens * self.overlap_ratio)


OPINION, ORDER = ChunkConfig(500, 600, 800, 0.15), ChunkConfig(240, 340, 400, 0.10)


def normalized(text: str) -> str:
    return _BLANK.sub("\n\n", text.strip())


def windows(text: str, config: ChunkConfig, gap_free: bool = True, count: Callable[[str], int] = quarter) -> Iterator[tuple[str, int, int, int]]:
    """(text, tokens, start, end) of the chunks of one segment; offsets are in the normalized segment.

    gap_free: the next window starts one overlap before the end of the last, so no character is lost, and a
    tail that is too short to stand alone but too long to merge is a chunk of its own. Otherwise the
    source rules hold: a fixed step, and such a tail twice.
    """
    text = normalized(text)
    if count(text) <= max(config.min_tokens, config.target_tokens):
        yield text, count(text), 0, len(text)
        return
    overlap = config.overlap_tokens
    overlap = max(0, config.target_tokens - 1) if overlap >= config.target_tokens else overlap
    width, step = config.target_tokens * CHARS, max(1, config.target_tokens - overlap) * CHARS
    start, any_yet = 0, False
    while start < len(text):
        end = min(start + width, len(text))
        if end < len(text):
            cut = max(text.rfind(mark, start, end) for mark in (". ", "? ", "! ")) - start
            end = start + cut + 2 if cut > (end - start) * 0.8 else end
        # A rest of many times the least length is not counted: the next windows would count it again and again.
        rest = text[end:].strip() if len(text) - end <= config.min_tokens * LONG_TOKEN else ""
        if rest and 0 < count(rest) < config.min_tokens and any_yet:
            tail = text[start:].strip()
            merged = count(tail) <= config.max_tokens * 1.2
            if merged or not gap_free:
                yield normalized(tail), count(tail), start, len(text)
            else:
                yield normalized(text[start:end]), count(text[start:end]), start, end
            if not merged:
                yield normalized(rest), count(rest), len(text) - len(rest), len(text)
            return
        yield normalized(text[start:end]), count(text[start:end]), start, end
        any_yet = True
        if overlap > 0 and end < len(text):
            start = max(start + 1 if gap_free else start + step, end - overlap * CHARS)
        else:
            start = end


def chunk_column(segments: Column, config: ChunkConfig, gap_free: bool = True, count: Callable[[str], int] = quarter) -> Column:
    """array<struct<label, text, tokens, start, end>> of an array of segments; an Arrow helper, as each start depends on the last end."""

    @F.pandas_udf(CHUNKS)
    def of(column: pd.Series) -> pd.Series:
        return column.map(lambda segs: [{"label": s["label"], "text": t, "tokens": n, "start": a, "end": b} for s in segs for t, n, a, b in windows(s["text"] or "", config, gap_free, count)])

    return of(segments)


def _windows_of(config: ChunkConfig, gap_free: bool, others: list[str], count: Callable[[str], int], errors: bool):
    """A row for each chunk: the document's other columns, its index, and the chunk. errors: a failing document gives one row that says why."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in CHUNKS.elementType.fields]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        for batch in (b.slice(at, n) for b in batches for at, n in slices(b.num_rows, b.column("__segments").nbytes)):
            rows, index, found, reasons = [], [], [], []
            for i, segments in enumerate(batch.column("__segments").to_pylist()):
                try:
                    chunks = [(s["label"], t, n, a, b) for s in segments for t, n, a, b in windows(s["text"] or "", config, gap_free, count)]
                    reason = [None] * len(chunks)
                except Exception as e:
                    if not errors:
                        raise
                    chunks, reason = [(None,) * 5], [f"{type(e).__name__}: {e}"]
                rows += [i] * len(chunks)
                index += range(len(chunks))
                found += chunks
                reasons += reason
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in others]
            made = [pa.array([c[k] for c in found], kind) for k, kind in enumerate(kinds)]
            why = [pa.array(reasons, pa.string())] if errors else []
            yield pa.RecordBatch.from_arrays([*kept, pa.array(index, pa.int32()), *made, *why], [*others, "chunk_index", *(f"__{n}" for n in names), *(["error_message"] if errors else [])])

    return of


def chunk_documents(docs: DataFrame, kind: str, text: str = "text", key: str = "document_id", parity: bool = False, count: Callable[[str], int] = quarter, errors: bool = False) -> DataFrame:
    """docs' other columns with chunk_id, chunk_index, section_label, text, token_count, start_char, end_char.

    kind: "opinion" or "order"; count: the token counter. Documents without text give no rows. Chunks are numbered where
    they are made, so their index needs no window. errors: a document that cannot be chunked does not fail the job but gives one
    row, null but for its own columns and error_message.
    """
    config, segments = {"opinion": (OPINION, segment.opinion_segments), "order": (ORDER, segment.order_segments)}[kind]
    others = [c for c in docs.columns if c != text]
    kept = spread(docs).where(F.coalesce(F.col(text), F.lit("")) != "").select(*others, segments(F.col(text), parity).alias("__segments"))
    fields = [f for f in kept.schema.fields if f.name != "__segments"]
    why = [T.StructField("error_message", T.StringType())] if errors else []
    schema = T.StructType([*fields, T.StructField("chunk_index", T.IntegerType()), *(T.StructField(f"__{f.name}", f.dataType) for f in CHUNKS.elementType.fields), *why])
    rows = kept.mapInArrow(_windows_of(config, not parity, others, count, errors), schema)
    return rows.select(
        *others, F.concat_ws("_chunk_", F.col(key).cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index",
        F.col("__label").alias("section_label"), F.col("__text").alias("text"), F.col("__tokens").alias("token_count"),
        F.col("__start").alias("start_char"), F.col("__end").alias("end_char"), *(["error_message"] if errors else []),
    )
