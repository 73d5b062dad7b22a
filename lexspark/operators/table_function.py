"""Chunks from SQL: a table function for LATERAL joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import chunk, segment
from .spread import spread

#: What a call gives for each chunk of a document.
CHUNK = "chunk_index int, section_label string, text string, token_count int, start_char int, end_char int"
CONFIGS = {"opinion": chunk.OPINION, "order": chunk.ORDER}


@F.udtf(returnType=CHUNK, useArrow=False)  # rows go to Python a hundred at a time; an Arrow batch would have all of its 10,000 texts there at once
class Chunks:
    """chunk(segments, kind [, gap_free]): the chunks of one document's labelled segments, numbered from 0.

    segments: array<struct<label, text>>, as segmented() or SQL makes them; null or empty gives no rows, a segment without text one empty
    chunk, as in chunk_documents. kind: 'opinion' or 'order'. gap_free: true unless given. Spark 4.1.2 drops documents without
    rows from a LEFT JOIN LATERAL with a Python function too; where they are needed, join the result to the documents.
    """

    def eval(self, segments: list[Row] | None, kind: str, gap_free: bool = True) -> Iterator[tuple]:
        if kind not in CONFIGS:
            raise ValueError(f"kind must be one of {', '.join(CONFIGS)}, not {kind}")
        index = 0
        for one in segments or []:
            for text, tokens, start, end in chunk.windows(one["text"] or "", CONFIGS[kind], gap_free):
                yield index, one["label"], text, tokens, start, end
                index += 1


def register(spark: SparkSession, name: str = "chunk") -> None:
    """Make the function known to the session's SQL."""
    spark.udtf.register(name, Chunks)


def segmented(docs: DataFrame, kind: str, text: str = "text", parity: bool = False) -> DataFrame:
    """docs with their labelled segments in place of the text, for LATERAL chunk(segments, kind); documents without text are left out."""
    of: dict[str, Column] = {"opinion": segment.opinion_segments(F.col(text), parity), "order": segment.order_segments(F.col(text), parity)}
    return spread(docs).where(F.coalesce(F.col(text), F.lit("")) != "").withColumn("segments", of[kind]).drop(text)
