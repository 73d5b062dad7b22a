"""Pluggable embedding and field extraction."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import citations, scalars
from .spread import sliced

Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 20


def hashed_features(dim: int, seed: int = 0) -> Embedder:
    """Signed feature hashing of words, scaled to length one; needs no model."""

    class Places(dict):
        def __missing__(self, word: str) -> int:
            """The word's place among those that add, or, `dim` further, among those that subtract."""
            h = int(hashlib.md5(f"{seed}:{word}".encode(), usedforsecurity=False).hexdigest()[:8], 16)
            self[word] = h % dim + (0 if h >> 31 else dim)
            return self[word]

    known = Places()

    def of(texts: list[str]) -> np.ndarray:
        if len(known) > 200_000:
            known.clear()
        n = np.zeros((len(texts), 2 * dim))
        for i, text in enumerate(texts):
            words = text.lower().split()
            n[i] = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=2 * dim)
        out = n[:, :dim] - n[:, dim:]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return of


def embed(df: DataFrame, text: str, dim: int, fn: Embedder | None = None, batch: int = BATCH) -> DataFrame:
    """df with embedding and embed_failed. A failing batch is tried item by item; a failing item gets a zero vector.

    Texts become Python objects a slice at a time, and vectors stay packed.
    """
    fn = fn or hashed_features(dim)

    def packed(vectors) -> pa.Array:
        if isinstance(vectors, np.ndarray) and vectors.ndim == 2:
            ends, values = np.arange(len(vectors) + 1) * vectors.shape[1], vectors.ravel()
        else:
            ends, values = np.cumsum([0, *map(len, vectors)]), np.concatenate([np.zeros(0), *vectors])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.float32)))

    def tried(part: list[str]) -> tuple[pa.Array, list[bool]]:
        try:
            got = fn(part)
            if len(got) != len(part):
                raise ValueError("one vector for each text is needed")
            return packed(got), [False] * len(part)
        except Exception:
            got = []
            for one in part:
                try:
                    got.append(packed([fn([one])[0]]))
                except Exception:
                    got.append(None)
            return pa.concat_arrays([packed([[0.0] * dim]) if v is None else v for v in got]), [v is None for v in got]

    @F.arrow_udf("embedding array<float>, failed boolean")
    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            vectors, failed = [pa.array([], pa.list_(pa.float32()))], []
            for texts in sliced(column):
                for i in range(0, len(texts), batch):
                    got, bad = tried([t or "" for t in texts[i : i + batch]])
                    vectors.append(got)
                    failed += bad
            yield pa.StructArray.from_arrays([pa.concat_arrays(vectors), pa.array(failed, pa.bool_())], ["embedding", "failed"])

    return df.withColumn("__e", of(F.col(text))).withColumn("embedding", F.col("__e.embedding")).withColumn("embed_failed", F.col("__e.failed")).drop("__e")


#: Takes texts, gives for each a record of extracted fields as JSON, or raises.
Extractor = Callable[[list[str]], list[str]]


def _records(fn: Extractor, batch: int = BATCH):
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        out: list[str | None] = []
        for i in range(0, len(texts), batch):
            part = [t or "" for t in texts.iloc[i : i + batch]]
            try:
                got = list(fn(part))
                if len(got) != len(part):
                    raise ValueError("one record for each text is needed")
            except Exception:
                got = []
                for one in part:
                    try:
                        got.append(fn([one])[0])
                    except Exception:
                        got.append(None)
            out += got
        return pd.Series(out, dtype=object)

    return of


def extract_fields(docs: DataFrame, text: str = "text", topics: str | None = None, kind: str = "opinion", fn: Extractor | None = None) -> DataFrame:
    """docs with citation lists, bounded topics, a count of citations and flags for reprocessing.

    Without fn, fields are found by fixed rules, and documents without text are flagged, with empty lists. fn gives a record (JSON)
    for each text; what it lacks gets defaults, and a document for which it fails gets the fallback record and both flags.
    """
    missing = F.coalesce(F.col(text), F.lit("")) == ""
    count = lambda of: sum((F.size(of[c]) for c in ("federal_statutes_cited", "federal_regulations_cited")), F.size(of["constitution_cited"]))
    if fn is not None:
        read = docs.withColumn("__record", scalars.parse_extraction(_records(fn)(F.col(text)), kind))
        fields = {f.name: F.col(f"__record.{f.name}") for f in read.schema["__record"].dataType.fields if f.name != "failed"}
        fields["topics_or_policy_areas"] = F.when(F.col("__record.failed"), fields["topics_or_policy_areas"]).otherwise(scalars.bounded_topics(fields["topics_or_policy_areas"], fill=kind == "order"))
        flag = F.col("__record.failed") | missing
        return read.withColumns(fields | {"total_citations": count(fields), "llm_extraction_failed": flag, "requires_reprocessing": flag}).drop("__record")
    lists = citations.citation_lists(F.col(text))
    found = F.col(topics) if topics else F.array().cast("array<string>")
    lists["topics_or_policy_areas"] = scalars.bounded_topics(found, fill=kind == "order")
    return docs.withColumns(lists | {"total_citations": count(lists), "llm_extraction_failed": missing, "requires_reprocessing": missing})


def to_reprocess(docs: DataFrame) -> DataFrame:
    return docs.where("requires_reprocessing")
