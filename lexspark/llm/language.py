"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every run of non-letters counts as one blank; n-grams of one to three code
points are hashed into a fixed number of buckets. Training sums bucket counts by language inside tasks
and in one small shuffle; the log-probability matrix (256 KB a language) is
broadcast, and whole texts are scored in numpy: the n-grams of a batch of texts look up their rows of the matrix, and
a segmented sum gives the totals of each text.

The model is fitted on at most about max_train labelled documents, chosen by a hash of the doc_id, of each
language as many, or all where it has fewer; every label can be predicted, and every document is scored.

keep_identified rejects a document without letters, one whose language is unsure, and one that is like none of the
languages: its mean log-probability an n-gram is more than UNLIKE below what its language's own texts have.

Edge cases: a text that is null or has no letter is "und" with score 0; without any labelled training
row every text is "und" (and the pipeline's stage, which then has nothing to reject by, keeps what has letters); ties go to the
language that sorts first; rows are scored one by one, so equal rows get equal results; a very long text is scored
in slices; extra columns, whatever their names, pass through unchanged; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, ORDERS, BLOCK, MAX_TRAIN, UNKNOWN = 1 << 16, (1, 2, 3), 4096, 40_000, "und"
#: A pipeline drops what is undetermined, less sure than this, or by so many nats an n-gram unlike its language.
MIN_SCORE, UNLIKE = 0.5, 4.0
#: Code points that are put through numpy at once.
SLICE = 1 << 18
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lower-cased texts, and the number of the text that each belongs to.

    A text with letters has a blank at both ends and one for each run of non-letters; one without letters has nothing.
    """
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(f"{t}\n" for t in lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    letter = _letters()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first of each run of non-letters
    points, owner = np.where(letter, points, 32)[kept].astype(np.uint32), owner[kept]
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else owner
    return np.insert(points, first, 32), np.insert(owner, first, owner[first])


def _grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, ascending, and bucket numbers) of the n-grams of texts, order by order and slice by slice."""
    points, owner = _folded(texts)
    for at in range(0, len(points), SLICE):  # the next slice starts inside, so no n-gram is lost
        p, o = points[at : at + SLICE + ORDERS[-1] - 1], owner[at : at + SLICE + ORDERS[-1] - 1]
        for n in ORDERS:
            size = min(SLICE, len(p) - n + 1)
            if size > 0:
                h = np.full(size, n, dtype=np.uint32)
                for k in range(n):
                    h = (h ^ p[k : size + k]) * _ODD[k]
                    h ^= h >> np.uint32(15)
                whole = o[:size] == o[n - 1 : n - 1 + size]
                yield o[:size][whole], (((h * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int64) % BUCKETS)[whole]


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # languages x buckets
    log_prior: np.ndarray
    usual: np.ndarray  # mean log-probability an n-gram of each language's own texts

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Of each text the likeliest language, its posterior probability, and how far below usual its n-grams are."""
        n = len(texts)
        if not self.languages:
            known = [any(c.isalpha() for c in t or "") for t in texts]
            return [UNKNOWN] * n, [0.0] * n, [0.0 if k else float("inf") for k in known]
        total, grams = np.zeros((n, len(self.languages))), np.zeros(n, dtype=np.int64)
        for owner, bucket in _grams(texts):
            if len(owner):
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                grams[owner[first]] += np.diff(np.concatenate((first, [len(owner)])))
                for k, row in enumerate(self.log_probability):
                    total[owner[first], k] += np.add.reduceat(row[bucket], first, dtype=np.float64)
        known = grams > 0
        mean = total / np.maximum(grams, 1)[:, None]
        total += self.log_prior
        best = total.argmax(axis=1)
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        below = np.where(known, self.usual[best] - mean[np.arange(n), best], np.inf)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, posterior, 0.0).tolist(), below.tolist()


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about SLICE characters."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t or "") > SLICE:
            yield at, i
            at, n = i, 0
        n += len(t or "") + 2
    if at < len(texts):
        yield at, len(texts)


_COUNTS = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])
_COUNTS_DDL = "lang string, block int, places binary, counts binary"


def _sparse(lang: str, block: int, counts: np.ndarray) -> tuple:
    places = np.flatnonzero(counts)
    return lang, block, places.astype(np.uint16).tobytes(), counts[places].tobytes()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts by language of this task's documents, in blocks; only buckets that occur."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            own = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            mine = [texts[i] for i in np.flatnonzero(langs == lang)]
            for a, b in _batches(mine):
                for _, bucket in _grams(mine[a:b]):
                    own += np.bincount(bucket, minlength=BUCKETS)
    rows = [_sparse(lang, b, own[b * BLOCK : (b + 1) * BLOCK]) for lang, own in counts.items() for b in range(BUCKETS // BLOCK)]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_COUNTS)], schema=_COUNTS)


def _sum_blocks(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, dtype=np.int64)
    for places, counts in zip(table.column("places").to_pylist(), table.column("counts").to_pylist(), strict=True):
        total[np.frombuffer(places, dtype=np.uint16)] += np.frombuffer(counts, dtype=np.int64)
    row = _sparse(table.column("lang")[0].as_py(), table.column("block")[0].as_py(), total)
    return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, _COUNTS, strict=True)], schema=_COUNTS)


def _quota(sizes: list[int], most: int) -> float:
    """Documents to take of each language, so that they are most in all; a language with fewer leaves its rest to the others."""
    left = most
    for i, n in enumerate(sorted(sizes)):
        if n > left / (len(sizes) - i):
            return left / (len(sizes) - i)
        left -= n
    return float("inf")


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on text and lang of the rows of labelled whose lang is not null; every label is a language.

    The driver gets a row for each language and block of buckets with the buckets that occur there, and makes BUCKETS numbers of 4 bytes a language.
    """
    labelled = labelled.where("lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    quota = _quota(list(sizes.values()), max_train)
    shares = labelled.sparkSession.createDataFrame([(lang, 2.0 if quota >= n else quota / n) for lang, n in sizes.items()], "lang string, share double")
    chosen = labelled.join(F.broadcast(shares), "lang").where(common.sampled(F.col("share"), F.lit("train"), F.col("doc_id"), common.text_key()))
    summed = chosen.select("lang", "text").mapInArrow(_count, _COUNTS_DDL).groupBy("lang", "block").applyInArrow(_sum_blocks, _COUNTS_DDL).collect()
    languages = sorted({r["lang"] for r in summed})
    if sizes and not languages:
        raise ValueError("no labelled document was chosen to learn from")
    blocks: dict[str, list] = {lang: [] for lang in languages}
    for r in summed:
        blocks[r["lang"]].append(r)
    log_probability, usual = np.zeros((len(languages), BUCKETS), dtype=np.float32), np.zeros(len(languages))
    for i, lang in enumerate(languages):
        counts = np.zeros(BUCKETS)
        for r in blocks.pop(lang):
            counts[r["block"] * BLOCK + np.frombuffer(r["places"], dtype=np.uint16)] = np.frombuffer(r["counts"], dtype=np.int64)
        logs = np.log((counts + 0.5) / (counts + 0.5).sum())
        log_probability[i], usual[i] = logs, counts @ logs / max(1, counts.sum())
    prior = np.log(np.array([sizes[x] for x in languages], dtype=float) / max(1, sum(sizes[x] for x in languages)))
    return Model(languages, log_probability, prior, usual)


def predict(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """struct<lang_pred string, score double, below double> of a text column; below: nats an n-gram below the usual."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, below double")
    def of(texts: pd.Series) -> pd.DataFrame:
        plain = [t if isinstance(t, str) else None for t in texts]
        parts = [shared.value.scores(plain[a:b]) for a, b in _batches(plain)]
        languages, scores, below = ([x for p in parts for x in p[k]] for k in range(3))
        return pd.DataFrame({"lang_pred": languages, "score": scores, "below": below})

    return of(F.col(text))


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, unlike: float = UNLIKE, max_train: int = MAX_TRAIN) -> DataFrame:
    """Rows of docs whose language is identified with at least min_score and whose text is like it; the columns of docs."""
    model = fit(docs, max_train)
    found = docs.select(common.packed(docs).alias("row"), predict(docs.sparkSession, model).alias("p"))
    sure = (F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= min_score) if model.languages else F.lit(True)
    return found.where(sure & (F.col("p.below") <= unlike)).select("row.*")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those not held out."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 4 == 2
    model = fit(docs.where(~held))
    found = docs.select("doc_id", held.alias("held_out"), predict(spark, model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
