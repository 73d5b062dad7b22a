"""Latent vectors against a plain decomposition, and against hashed words on documents about planted topics."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.operators import latent
from lexspark.operators.embed import embed, hashed_features


def _topics(n, seed):
    """Texts of six topics; each uses 8 of its topic's 60 words, so two of a topic often share none, beside words that all use."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        topic = i % 6
        words = rng.sample([f"t{topic}w{k}" for k in range(60)], 8) + rng.choices([f"common{k}" for k in range(12)], k=6)
        rng.shuffle(words)
        rows.append((i, " ".join(words), topic))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = _topics(900, 5) + [(9000, None, 0), (9001, "", 0), (9002, "  \n ", 0), (9003, "Word " * 40_000, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, topic int").repartition(5)


@pytest.fixture(scope="module")
def model(docs):
    return latent.fit(docs, dim=12, features=1024, rounds=6)


def _plain(texts, features):
    """The weighted rows as a dense matrix, word by word."""
    counts = [Counter(latent.place(w, features) for w in (t or "").lower().split()) for t in texts]
    fitted = [c for c, t in zip(counts, texts, strict=True) if t]
    df = Counter(p for c in fitted for p in c)
    out = np.zeros((len(texts), features))
    for i, c in enumerate(counts):
        for p, n in c.items():
            out[i, p] = (1 + math.log(n)) * (math.log((1 + len(fitted)) / (1 + df[p])) + 1)
        out[i] /= np.linalg.norm(out[i]) or 1
    return out


def test_equals_a_plain_decomposition(docs, model):
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    rows = _plain(texts, 1024)
    strengths, directions = np.linalg.svd(rows, full_matrices=False)[1:]
    assert model.n_documents == 902 and model.basis.shape == (1024, 12)
    assert model.strengths[:6] == pytest.approx(strengths[:6], rel=1e-3)
    assert np.linalg.svd(model.basis[:, :6].T @ directions[:6].T)[1] == pytest.approx(np.ones(6), abs=2e-2)  # the same subspace
    want = rows @ model.basis
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert np.array(model.embedder()(texts)) == pytest.approx(want, abs=1e-5)


def test_documents_without_words_are_zero(docs, model):
    found = {r["doc_id"]: r for r in embed(docs.where("doc_id >= 9000"), "text", 12, model.embedder()).collect()}
    assert all(set(found[i]["embedding"]) == {0.0} and not found[i]["embed_failed"] for i in (9000, 9001, 9002))
    assert np.linalg.norm(found[9003]["embedding"]) == pytest.approx(1, abs=1e-5)


def test_a_fit_may_be_repeated(docs, model):
    again = latent.fit(docs.repartition(3), dim=12, features=1024, rounds=6)
    texts = [r[1] for r in _topics(60, 8)]
    a, b = (np.array(m.embedder()(texts)) for m in (model, again))
    assert a[:, :6] == pytest.approx(b[:, :6], abs=2e-2)


def _recall(vectors, topics):
    """The share of the ten nearest others that are of one's own topic, by looking at all."""
    near = vectors @ vectors.T
    np.fill_diagonal(near, -2)
    best = np.argsort(-near, axis=1, kind="stable")[:, :10]
    return float(np.mean(topics[best] == topics[:, None]))


def test_neighbours_of_unseen_documents_beat_hashed_words(model):
    unseen = _topics(240, 99)
    texts, topics = [r[1] for r in unseen], np.array([r[2] for r in unseen])
    learned, hashed = _recall(np.array(model.embedder()(texts)), topics), _recall(np.array(hashed_features(12)(texts)), topics)
    wide = _recall(np.array(hashed_features(1024)(texts)), topics)
    assert learned >= 0.9 and learned > wide + 0.1 and learned > hashed + 0.3


def test_sample_is_bounded_and_chosen_by_hash(spark):
    many = spark.range(20_000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    kept = latent.chosen(many, "text", 1000)
    assert 800 < kept.count() < 1200
    assert sorted(kept.collect()) == sorted(latent.chosen(many.repartition(7), "text", 1000).collect())
    assert latent.chosen(many.limit(50), "text", 1000).count() == 50


def test_nothing_to_fit_on(docs):
    with pytest.raises(ValueError, match="no text"):
        latent.fit(docs.where("text IS NULL"))
