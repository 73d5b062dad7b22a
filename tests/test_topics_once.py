"""Topics: phrases are made once a document, and are those of a plain count, whatever few words are held as common."""

import math
import random
from collections import Counter

import pytest

from lexspark.operators import postings


def _plain(docs, phrase, letters, holders, most):
    counts = {}
    for i, t in docs:
        w = [x for x in (t or "").split() if len(x) >= letters]
        counts[i] = Counter(" ".join(w[j : j + n]) for n in range(1, phrase + 1) for j in range(len(w) - n + 1))
    held = Counter(p for c in counts.values() for p in c)
    weight = lambda p, n: round(n * math.log((2 * len(docs) + 2) / (2 * held[p] + 1)), 6)
    return {i: sorted((p for p in c if held[p] >= holders), key=lambda p: (-weight(p, c[p]), p))[:most] for i, c in counts.items()}


@pytest.mark.parametrize(("phrase", "common"), [(2, 50_000), (2, 5), (3, 20)])
def test_topics_are_those_of_a_plain_count(spark, monkeypatch, phrase, common):
    rng = random.Random(phrase + common)
    words = [f"word{chr(97 + k)}" for k in range(20)] + ["of", "in"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 12, 80])))) for i in range(120)] + [(500, None), (501, "of in")]
    monkeypatch.setattr(postings, "COMMON", common)
    found = postings.topics_of(spark.createDataFrame(docs, "document_id bigint, text string"), phrase=phrase)
    assert {r["document_id"]: r["topics"] for r in found.collect()} == _plain(docs, phrase, 4, 2, 8)


def test_phrases_are_made_once(spark):
    docs = spark.range(50).selectExpr("id AS document_id", "concat('word', id % 7, ' other', id % 5) AS text")
    plan = postings.topics_of(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("zip_with(") == plan.count("Generate explode(concat(") == 1
