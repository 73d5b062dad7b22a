"""Questions over ingested collections, against all pairs in numpy."""

import numpy as np
import pytest

from lexspark.operators import filters
from lexspark.operators.embed import hashed_features
from lexspark.plans import ingest
from lexspark.plans.corpora import corpus

FOLDER = "/root/testdata/sf0.001"
START = 1614556800  # 1 March 2021


def _orders(row):
    return bool({"State", "Energy"} & set(row["agencies"] or []))


def _opinions(row):
    return row["publication_date"] is not None and row["publication_date"] >= START


@pytest.mark.parametrize(
    ("kind", "raw", "condition", "plain"),
    [("order", ingest.raw_orders, lambda: filters.any_of("agencies", ["State", "Energy"]), _orders), ("opinion", ingest.raw_opinions, lambda: filters.opinion_filter(start=START), _opinions)],
    ids=["order", "opinion"],
)
def test_hits_are_the_best_of_all(spark, kind, raw, condition, plain):
    collection = ingest.stored(ingest.build_collection(ingest.KINDS[kind].prepare(raw(corpus(spark, FOLDER))), kind))
    asked = ingest.questions_of(spark, FOLDER)
    pages = {r["query_id"]: r["page"] for r in ingest.answer(asked, collection, kind, condition=condition()).collect()}
    found = {(r["query_id"], r["rank"]): r for r in ingest.hits(asked, collection, condition=condition()).collect()}
    chunks = [r for r in collection.collect() if plain(r)]
    of = lambda texts: np.array(hashed_features(64)(texts)).astype(np.float32).astype(float)
    questions = [r for r in asked.collect() if r["query"]]
    assert chunks and questions and len(chunks) < collection.count()
    near = of([q["query"] for q in questions]) @ of([c["text"] for c in chunks]).T
    for q, scores in zip(questions, near, strict=True):
        best = sorted(range(len(chunks)), key=lambda i: (-round(scores[i], 6), chunks[i]["point_id"]))[:5]
        for rank, i in enumerate(best, 1):
            got = found[q["query_id"], rank]
            assert got["score"] == pytest.approx(scores[i], abs=1e-6)
            if all(abs(scores[i] - scores[j]) > 1e-6 for j in range(len(chunks)) if j != i):
                assert got["point_id"] == chunks[i]["point_id"] and got["text"] == chunks[i]["text"]
        page = pages[q["query_id"]]
        assert page.count("###") + page.count("## ") >= 1 and q["query"][:40] in page
    assert len(found) == 5 * len(questions)
