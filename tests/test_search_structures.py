"""The inverted file of vectors, positional postings and topics, against full scans."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.operators import cells, postings, search


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 16))
    rows = [(int(i), (middles[i % 30] + rng.normal(0, 0.35, 16)).tolist(), int(i % 3)) for i in range(6000)]
    rows += [(9000, None, 0), (9001, [1.0, 2.0], 0), (9002, [2.0, 1.0], 1), (9003, [0.0] * 16, 0), (9004, [], 0)]
    points = spark.createDataFrame(rows, "point_id bigint, embedding array<double>, label int").repartition(4).cache()
    queries = points.where("point_id % 100 = 0 OR point_id = 9001").select(F.col("point_id").alias("query_id"), "embedding")
    return queries, points


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return cells.build_cells(vectors[1], str(tmp_path_factory.mktemp("cells") / "points"), 60, sample=3000)


def found(df):
    return {(r["query_id"], r["point_id"]): r["rank"] for r in df.collect()}


def test_every_row_is_in_a_cell_and_recall_is_measured(vectors, index):
    queries, points = vectors
    assert index.points.count() == points.count() and len(index.centroids) == 60
    want, got = found(search.vector_search(queries, points)), found(cells.indexed_search(queries, index, probes=8))
    recall = sum(p in got for p in want) / len(want)
    asked = queries.where("query_id < 500")
    share = cells.scanned_share(asked, index, 8)
    assert recall >= 0.9
    assert 0 < share < 0.8


def test_exact_with_all_probes_filters_and_other_dimensions(vectors, index):
    queries, points = vectors
    for condition in (None, F.col("label") == 1):
        assert found(cells.indexed_search(queries, index, 7, condition, 0.1, probes=60)) == found(search.vector_search(queries, points, 7, condition, 0.1))
    own = cells.indexed_search(queries.where("query_id = 9001"), index, probes=1).collect()
    assert [r["point_id"] for r in own] == [9001, 9002]


def test_many_queries_meet_cells_in_blocks(vectors, index, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 16)
    monkeypatch.setattr(search, "POINT_BLOCK", 32)
    queries, points = vectors
    many = points.where("point_id < 300").select(F.col("point_id").alias("query_id"), "embedding")
    assert found(cells.indexed_search(many, index, 3, probes=60)) == found(search.vector_search(many, points, 3))


def test_empty_collections_have_an_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "point_id bigint, embedding array<double>")
    index = cells.build_cells(none, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    assert cells.indexed_search(asked, index).collect() == [] and cells.scanned_share(asked, index) == 0


TEXTS = [
    (1, "The order of the court. The court order, in the order."), (2, "In the order the Court"), (3, "court THE order"), (4, None), (5, ""), (6, "the-order the_order"), (7, "order " * 5000 + "of the court"), (None, "the order of nobody"),
]


def plain_hits(text, clause):
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    return sum(w[i : i + len(clause)] == clause for i in range(len(w) - len(clause) + 1))


@pytest.mark.parametrize("query", ["order", "the court", '"the order"', '"of the court" order', '"the order of the" in', "absent the", '"order order" court'])
def test_postings_by_scanning(spark, query):
    docs = spark.createDataFrame(TEXTS, "document_id bigint, text string")
    rows = postings.postings(docs)
    got = {r["document_id"]: r["score"] for r in postings.search_postings(spark, rows, query, len(TEXTS)).collect()}
    asked = postings.clauses(query)
    hits = {i: [plain_hits(t, c) for c in asked] for i, t in TEXTS if i is not None or True}
    holders = [sum(h[c] > 0 for h in hits.values()) for c in range(len(asked))]
    want = {i: sum(round(math.log((2 * len(TEXTS) + 2) / (2 * holders[c] + 1)), 6) * h[c] / (h[c] + 1) for c in range(len(asked))) for i, h in hits.items() if all(h)}
    assert got == pytest.approx(want, abs=2e-6)


def test_a_search_reads_the_buckets_of_its_terms(spark):
    docs = spark.range(3000).select(F.col("id").alias("document_id"), F.concat(F.lit("common word"), F.col("id").cast("string"), F.lit(" w"), (F.col("id") % 50).cast("string")).alias("text"))
    rows = postings.postings(docs)
    postings.save_postings(rows, "kept_postings", 16)
    saved = spark.table("kept_postings")
    asked = postings.search_postings(spark, saved, "word77", 3000)
    assert [r["document_id"] for r in asked.collect()] == [77]
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "EqualTo(term" in plan
    assert "SelectedBucketsCount: 1 out of 16" in plan
    spark.sql("DROP TABLE kept_postings")


def test_topics_by_counting(spark):
    texts = [(1, "Clean water and clean water rules"), (2, "water rules for clean energy"), (3, "energy"), (4, "of it"), (5, None), (6, "Élan vital élan vital water")]
    docs = spark.createDataFrame(texts, "document_id bigint, text string")
    cut = {i: [w for w in re.split(r"[^\w]+", (t or "").lower()) if len(w) >= 4] for i, t in texts}
    counts = {i: Counter(w + [" ".join(w[k : k + 2]) for k in range(len(w) - 1)]) for i, w in cut.items()}
    holders = Counter(t for c in counts.values() for t in c)
    want = {i: [t for _, t in sorted((-round(n * math.log((2 * 6 + 2) / (2 * holders[t] + 1)), 6), t) for t, n in c.items() if holders[t] >= 2)][:8] for i, c in counts.items()}
    assert {r["document_id"]: r["topics"] for r in postings.topics_of(docs).collect()} == want


def test_topics_with_few_common_words(spark, monkeypatch):
    """Phrases below a document's bound go no further, and none of the best is lost, however few words' holders are known where they are counted."""
    import random

    rng = random.Random(5)
    words = [f"word{i:03d}" for i in range(120)]
    texts = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(120)], k=rng.choice((3, 40, 400))))) for i in range(60)]
    docs = spark.createDataFrame(texts, "document_id bigint, text string")
    counts = {i: Counter(t.split() + [" ".join(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)]) for i, t in texts}
    holders = Counter(t for c in counts.values() for t in c)
    want = {i: [t for _, t in sorted((-round(n * math.log((2 * 60 + 2) / (2 * holders[t] + 1)), 6), t) for t, n in c.items() if holders[t] >= 2)][:8] for i, c in counts.items()}
    for common in (50_000, 10, 1):
        monkeypatch.setattr(postings, "COMMON", common)
        assert {r["document_id"]: r["topics"] for r in postings.topics_of(docs).collect()} == want


def test_phrases_are_counted_where_their_text_is(spark):
    plan = postings.topics_of(spark.range(100).select(F.col("id").alias("document_id"), F.lit("some long words").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(document_id#\d+L?, topic#", plan)
