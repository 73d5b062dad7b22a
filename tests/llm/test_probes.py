"""Repeated rows, clashing names and hot keys that once gave wrong results."""

import time

import pytest
from pyspark.sql import functions as F

from lexspark.llm import common, decontamination, language, mixing, near_duplicates, secrets, sharding

COLUMNS = "doc_id bigint, text string, lang string, source string"


def test_spans_of_repeated_rows_and_original_text(spark):
    docs = spark.createDataFrame([(1, "Keep  this. ONE, two; Three and more!"), (1, "Keep  this. ONE, two; Three and more!"), (2, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "one two three"), (8, "One Two three"), (9, None)], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["clean_text"]) for r in decontamination.remove_spans(docs, items).collect())
    assert got == [(1, "Keep  this. and more!"), (1, "Keep  this. and more!"), (2, None)]
    rows = decontamination.contamination(docs, items).where("n_hit > 0").collect()
    assert [(r["n_words"], r["n_hit"], sorted(r["items"])) for r in rows] == [(7, 3, [7, 8])] * 2


@pytest.mark.parametrize("broadcast", [True, False])
def test_window_lengths(spark, monkeypatch, broadcast):
    """Items of one to sixteen words, against a plain search; also by the way for sets too large to broadcast."""
    if not broadcast:
        monkeypatch.setattr(decontamination.common, "fits", lambda *a, **k: False)
    text = " ".join(f"w{i % 17}" for i in range(60))
    words = text.split()
    items = [(m, " ".join(words[3 : 3 + m])) for m in range(1, 17)] + [(50, "w1 w3")]
    docs = spark.createDataFrame([(1, text), (2, "w4"), (3, "")], "doc_id bigint, text string")
    got = {r["id"]: r for r in decontamination.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    hit = set()
    for _, item in items:
        w = item.split()
        m = min(13, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
        hit |= {p for i in range(len(words) - m + 1) if tuple(words[i : i + m]) in windows for p in range(i, i + m)}
    assert got[1]["n_hit"] == len(hit) and set(got[1]["items"]) == set(range(1, 17))
    assert got[2]["n_hit"] == 0 and got[3]["n_words"] == 0


def test_one_scan_for_all_window_lengths(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    items = spark.createDataFrame([(m, " ".join("abcdef"[:m])) for m in range(1, 6)], "item_id bigint, text string")
    assert decontamination._lengths(decontamination.benchmark_windows(items)) == [1, 2, 3, 4, 5]
    assert decontamination.contamination(docs, items).first()["n_hit"] == 5


def test_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s")], COLUMNS)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.drop_contaminated(docs, none).collect() == docs.collect()


def test_mix_of_equal_rows_in_two_sources(spark, tmp_path):
    rows = [(i % 3, "one two three", "en", s) for i in range(12) for s in ("x", "y")] + [(90 + i, f"w{i} v", "en", "y") for i in range(20)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = {r["source"]: r["n"] for r in mixing.mix(docs).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    got = {r["source"]: r["count"] for r in mixing.mixed_documents(docs).groupBy("source").count().collect()}
    assert got == want


def test_mix_does_not_depend_on_the_layout(spark):
    rows = [(i % 7, f"text {i % 5} of three", "en", "abc"[i % 3]) for i in range(100)]
    of = lambda n: sorted(map(tuple, mixing.mix(spark.createDataFrame(rows, COLUMNS).repartition(n)).select("doc_id", "source", "size", "copies").collect()), key=str)
    assert of(2) == of(7)


def test_clashing_names_pass_through(spark):
    docs = spark.createDataFrame([(i, f"some text number {i} here", "en", "s") for i in range(9)], COLUMNS)
    for i, name in enumerate(("__offset", "__key", "__bucket", "__language", "row", "key", "bucket", "n", "id", "h", "rid", "place", "copy", "range", "taken", "often_id", "b", "hit_id", "with.dot")):
        docs = docs.withColumn(name, F.lit(i))
    want = sorted(map(tuple, docs.collect()))
    items = spark.createDataFrame([(1, "nothing of it")], "item_id bigint, text string")
    same = lambda df: sorted({tuple(r) for r in df.select(*(f"`{c}`" for c in docs.columns)).collect()}) == want and df.columns[: len(docs.columns)] == docs.columns
    assert same(sharding.shard_records(docs))
    assert same(decontamination.drop_contaminated(docs, items))
    assert same(language.keep_identified(docs))
    assert same(near_duplicates.keep_one_of_each(docs))
    assert all(tuple(r) in want for r in mixing.mixed_documents(docs).select(*(f"`{c}`" for c in docs.columns)).collect())


def test_equal_rows_are_spread_over_shard_buckets(spark):
    docs = spark.createDataFrame([(None, None, "en", "s")] * 300 + [(i, f"text {i}", "en", "s") for i in range(50)], COLUMNS)
    rows = sharding._scattered(docs, 40, 1, heavy=10).where("row.doc_id IS NULL").groupBy("bucket").count().collect()
    assert len(rows) > 10
    out = sharding.shard_records(docs, heavy=10, bucket_bytes=20).collect()
    assert len(out) == 350 and sorted((r["shard"], r["slot"]) for r in out) == sorted((i % 16, i // 16) for i in range(350))


def test_many_labels_and_texts_of_no_language(spark):
    rows = [(i, f"the quick brown fox number {i} runs over the lazy dog", f"l{i}" if i < 300 else "en", "s") for i in range(800)]
    rows += [(900, "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440", "en", "s"), (901, "12 34", "en", "s"), (902, "over the lazy dog", None, "s")]
    docs = spark.createDataFrame(rows, COLUMNS)
    model = language.fit(docs)
    assert model.languages == sorted({"en", *(f"l{i}" for i in range(300))})
    clean = spark.createDataFrame([r for r in rows if r[2] == "en" or r[2] is None], COLUMNS)
    kept = {r["doc_id"] for r in language.keep_identified(clean, max_train=300).collect()}
    assert 902 in kept and not kept & {901} and len(kept) >= 500


def test_scores_of_batches_are_those_of_single_texts(spark):
    docs = spark.createDataFrame([(i, t, lang, "s") for i, (t, lang) in enumerate([("ab ab, abc!", "x"), ("xyz zyx", "y"), ("\u00e9\u00df", "x")])], COLUMNS)
    model = language.fit(docs)
    texts = ["abc", None, "", "12", "xyz zyx zz " * 40_000, "\u0130b", " ab", "ab "]
    whole = model.scores(texts)
    for i, t in enumerate(texts):
        one = model.scores([t])
        assert one[0][0] == whole[0][i] and one[1][0] == pytest.approx(whole[1][i]) and one[2][0] == pytest.approx(whole[2][i])


def test_many_findings_of_a_document(spark):
    text = " ".join(f"token={i:08d}abcd x{i}yz12345678" for i in range(20_000))
    began = time.time()
    base = secrets.base_spans(text)
    other = secrets.apart(secrets.candidates(text), base)
    assert time.time() - began < 5 and len(base) == 20_000 and len(other) == 20_000
    spans, found = [(0, 0, 5), (3, 1, 20), (30, 0, 40)], [(5, 8), (19, 25), (20, 30), (39, 41), (40, 50)]
    assert secrets.apart(found, spans) == [(a, b) for a, b in found if not any(s < b and a < e for s, _, e in spans)]


def test_shares_of_very_large_inputs_are_not_zero(spark):
    """A share that 20 bits would round to none still takes rows, about as many as it says."""
    from pyspark.sql import functions as F

    rows = spark.range(4_000_000)
    taken = lambda share: rows.where(common.sampled(share, F.lit("x"), F.col("id"))).count()
    assert 1 <= taken(2e-6) <= 24 and taken(2.0) == 4_000_000 and taken(0.0) == 0
    assert abs(taken(0.25) - 1_000_000) < 10_000


def test_values_of_secrets_are_on_one_side_of_the_splits():
    import numpy as np

    seen: dict = {}
    rows = secrets.generated(300, 1)
    twins = rows.copy()
    twins[:, : secrets.LEFT] = 120
    other = np.random.default_rng(0).integers(97, 123, (600, secrets.FIELD)).astype(np.uint8)
    data, y = np.concatenate([rows, twins, other]), np.concatenate([np.ones(len(rows) * 2), np.zeros(600)])
    network = secrets.train(data, y, epochs=2)
    assert network.recall is not None and 0 <= network.recall <= 1
    value = [r[secrets.LEFT : secrets.LEFT + secrets.BODY].tobytes() for r in data]
    _, group = np.unique(data[:, secrets.LEFT : secrets.LEFT + secrets.BODY], axis=0, return_inverse=True)
    for v, g in zip(value, group.tolist(), strict=True):
        assert seen.setdefault(v, g) == g
