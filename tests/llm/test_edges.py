"""Every operator and stage on nulls, repeats, long texts, clashing columns and empty tables."""

import pytest

import corpus_pipeline
from lexspark.llm import fingerprints, language, licenses, mixing, near_duplicates, phrases, queries, secrets, sharding, substrings

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} item{i % 31}" for i in range(30_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", None, 3), (None, "a text without an id but with words", "en", "a", 5), (None, None, None, None, None),
    (4, "the same row twice is here", "en", "b", 9), (4, "the same row twice is here", "en", "b", 9), (5, "one id", "de", "b", 1), (5, "another text of that id", "de", "b", 2),
    (6, LONG, "en", "a", 7), (7, LONG + " end", "en", "c", 7), (8, "12345 !!", "en", "c", 8), (9, "The same row twice is here", "en", "b", 9), (10, "\ud7ff\U0001f600 ß İ", "tr", "", 4),
]
CLASHES = {"shard": 1, "slot": 2, "size": 3, "rep": 4, "component": 5, "part": 6, "kind": 7, "n": 8, "bucket": 9, "h": 10, "hashes": 11, "score": 12, "label": 13, "at": 14}


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(request, spark, tmp_path_factory):
    rows = ROWS if request.param == "odd" else []
    path = str(tmp_path_factory.mktemp(request.param))
    docs = spark.createDataFrame(rows, COLUMNS)
    for name, value in CLASHES.items():
        from pyspark.sql import functions as F

        docs = docs.withColumn(name, F.lit(value))
    docs.repartition(2).write.parquet(f"{path}/documents.parquet")
    items = [(1, "row twice"), (2, None), (3, "word5 item5 word6 item6 word7 item7 word8 item8 word9 item9 word10 item10 word11 item11")] if rows else []
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path, len(rows)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op12_prefix_trie", "op13_ranking")])
def test_every_row_gets_a_result(spark, folder, name):
    path, n = folder
    rows = queries.QUERIES[name](spark, path).collect()
    assert len(rows) == n
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS[:n])


def test_stages(spark, folder, tmp_path):
    path, n = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() == corpus_pipeline.run(spark, path).count()
    assert docs.count() > 0 or not n


def test_defined_results(spark):
    docs = spark.createDataFrame(ROWS, COLUMNS)
    of = lambda df, i: [r for r in df.collect() if r["doc_id"] == i]
    near = near_duplicates.near_duplicates(docs)
    assert [tuple(r)[1:] for r in of(near, 1)] == [(0, 1, True)]
    assert [tuple(r)[1:] for r in of(near, 4)] == [(2, 4, True)] * 2
    assert [tuple(r)[2:] for r in of(near, 9)] == [(4, False)]
    assert [tuple(r)[2:] for r in of(near, 5)] == [(5, True)] * 2
    assert [tuple(r)[2:] for r in of(near, 7)] == [(6, False)]
    gone = of(substrings.remove_substrings(docs), 7)[0]
    assert gone["n_removed"] == len(LONG) and gone["kept"] == b" end"
    assert of(phrases.remove_phrases(docs), 7)[0]["kept"].split() == LONG.split()[:0] + [b"end"]
    model = language.fit(docs)
    pred = language.predict(spark, model)
    assert {r["doc_id"]: r["p"]["lang_pred"] for r in docs.select("doc_id", pred.alias("p")).collect() if r["doc_id"] in (1, 2, 3, 8)} == dict.fromkeys((1, 2, 3, 8), "und")
    assert {r["fingerprint"] for r in fingerprints.fingerprint_documents(docs).collect() if r["doc_id"] in (1, 2, 3)} == {fingerprints.digest("")}
    assert {r["size"] for r in mixing.mix(docs).collect() if r["doc_id"] in (1, 2, 3)} == {0}
    assert sharding.shard_records(docs).count() == len(ROWS)
    assert of(licenses.scan_licenses(docs), 1)[0]["license"] is None
    assert [s["kind"] for s in of(secrets.scan(docs, secrets.fit(docs)), 6)[0]["spans"]] == []


def test_language_on_held_out_documents(spark):
    docs = "/root/testdata/sf0.01"
    got = language.op7_language(spark, docs).where("held_out")
    truth = spark.read.parquet(f"{docs}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
