"""Segments, chunks, search, collections, progress, streaming."""

import os
import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.functions import tokenizers
from lexspark.operators import chunk, embed, filters, normalize, progress, render, search, segment, store
from lexspark.sources import records
from lexspark.streaming import ingest

ORDER_TEXT = "By the authority vested in me.\nSection 1. Purpose. Some text.\nSec. 2. Policy. Lead text.\n(a) First;\n(b) second:\n(ii) one\n(iii) two\nSec. 3. General. End."
OPINION_TEXT = (
    "OCTOBER TERM Syllabus Held: yes. Justice Thomas delivered the opinion of the Court. Facts. Justice Kagan, with whom Justice Barrett joins, concurring. I agree. "
    "Justice Alito, concurring in part and dissenting in part. Mixed. Justice Gorsuch, dissenting. No."
)


def segments(spark, column, text):
    return [(s["label"], s["text"]) for s in spark.range(1).select(column(F.lit(text)).alias("s")).first()["s"]]


def test_opinion_sections(spark):
    found = segments(spark, segment.opinion_sections, OPINION_TEXT)
    assert [x for x, _ in found] == ["Preamble", "Syllabus", "Majority Opinion", "Concurring Opinion", "Concurring in Part, Dissenting in Part", "Dissenting Opinion"]
    assert found[3][1].startswith("Justice Kagan, with whom") and found[5][1] == "Justice Gorsuch, dissenting. No."
    assert [x for x, _ in segments(spark, lambda t: segment.opinion_sections(t, parity=True), OPINION_TEXT)][0] == "Syllabus"
    assert segments(spark, segment.opinion_sections, "nothing here") == [("Opinion", "nothing here")]


def test_opinion_parts(spark):
    text = "Justice Thomas delivered the opinion of the Court. Lead. I Under the law. II We hold so."
    assert [x for x, _ in segments(spark, segment.opinion_segments, text)] == ["Majority Opinion", "Majority Opinion - Part I", "Majority Opinion - Part II"]
    assert [x for x, _ in segments(spark, lambda t: segment.opinion_segments(t, parity=True), text)] == ["Majority Opinion - Part I", "Majority Opinion - Part II"]


def test_syllabus(spark):
    of = lambda t: spark.range(1).select(segment.syllabus_text(F.lit(t)).alias("s")).first()["s"]
    assert of("x Syllabus\nHeld: a.\nb Per Curiam. c") == "Held: a.\nb"
    assert of("Syllabus Held: a. Per Curiam. c") == "Held: a."
    assert of("none") is None


def test_order_segments(spark):
    assert [x for x, _ in segments(spark, segment.order_sections, ORDER_TEXT)] == ["Preamble", "Sec. 1 - Purpose", "Sec. 2 - Policy", "Sec. 3 - General"]
    found = segments(spark, segment.order_segments, ORDER_TEXT)
    assert [x for x, _ in found] == ["Preamble", "Sec. 1 - Purpose", "Sec. 2 - Policy", "Sec. 2 - Policy(a)", "Sec. 2 - Policy(b)", "Sec. 2 - Policy(b)", "Sec. 2 - Policy(b)", "Sec. 3 - General"]
    parity = segments(spark, lambda t: segment.order_segments(t, parity=True), ORDER_TEXT)
    assert ("Sec. 2 - Policy(b)", "(ii) one") in parity and "Lead text" not in " ".join(t for _, t in parity)
    assert segments(spark, segment.order_sections, "plain") == [("Executive Order", "plain")]


def plain_windows(text, lo, target, hi, overlap):
    """The source rules, step by step."""
    text = re.sub(r"\n\s*\n+", "\n\n", text.strip())
    n = lambda t: len(t) // 4
    if n(text) <= max(lo, target):
        return [text]
    out, s = [], 0
    while s < len(text):
        e = min(s + target * 4, len(text))
        if e < len(text):
            cut = max(text[s:e].rfind(m) for m in (". ", "? ", "! "))
            if cut > (e - s) * 0.8:
                e = s + cut + 2
        rest = text[e:].strip()
        if rest and 0 < n(rest) < lo and out:
            tail = text[s:].strip()
            out.append(tail)
            if n(tail) > hi * 1.2:
                out.append(rest)
            break
        out.append(text[s:e])
        s = max(s + max(1, target - overlap) * 4, e - overlap * 4) if overlap > 0 and e < len(text) else e
    return [chunk.normalized(t) for t in out]


def test_windows():
    rng = np.random.default_rng(0)
    for config in (chunk.OPINION, chunk.ORDER, chunk.ChunkConfig(20, 30, 40, 0.2), chunk.ChunkConfig(10, 12, 12, 0.0)):
        for _ in range(60):
            words = rng.choice(["alpha", "be. ", "gamma! ", "d", "\n\n", "epsilon"], rng.integers(0, 4000))
            text = " ".join(words)
            assert [t for t, *_ in chunk.windows(text, config, gap_free=False)] == plain_windows(text, config.min_tokens, config.target_tokens, config.max_tokens, config.overlap_tokens)
            found = list(chunk.windows(text, config))
            whole = chunk.normalized(text)
            covered = np.zeros(len(whole), dtype=bool)
            for t, n, a, b in found:
                covered[a:b] = True
                assert n <= config.max_tokens * 1.2 + 1
            assert all(c or whole[i].isspace() for i, c in enumerate(covered))
            assert all(b - a <= config.overlap_tokens * 4 or a == c for (_, _, c, b), (_, _, a, _) in zip(found, found[1:], strict=False))


def plain_merges(word, ranks):
    """Look at all pairs again after each merge."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_byte_pairs_by_looking_at_all_of_them():
    rng = random.Random(4)
    for _ in range(60):
        tokens = {bytes([c]): i for i, c in enumerate(b"abc")}
        for _ in range(25):
            x, y = rng.choice(list(tokens)), rng.choice(list(tokens))
            tokens.setdefault(x + y, rng.randrange(3, 40))
        for _ in range(20):
            word = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 40)))
            assert tokenizers.merged(word, tokens) == plain_merges(word, tokens)
    assert len(tokenizers.merged(b"ab" * 50_000, {b"ab": 0, b"abab": 1})) == 25_000


def test_counts_of_a_public_vocabulary(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files here")
    import tiktoken

    counter = tokenizers.RankCounter.of_file(path)
    own = tiktoken.Encoding("own", pat_str=tokenizers.WORDS, mergeable_ranks=tokenizers.read_ranks(path), special_tokens={})
    texts = ["The quick brown fox's 12 jumps\n\n  over", "é ü 漢字🙂  \t x", "", "a" * 300, None, "Zusammengehörigkeit schreiben wir so."] + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["n"] for r in rows.select("id", tokenizers.token_counts(spark, F.col("text"), counter).alias("n")).collect()}
    assert got == {i: len(own.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    text = "Section 1. Purpose. " + "The agency shall act upon it. " * 300
    docs = spark.createDataFrame([("d", text)], "document_id string, text string")
    rows = chunk.chunk_documents(docs, "order", count=counter).orderBy("chunk_index").collect()
    want = [w for _, t in segment_texts(spark, text) for w in chunk.windows(t, chunk.ORDER, count=lambda t: len(own.encode_ordinary(t)))]
    assert len(rows) > 3 and [(r["text"], r["token_count"]) for r in rows] == [w[:2] for w in want]


def segment_texts(spark, text):
    (row,) = spark.createDataFrame([(text,)], "t string").select(segment.order_segments(F.col("t"), False).alias("s")).collect()
    return [(s["label"], s["text"]) for s in row["s"]]


@pytest.mark.parametrize("bad", [(0, 1, 1, 0.1), (5, 4, 3, 0.1), (1, 2, 3, 1.0), (1, 2, 3, -0.1)])
def test_chunk_config(bad):
    with pytest.raises(ValueError):
        chunk.ChunkConfig(*bad)
    assert (chunk.OPINION.overlap_tokens, chunk.ORDER.overlap_tokens) == (90, 34)


def test_chunk_documents(spark):
    docs = spark.createDataFrame([("a", ORDER_TEXT, 1), ("b", None, 2), ("c", "", 3)], "document_id string, text string, extra int")
    rows = chunk.chunk_documents(docs, "order").orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in rows] == [f"a_chunk_{i}" for i in range(8)] and {r["extra"] for r in rows} == {1}


def test_filters(spark):
    df = spark.createDataFrame([(1, "x", ["p"], 5), (2, None, ["q"], None), (3, "y", None, 7)], "id int, k string, agencies array<string>, n int")
    ids = lambda c: [r["id"] for r in df.where(c).orderBy("id").collect()]
    assert ids(filters.equals({"k": "x"})) == [1]
    assert ids(filters.compile_filter({"must_not": [{"key": "k", "match": {"value": "x"}}]})) == [2, 3]
    assert ids(filters.compile_filter({"should": [{"key": "k", "match": {"value": "y"}}, {"key": "impacted_agencies", "match": {"any": ["q"]}}]})) == [2, 3]
    assert ids(filters.compile_filter({"must": [{"key": "n", "range": {"gt": 5, "lte": 7}}]})) == [3]
    assert ids(filters.between("n", None, 5)) == [1]


def test_search_is_exact_and_skips_zero_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(200, [0.0] * 8), (201, [1.0] * 7)]
    points = spark.createDataFrame(rows, "point_id bigint, embedding array<double>").repartition(5)
    queries = points.where("point_id < 7 OR point_id = 200").withColumnRenamed("point_id", "query_id")
    got = search.vector_search(queries, points, 10).orderBy("query_id", "rank").collect()
    m = np.array([v for _, v in rows[:200]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = [(q, int(p)) for q in range(7) for p in np.argsort(-(m[q] @ m.T), kind="stable")[:10]]
    assert [(r["query_id"], r["point_id"]) for r in got] == want
    with pytest.raises(ValueError):
        search.vector_search(queries, points, 51)


def test_hints(spark):
    rows = [(1, 1, 0.85, "d", "d_chunk_3"), (1, 2, 0.8, "d", "d_chunk_1"), (2, 1, 0.3, "e", None), *((3, i, 0.9, f"f{i}", None) for i in range(1, 5)), (4, 1, 0.9, None, None)]
    df = spark.createDataFrame(rows, "query_id bigint, rank int, score double, document_id string, chunk_id string").withColumns({"collection": F.lit("supreme_court_opinions"), "title": F.lit("T")})
    found = render.document_hints(df).collect()
    assert [r["query_id"] for r in found] == [1]
    assert found[0]["hint"].count("get_document_by_id") == 1 and 'document_id="d_chunk_3"' in found[0]["hint"] and "this case" in found[0]["hint"]


def test_embedding_failures(spark):
    def fn(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError
        return [[float(len(t)), 1.0] for t in texts]

    rows = embed.embed(spark.createDataFrame([(1, "abc"), (2, "bad"), (3, "x")], "i int, t string").coalesce(1), "t", 2, fn, batch=2).orderBy("i").collect()
    assert [(r["embedding"], r["embed_failed"]) for r in rows] == [([3.0, 1.0], False), ([0.0, 0.0], True), ([1.0, 1.0], False)]


def test_join_embeddings_needs_pairs(spark):
    a = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert store.join_embeddings(a, a.withColumn("embedding", F.lit(1))).count() == 2
    for left, right in ((a, a.limit(1)), (a.limit(1), a)):
        with pytest.raises(Exception, match="no pair for chunk"):
            store.join_embeddings(left, right.withColumn("embedding", F.lit(1))).collect()


def test_cluster_ids(spark):
    df = spark.createDataFrame([(1, ["https://x/opinions/123456/", "https://x/opinions/123457/"]), (2, [])], "id int, sub_opinions array<string>")
    assert [r["opinion_id"] for r in normalize.explode_opinions(df).collect()] == ["123456", "123457"]


def test_routing(spark):
    cases = [("Supreme Court Opinion", "x", "opinion"), ("x", "CourtListener", "opinion"), ("Executive Order", "Federal Register", "order"), ("executive", "high court", "opinion"), ("memo", "web", None), (None, None, None)]
    df = spark.createDataFrame(cases, "t string, s string, want string")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", normalize.route(F.col("t"), F.col("s"))).collect())


def test_readers(spark, tmp_path):
    (tmp_path / "orders.json").write_text('{"count": 2, "results": [{"document_number": "b", "signing_date": "2024-01-02", "president": {"name": "P"}}, {"document_number": "a", "signing_date": "2023-01-02"}]}')
    found = records.read_orders(spark, str(tmp_path / "orders.json"), "2024-01-01", "2024-12-31").collect()
    assert [(r["document_number"], r["president"]["name"]) for r in found] == [("b", "P")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.txt").write_text("<html><pre> a &lt;b </pre></html>")
    texts = records.read_raw_texts(spark, str(tmp_path / "t")).collect()
    assert texts[0]["raw_text"] == "a <b" and texts[0]["raw_text_url"].endswith("1.txt")
    (tmp_path / "o.json").write_text('{"id": 1, "html_with_citations": "<p>x</p>", "date_created": "2024-01-02T00:00:00-08:00"}\n')
    row = normalize.opinion_metadata(records.read_opinions(spark, str(tmp_path / "o.json"))).first()
    assert (row["content"], str(row["date"])) == ("x", "2024-01-02")
    with pytest.raises(ValueError):
        records.check_range("2024-02-01", "2024-01-01")


def test_tasks_are_bounded_by_bytes_whatever_the_row_groups(spark, tmp_path, monkeypatch):
    from lexspark.operators import spread

    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    monkeypatch.setattr(spread, "SPLIT", 50_000)
    dealt = spread.spread(spark.read.parquet(str(tmp_path / "t")).where("id >= 0").select("text"))
    assert dealt.rdd.getNumPartitions() >= size // 50_000 > 4
    assert spread.spread(dealt.select("text")).rdd.getNumPartitions() == dealt.rdd.getNumPartitions()
    assert dealt.count() == 20_000


def test_packed_texts_are_read_as_files_are(spark, tmp_path):
    """A text a file costs a folder and a task for each; packs hold many, whatever the texts hold."""
    texts = [(f"u{i}", f"<html><pre> {i} a &lt;b \r\n\u0001 é </pre></html>" if i % 2 else f"plain\n{i}\n") for i in range(500)]
    records.pack_raw_texts(spark.createDataFrame(texts, "raw_text_url string, value string").repartition(3), str(tmp_path / "packs"))
    assert len(list((tmp_path / "packs").glob("*.parquet"))) == 3
    found = {r["raw_text_url"]: r["raw_text"] for r in records.read_packed_texts(spark, str(tmp_path / "packs")).collect()}
    assert found == {f"u{i}": f"{i} a <b \r\n\u0001 é" if i % 2 else f"plain\n{i}\n" for i in range(500)}


def test_raw_texts_do_not_make_a_file_each(spark):
    from pathlib import Path

    from lexspark.plans import queries

    folder = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"))
    before = set(folder.glob("texts-*"))
    assert queries.QUERIES["a4_raw_texts"](spark, "/root/testdata/sf0.001").count() == 200
    (made,) = set(folder.glob("texts-*")) - before
    assert len(list(made.rglob("*.*"))) < 50


def test_collections_and_progress(spark):
    tables = store.Collections(spark)
    rows = spark.createDataFrame([("a", "d1", 1), ("b", "d1", 1), ("c", "d2", 1)], "point_id string, document_id string, ingest_seq int")
    tables.upsert("points", rows)
    for _ in range(2):  # a second time changes nothing
        tables.upsert("points", spark.createDataFrame([("a", "d1", 2), ("a", "d1", 3)], rows.schema), replace_document="document_id")
    assert sorted((r["point_id"], r["ingest_seq"]) for r in tables.read("points").collect()) == [("a", 3), ("c", 1)]
    tables.delete_points("points", rows.where("point_id = 'c'"))
    assert tables.read("points").count() == 1 and "points" in tables.names()
    tables.write("states", spark.createDataFrame([("d1", "order", "processing"), ("d2", "opinion", "failed")], "document_id string, document_type string, status string"))
    assert [r["status"] for r in progress.reset_interrupted(tables.read("states")).orderBy("document_id").collect()] == ["pending", "failed"]
    tables.drop("points", "order", "states")
    assert not tables.exists("points") and [r["document_id"] for r in tables.read("states").collect()] == ["d2"]


def states_of(log):
    return {r["document_id"]: (r["status"], r["error_message"]) for r in progress.current(log).collect()}


def delivering(spark, source, schema=ingest.DOCUMENTS):
    return lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)


def test_stream_resumes_and_replays(spark, tmp_path):
    source = str(tmp_path / "in")
    deliver = delivering(spark, source)
    begin = lambda cp: ingest.Ingestion(spark, source, str(tmp_path / cp), "s_points", "s_log", work=ingest.Work(dim=8))
    deliver([("d1", ORDER_TEXT), ("d2", ""), ("d3", "short")])
    stream = begin("cp")
    stream.run()
    first = sorted(r["point_id"] for r in spark.table("s_points").collect())
    assert states_of(stream.states()) == {"d1": ("completed", None), "d2": ("failed", "no content"), "d3": ("completed", None)}
    deliver([("d1", ORDER_TEXT), ("d4", "new")])
    begin("cp").run()
    assert len(spark.table("s_points").collect()) == len(first) + 1
    log = [(r["status"], r["seq"]) for r in stream.states().where("document_id = 'd1'").orderBy("seq").collect()]
    assert log == [("pending", 0), ("processing", 1), ("completed", 2)]
    begin("other").run()  # everything again, with another state: completed documents are left out, as the log tells
    assert sorted(r["point_id"] for r in spark.table("s_points").where("document_id != 'd4'").collect()) == first
    assert states_of(stream.states())["d1"] == ("completed", None) and stream.states().where("document_id = 'd2'").count() == 6
    runs = spark.table("s_log_runs").orderBy("started_at").collect()
    assert [(r["total_documents"], r["completed_documents"], r["failed_documents"]) for r in runs] == [(3, 2, 1), (4, 3, 1), (4, 3, 1)]


def test_one_sequence_for_stream_and_retries(spark, tmp_path):
    """A document fails, is tried twice more, and is delivered with a text at last: it is completed and waits no longer."""
    source = str(tmp_path / "in")
    deliver = delivering(spark, source)
    stream = ingest.Ingestion(spark, source, str(tmp_path / "cp"), "q_points", "q_log", work=ingest.Work(dim=8))
    deliver([("a", ""), ("b", "text of b")])
    stream.run()
    assert stream.retry() == 1 and stream.retry() == 1
    assert states_of(stream.states()) == {"a": ("failed", "no content"), "b": ("completed", None)}
    deliver([("a", "text of a")])
    stream.run()
    assert states_of(stream.states())["a"] == ("completed", None) and stream.retry() == 0
    seqs = [r["seq"] for r in stream.states().where("document_id = 'a'").orderBy("seq").collect()]
    assert seqs == list(range(12))
    assert {r["document_id"] for r in spark.table("q_points").collect()} == {"a", "b"}


def test_the_latest_version_counts(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "document_id string, text string, edition int"
    delivering(spark, source, schema)([("a", "zzz old", 1), ("a", "aaa new", 2), ("a", "mmm", None)])
    stream = ingest.Ingestion(spark, source, str(tmp_path / "cp"), "v_points", "v_log", ingest.Documents(schema), ingest.Work(dim=8))  # the time of the file: one row of it counts, and only one
    stream.run()
    assert spark.table("v_points").count() == 1
    source = str(tmp_path / "timed")
    schema = "document_id string, text string, changed timestamp"
    delivering(spark, source, schema)([("a", "zzz old", datetime(2020, 1, 1)), ("a", "aaa new", datetime(2021, 1, 1)), ("a", "mmm", None)])
    ingest.Ingestion(spark, source, str(tmp_path / "cp2"), "v2_points", "v2_log", ingest.Documents(schema, version="changed"), ingest.Work(dim=8)).run()
    assert [r["text"] for r in spark.table("v2_points").collect()] == ["aaa new"]


def test_a_failing_document_is_retried(spark, tmp_path):
    source, broken = str(tmp_path / "in"), str(tmp_path / "broken")
    delivering(spark, source)([("d1", ORDER_TEXT), ("d2", "boom " + ORDER_TEXT)])
    open(broken, "w").close()

    def count(text):
        if text.startswith("boom") and os.path.exists(broken):
            raise RuntimeError("bad document")
        return len(text) // 4

    stream = ingest.Ingestion(spark, source, str(tmp_path / "cp"), "r_points", "r_log", work=ingest.Work(dim=8, count=count))
    stream.run()
    assert states_of(stream.states()) == {"d1": ("completed", None), "d2": ("failed", "RuntimeError: bad document")}
    assert {r["document_id"] for r in spark.table("r_points").collect()} == {"d1"}
    os.remove(broken)
    assert stream.retry() == 1
    assert states_of(stream.states())["d2"] == ("completed", None) and {r["document_id"] for r in spark.table("r_points").collect()} == {"d1", "d2"}
    assert stream.retry() == 0


def test_flagged_documents_are_taken_again(spark, tmp_path):
    """A document whose vectors or fields could not be made is completed with a flag, and is taken again."""
    source, broken = str(tmp_path / "in"), str(tmp_path / "broken")
    delivering(spark, source)([("d1", ORDER_TEXT)])
    open(broken, "w").close()

    def fn(texts):
        if os.path.exists(broken):
            raise RuntimeError
        return [[1.0, 0.0]] * len(texts)

    def extractor(texts):
        if os.path.exists(broken):
            raise RuntimeError
        return ["{}"] * len(texts)

    for name, of, work in (("f", ingest.Documents(), ingest.Work(dim=2, fn=fn)), ("x", ingest.Documents(extract=True), ingest.Work(dim=2, extractor=extractor))):
        open(broken, "w").close()
        stream = ingest.Ingestion(spark, source, str(tmp_path / name), f"{name}_points", f"{name}_log", of, work)
        stream.run()
        assert [tuple(r) for r in progress.current(stream.states()).select("status", "requires_reprocessing").collect()] == [("completed", True)]
        os.remove(broken)
        assert stream.retry() == 1 and stream.retry() == 0
        assert [tuple(r) for r in progress.current(stream.states()).select("status", "requires_reprocessing").collect()] == [("completed", False)]


def test_work_without_an_outcome_is_pending_after_its_time(spark, tmp_path):
    """The outcomes of a pass are lost; a later delivery moves the time on, and the timer sets the document back."""
    source = str(tmp_path / "in")
    deliver = delivering(spark, source)
    stream = ingest.Ingestion(spark, source, str(tmp_path / "cp"), "t_points", "t_log", work=ingest.Work(dim=8), timeout=0.001, skew="0 seconds")
    deliver([("a", "text of a")])
    lost = ingest.Ingestion(spark, source, str(tmp_path / "cp"), "t_points", "t_log", work=ingest.Work(dim=8), timeout=0.001, skew="0 seconds")
    lost._work = lambda todo, number: None
    lost.run()
    deliver([("b", "text of b")])
    stream.run()
    assert states_of(stream.states()) == {"a": ("pending", None), "b": ("completed", None)}
    assert stream.retry() == 1 and states_of(stream.states()) == {"a": ("completed", None), "b": ("completed", None)}
    assert [r["status"] for r in stream.states().where("document_id = 'a'").orderBy("seq").collect()] == ["pending", "processing", "pending", "pending", "processing", "completed"]


def test_a_batch_that_is_cut_off_runs_again(spark, tmp_path):
    source = str(tmp_path / "in")
    delivering(spark, source)([("a", "text of a"), ("b", "")])
    begin = lambda: ingest.Ingestion(spark, source, str(tmp_path / "cp"), "c_points", "c_log", work=ingest.Work(dim=8))
    stream = begin()
    whole = stream._work

    def cut_off(todo, number):
        whole(todo, number)
        raise RuntimeError("killed")

    stream._work = cut_off
    with pytest.raises(Exception, match="killed"):
        stream.run()
    begin().run()
    assert states_of(stream.states()) == {"a": ("completed", None), "b": ("failed", "no content")}
    assert stream.states().count() == 6 and spark.table("c_points").count() == 1


def test_upsert_touches_its_buckets_and_recovers(spark, monkeypatch):
    tables = store.Collections(spark, bucket_bytes=400)
    rows = lambda ids, seq: spark.createDataFrame([(f"p{i}", f"d{i}", seq) for i in ids], "point_id string, document_id string, ingest_seq int")
    assert tables.upsert("parts_points", rows(range(200), 1)) == (200, 0)
    n = tables.buckets("parts_points")
    assert n == 8 or n > 8 and n == -(-sum(len(f"p{i}d{i}") + 8 for i in range(200)) // 400)
    files = lambda: {r["f"] for r in spark.table("default.parts_points").select(F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    assert tables.upsert("parts_points", rows([3], 2), replace_document="document_id") == (1, 0)
    assert len(before - files()) == 1
    assert tables.read("parts_points").where("ingest_seq = 2").count() == 1 and tables.read("parts_points").count() == 200

    def cut_off(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store.Collections, "_put", cut_off)
        with pytest.raises(RuntimeError):
            tables.upsert("parts_points", rows([4, 900], 3))
    assert tables.read("parts_points").where("ingest_seq = 3").count() == 0  # a reader leaves it alone; the next change puts it in place
    store.Collections(spark).recover("parts_points")
    assert sorted(r["point_id"] for r in tables.read("parts_points").where("ingest_seq = 3").collect()) == ["p4", "p900"]
    assert tables.read("parts_points").count() == 201 and tables.names().count("parts_points") == 1


def test_upsert_exchanges_the_batch_alone(spark):
    tables = store.Collections(spark)
    make = lambda n, seq: spark.range(n).select(F.concat(F.lit("p"), "id").alias("point_id"), F.concat(F.lit("d"), F.expr("id div 3")).alias("document_id"), F.lit(seq).alias("ingest_seq"), F.lit("x" * 50).alias("text"))
    tables.upsert("wide_points", make(3000, 1))
    new = make(90, 2).persist()
    new.count()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with store._settings(spark):
            plan = tables.merged("wide_points", new, "point_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    old = plan[plan.index("SortMergeJoin") : plan.index("Scan parquet spark_catalog.default.wide_points")]
    assert "Exchange" not in old.split("Sort [")[1] and "Bucketed: true" in plan
    assert tables.upsert("wide_points", new) == (90, 0)
    assert tables.read("wide_points").groupBy("ingest_seq").count().orderBy("ingest_seq").collect() == [(1, 2910), (2, 90)]


def test_counts_growth_and_deletion_of_collections(spark):
    tables = store.Collections(spark, bucket_bytes=2000)
    schema = "point_id string, document_id string, ingest_seq int, embedding array<float>"
    rows = [("a", "d1", 1, [1.0]), ("b", "d1", 1, None), (None, "d2", 1, [1.0]), ("a", "d1", 2, [2.0])]
    assert tables.upsert("few", spark.createDataFrame(rows, schema), valid=F.size("embedding") == 1) == (2, 2)
    assert [tuple(r) for r in tables.read("few").collect()] == [("a", "d1", 2, [2.0])]
    grown = spark.range(4000).select(F.col("id").cast("string").alias("point_id"), F.md5(F.col("id").cast("string")).alias("document_id"), F.lit(3).alias("ingest_seq"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"))
    assert tables.upsert("few", grown) == (4000, 0)
    assert tables.buckets("few") > 8 and tables.read("few").count() == 4001
    ids = grown.where("point_id < '2'").select("point_id", "document_id")
    gone = ids.count()
    for _ in range(2):
        tables.delete_points("few", ids)
        assert tables.read("few").count() == 4001 - gone
    tables.delete_points("few", spark.createDataFrame([("a", "d1")], "point_id string, document_id string"))
    tables.delete_points("few", grown.select("point_id"))
    assert tables.read("few").count() == 0


def test_extraction_hook(spark):
    def fn(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return ['{"document_summary": "S", "federal_statutes_cited": ["1 U.S.C. § 1"], "topics_or_policy_areas": ["x"]}' for _ in texts]

    docs = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id int, text string")
    rows = {r["id"]: r for r in embed.extract_fields(docs, kind="order", fn=fn).collect()}
    assert rows[1]["document_summary"] == "S" and rows[1]["total_citations"] == 1 and not rows[1]["llm_extraction_failed"]
    assert rows[1]["topics_or_policy_areas"] == ["x", "federal policy", "executive action", "government regulation"]
    assert rows[2]["document_summary"] == "Unable to generate summary." and rows[2]["requires_reprocessing"]
    assert rows[2]["topics_or_policy_areas"] == ["executive order", "federal policy", "presidential action"]
    assert [r["id"] for r in embed.to_reprocess(embed.extract_fields(docs, kind="order", fn=fn)).orderBy("id").collect()] == [2, 3]


def test_search_in_blocks_with_string_ids(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"p{i:03d}", rng.integers(0, 3, 6).astype(float).tolist(), i % 2) for i in range(150)] + [("none", None, 0)]
    points = spark.createDataFrame(rows, "point_id string, embedding array<double>, label int").repartition(3)
    queries = points.where("point_id < 'p040'").withColumnRenamed("point_id", "query_id")
    of = lambda: sorted(map(tuple, search.vector_search(queries, points, 7, F.col("label") == 0, 0.3).collect()))
    whole = of()
    monkeypatch.setattr(search, "QUERY_BLOCK", 9)
    monkeypatch.setattr(search, "POINT_BLOCK", 13)
    assert of() == whole and len(whole) > 200
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    assert of() == whole


def test_detailed_results(spark):
    lit = F.lit
    lists = F.array(lit("a"), lit("b"), lit("c"), lit("d"))
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    shown = one(render.opinion_result(lit(1), lit("A v. B"), lit("dissent"), lit("Kagan"), lit("T"), lit(0.5), lit("1 U.S. 2"), lit("II"), {"legal_topics": lists, "vote_breakdown": lit("5-4"), "holding": lit("h" * 300)}))
    assert shown == "### 1. A v. B\n*1 U.S. 2*\n**Dissent Opinion** by Justice Kagan (Section II)\n\n**Excerpt:**\nT\n\n**Legal Context:**\n- **Legal Topics:** a, b, c, d\n- **Vote:** 5-4\n- **Key Holding:** " + "h" * 200 + "...\n\n*Relevance Score: 0.500*"
    shown = one(render.order_result(lit(2), lit("T"), lit(None).cast("string"), lit("P"), lit(None).cast("long"), lit("x"), lit(0.25), None, lit("preamble"), {"legal_authorities": lists, "summary": lit("s")}))
    assert shown == "### 2. T\n**President P**\n\n**Document Part: Preamble**\n\n**Excerpt:**\nx\n\n**Policy Context:**\n- **Summary:** s...\n- **Legal Authorities:** a, b, c\n\n*Relevance Score: 0.250*"
    assert one(render.generic_result(lit(3), lit("x"), lit(1.0), id=lit(7), title=lit(None).cast("string"))) == "### 3. Document Chunk\n**Id:** 7\n\n**Content:**\nx\n\n*Relevance Score: 1.000*"


def test_pages_of_collections_and_hints(spark):
    results = spark.createDataFrame([(1, 1, "L1"), (1, 2, "L2")], "query_id bigint, rank int, line string")
    queries = spark.createDataFrame([(1, "q"), (2, "z")], "query_id bigint, query string")
    hints = spark.createDataFrame([(1, "HINT")], "query_id bigint, hint string")
    pages = {r["query_id"]: r["page"] for r in render.result_page(results, queries, "executive_orders", hints).collect()}
    assert pages == {1: '## Executive Order Search Results\n\nQuery: "q"\nFound 2 relevant order chunks.\n\nL1\n\nL2\n\nHINT', 2: "No Executive Orders found for query: 'z'"}


def test_each_query_meets_points_of_its_own_dimension(spark):
    """In one batch most points have another length than a query; each query is answered from those that fit."""
    points = [(i, [1.0, float(i)]) for i in range(6)] + [(10 + i, [1.0, float(i), 2.0]) for i in range(4)] + [(20, None), (21, []), (22, [0.0, 0.0, 0.0])]
    points = spark.createDataFrame(points, "point_id bigint, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, None)], "query_id bigint, embedding array<double>")
    found = lambda: {(r["query_id"], r["rank"]): r["point_id"] for r in search.vector_search(queries, points, 10).collect()}
    want = {(1, 1 + i): 10 + i for i in range(4)} | {(2, 1 + i): i for i in range(6)}
    assert found() == want
    many = queries.crossJoin(spark.range(600)).select((F.col("query_id") * 1000 + F.col("id")).alias("query_id"), "embedding")
    blocks = {(r["query_id"], r["rank"]): r["point_id"] for r in search.vector_search(many, points, 10).collect()}
    assert blocks == {(q * 1000 + i, rank): p for (q, rank), p in want.items() for i in range(600)}


def test_titles_of_types_and_empty_texts(spark):
    rows = [("concurrence_dissent", "x"), ("LEAD-opinion 2a", ""), ("o'neil élan", None)]
    df = spark.createDataFrame(rows, "kind string, text string")
    lines = [r["line"] for r in df.select(render.opinion_result(F.lit(1), F.lit("C"), F.col("kind"), F.lit(""), F.col("text"), F.lit(0.5)).alias("line")).collect()]
    assert [x.split("**")[1] for x in lines] == [f"{kind.title()} Opinion" for kind, _ in rows]
    assert ["No text available" in x for x in lines] == [False, True, True]
