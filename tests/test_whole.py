"""What is registered takes the whole of its input."""

from pyspark.sql import functions as F

from lexspark.operators import chunk
from lexspark.plans import queries
from lexspark.plans.corpora import corpus


def _documents(spark, tmp_path, n):
    """n documents of 9000 characters whose words are all different; some parts of an opinion are missing by doc_id."""
    text = lambda i: " ".join(f"w{i:03d}x{k:04d}." for k in range(818))[:9000]
    rows = [(i, text(i), "en", "s", 9000) for i in range(n)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    return {str(r[0]): set(r[1].split()) for r in rows}


def test_orders_and_opinions_are_whole(spark, tmp_path):
    words = _documents(spark, tmp_path, 80)
    docs = corpus(spark, str(tmp_path))
    for kind, text in (("order", "order_text"), ("opinion", "court_text")):
        found = chunk.chunk_documents(docs.select("document_id", F.col(text).alias("text")), kind)
        texts = {r["document_id"]: " ".join(r["texts"]) for r in found.groupBy("document_id").agg(F.collect_list("text").alias("texts")).collect()}
        # A cut between two parts may go through a word.
        missing = {d: sum(w not in texts[d] for w in own) for d, own in words.items()}
        assert max(missing.values()) <= 6, (kind, missing)


def test_structure_varies(spark, tmp_path):
    _documents(spark, tmp_path, 80)
    for name, least in (("j4_order_sections", 4), ("j5_order_segments", 6), ("j1_j7_opinion_sections", 4), ("j2_opinion_parts", 5)):
        rows = queries.QUERIES[name](spark, str(tmp_path)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "label")))["label"].alias("labels"))
        assert rows.select("labels").distinct().count() >= least, name
