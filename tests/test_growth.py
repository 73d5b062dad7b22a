"""What must not grow faster than the input: files of a collection, exchanges, work that is done once."""

from pyspark.sql import functions as F

from lexspark.operators import store
from lexspark.plans import queries


def test_a_bucket_has_one_file_however_many_tasks_a_batch_has(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tables = store.Collections(spark)
        rows = lambda seq: spark.range(0, 4000, 1, 40).select(F.concat(F.lit("p"), "id").alias("point_id"), F.concat(F.lit("d"), F.expr("id div 3")).alias("document_id"), F.lit(seq).alias("ingest_seq"))
        files = lambda: spark.table("default.filed").select(F.input_file_name()).distinct().count()
        assert tables.upsert("filed", rows(1)) == (4000, 0) and files() == tables.buckets("filed") == 8
        assert tables.upsert("filed", rows(2), replace_document="document_id") == (4000, 0)
        assert files() <= 16 and tables.read("filed").groupBy("ingest_seq").count().collect() == [(2, 4000)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_the_collection_stays_where_it_is_though_it_has_few_buckets(spark):
    """Spark joins by its shuffle partitions if these are more than the buckets, and then exchanges both sides."""
    tables = store.Collections(spark)
    make = lambda n, seq: spark.range(n).select(F.concat(F.lit("p"), "id").alias("point_id"), F.concat(F.lit("d"), F.expr("id div 3")).alias("document_id"), F.lit(seq).alias("ingest_seq"))
    tables.upsert("lying", make(3000, 1))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        with store._settings(spark):
            plan = tables.merged("lying", make(2000, 2), "point_id", "document_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    old = plan[plan.index("SortMergeJoin") : plan.index("Scan parquet spark_catalog.default.lying")]
    assert "Exchange" not in old.split("Sort [")[1] and "Bucketed: true" in plan


def test_a_replay_computes_its_chunks_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"text {i}"

    rows = spark.range(60).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.expr("id div 4").cast("string").alias("document_id"), text("id").alias("text"), F.col("id").alias("chunk_index"))
    monkeypatch.setattr(queries, "order_chunks", lambda *_: rows)
    assert queries.l4_replay(spark, "").count() == 60 and made.value == 60
