"""The corpus pipeline: language, near duplicates, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.

Edge cases, the same for every stage: an empty table gives an empty table; columns beyond those of documents pass through
whatever their names (the last stage replaces shard and slot); equal rows have equal fates, but for the mix, which decides on
each; a very long text is read whole. What run writes between stages lies in the shared checkpoint folder, beside Spark's own
checkpoints, as the result is computed from it when it is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import common, decontamination, language, mixing, near_duplicates, sharding

Docs = DataFrame


def identify(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Documents whose language is identified; without letters, unsure or like no language, they go. Null text goes, null lang stays."""
    return language.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """One document of each group of near duplicates, that of the smallest doc_id; rows without words stay, as does a null doc_id that copies no named one."""
    return near_duplicates.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Documents that benchmark passages do not contaminate; null text stays, and an empty benchmark takes nothing."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Each document as often as the mix takes it; a null source is one, a text without words is taken as its place in the queue has it."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Every row, nulls and repeats included, with its shard and its slot there."""
    return sharding.shard_records(docs)


STAGES = [
    ("language", identify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Language identification and the shuffle are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared checkpoint folder."""
    docs = common.documents(spark, sf_dir)
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
