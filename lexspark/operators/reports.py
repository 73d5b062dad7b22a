"""Statistics over whole collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Values that are not null with count and percent of all such rows, most common first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100).orderBy(F.desc("n"), column)


def most_common(df: DataFrame, column: str, n: int, array: bool = False) -> DataFrame:
    """The n most common values; of an array column, by mention."""
    values = df.select(F.explode(column).alias(column) if array else column).where(F.col(column).isNotNull())
    return values.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def date_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("earliest"), F.max(column).alias("latest"))


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(F.col(column)).alias("n_distinct"))


def collection_info(collections: dict[str, DataFrame], vector: str = "embedding") -> DataFrame:
    """A row for each collection: rows, vectors and their dimension."""
    rows = [df.agg(F.lit(name).alias("collection"), F.count("*").alias("n_rows"), F.count(vector).alias("n_vectors"), F.max(F.size(vector)).alias("dim")) for name, df in collections.items()]
    return reduce(DataFrame.unionByName, rows)


def section_breakdown(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("section_label").agg(F.count("*").alias("n_chunks"), F.count_distinct("document_id").alias("n_documents"), F.avg("token_count").alias("avg_tokens"))


def sample_points(chunks: DataFrame, n: int, key: str = "point_id") -> DataFrame:
    return chunks.orderBy(key).limit(n)
