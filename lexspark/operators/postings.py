"""Keyword and phrase search by positional postings, and topics from text, in DataFrame operations alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spread import tasks_of

#: What is no part of a word.
GAP = r"[^\p{L}\p{N}]+"
#: Words of a topic, its letters at least, documents that must hold it, and topics of a document.
PHRASE, LETTERS, HOLDERS, TOPICS = 2, 4, 2, 8
#: Words whose holders are sent to every task, and bytes of input whose phrases a task counts in memory.
COMMON, DEALT = 50_000, 8 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def postings(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """term, key, places: where each word stands in each document, ascending from 0."""
    found = docs.select(key, F.posexplode(words(F.col(text))).alias("place", "term"))
    return found.groupBy("term", key).agg(F.array_sort(F.collect_list("place")).alias("places"))


def save_postings(rows: DataFrame, table: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by term: a search reads the buckets of its terms, and there the row groups that hold them."""
    rows.write.bucketBy(buckets, "term").sortBy("term").saveAsTable(table)


def clauses(query: str) -> list[list[str]]:
    """The words of each clause; quoted words are one."""
    cut = lambda s: [w for w in re.split(r"[^\w]+|_", s.lower()) if w]
    return [c for c in (cut(a or b) for a, b in re.findall(r'"([^"]+)"|(\S+)', query)) if c]


def search_postings(spark: SparkSession, rows: DataFrame, query: str, documents: int, key: str = "document_id", limit: int | None = None) -> DataFrame:
    """key and score of the documents that hold every clause, best first.

    A clause's words must stand one after another: each place less the word's place in the clause is where the clause would start, and a
    start at which all its words agree is a hit. A clause weighs ln((2 * documents + 2) / (2 * holders + 1)), and hits saturate.
    """
    asked = clauses(query)
    if not asked:
        return rows.select(key).distinct().withColumn("score", F.lit(0.0))
    wanted = spark.createDataFrame([(c, i, w, len(ws)) for c, ws in enumerate(asked) for i, w in enumerate(ws)], "clause int, at int, word string, size int")
    terms = sorted({w for ws in asked for w in ws})
    found = rows.where(F.col("term").isin(terms)).join(F.broadcast(wanted), F.col("term") == F.col("word"))
    starts = found.select("clause", "size", key, "at", F.explode(F.transform("places", lambda p: p - F.col("at"))).alias("start"))
    hits = starts.groupBy("clause", "size", key, "start").agg(F.count("*").alias("n")).where("n = size").groupBy("clause", key).agg(F.count("*").alias("hits"))
    holders = hits.groupBy("clause").agg(F.count("*").alias("holders"))
    weight = F.round(F.log((F.lit(2.0) * documents + 2) / (F.lit(2.0) * F.col("holders") + 1)), 6)
    scored = hits.join(F.broadcast(holders), "clause").withColumn("part", weight * F.col("hits") / (F.col("hits") + 1))
    whole = scored.groupBy(key).agg(F.count("*").alias("held"), F.round(F.sum("part"), 6).alias("score")).where(F.col("held") == len(asked)).select(key, "score")
    return whole.orderBy(F.desc("score"), key).limit(limit) if limit is not None else whole


def topics_of(docs: DataFrame, key: str = "document_id", text: str = "text", phrase: int = PHRASE, letters: int = LETTERS, holders: int = HOLDERS, most: int = TOPICS) -> DataFrame:
    """key and topics: the phrases of one to `phrase` long words that tell a document from the others, by frequency and rarity over all documents.

    Every document is there; one without such phrases has an empty list. Texts are dealt out by key, so that a document's phrases are counted
    where its text is, once. Phrases then meet those of other documents, by which their holders are counted. The weights of the COMMON most common words
    are known where they are counted, so these meet nobody, and go no further if they cannot be among the document's best: a phrase weighs
    at most what `holders` holders would make of it, and the least of the best `most` known weights is a bound. It also says which of the others go on.
    """
    dealt = docs.select(key, text).repartition(tasks_of(docs, DEALT), key)
    long = F.filter(words(F.col(text)), lambda w: F.char_length(w) >= letters)
    rows = dealt.select(key, long.alias("w"))
    grams = [F.col("w")]
    for n in range(2, phrase + 1):  # each phrase of n - 1 words with the word after it
        most_of = F.greatest(F.size("w") - (n - 1), F.lit(0))
        grams.append(F.zip_with(F.slice(grams[-1], F.lit(1), most_of), F.slice("w", F.lit(n), most_of), lambda a, b: F.concat(a, F.lit(" "), b)))
    # Outer, as Spark would cut texts into words before they are dealt too, to leave out those without.
    counted = lambda found: rows.select(key, F.explode_outer(found).alias("topic")).where("topic IS NOT NULL").groupBy(key, "topic").agg(F.count("*").alias("n"))
    common = counted(grams[0]).groupBy("topic").agg(F.count("*").alias("held")).where(F.col("held") >= holders)
    common = common.orderBy(F.desc("held"), "topic").limit(COMMON).select(F.col("topic").alias("word"), "held")
    total = docs.agg(F.count("*").alias("documents"))
    weight = lambda held: F.round(F.col("n") * F.log((F.lit(2.0) * F.col("documents") + 2) / (F.lit(2.0) * held + 1)), 6)
    bounded = counted(F.concat(*grams)).join(F.broadcast(common), F.col("topic") == F.col("word"), "left").crossJoin(F.broadcast(total))  # COMMON rows, and one row
    bounded = bounded.select(key, "topic", "n", "documents", "held", weight(F.col("held")).alias("sure"), weight(F.coalesce("held", F.lit(holders))).alias("at_most"))
    every = Window.partitionBy(key).orderBy(F.desc_nulls_last("sure")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    likely = F.col("least").isNull() | (F.col("at_most") >= F.col("least"))
    dealt_on = bounded.withColumn("least", F.nth_value("sure", most, True).over(every)).select(key, "topic", "n", "documents", "held", likely.alias("likely")).where("likely OR held IS NULL")
    alike = Window.partitionBy("topic", F.when(F.col("held").isNotNull(), F.col(key)))  # a common word's holders are known, and need not meet
    scored = dealt_on.withColumn("holders", F.coalesce("held", F.count("*").over(alike))).where(F.col("likely") & (F.col("holders") >= holders))
    order = Window.partitionBy(key).orderBy(F.desc("weight"), "topic")
    best = scored.select(key, "topic", weight(F.col("holders")).alias("weight")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    lists = best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda x: x["topic"]).alias("topics"))
    return docs.select(key).join(lists, key, "left").select(key, F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))
