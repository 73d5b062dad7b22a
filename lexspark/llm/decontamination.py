"""Benchmark decontamination in DataFrame operations alone.

Benchmark texts and documents are normalised alike into words. The windows of the benchmark (13 words,
or a whole shorter item) make a set keyed by the hash of their words' hashes. One scan of every document
turns its word hashes into window hashes of all lengths that the benchmark has, by doubling: a hash of 2k words is that of two
hashes of k words. They look each window up in that set; what hits is verified word by word. The set is broadcast if its rows
and bytes are under a limit; else window hashes alone are shuffled, and the words of what hits are read again.
Equal windows of several items are one window with their ids, so a hit is one row whatever the number of items.

Edge cases: a null or wordless document has no words and is not contaminated; a null or wordless item
has no window; an empty benchmark contaminates nothing; equal items each count; documents are told apart by doc_id and text, so
equal rows get equal results and rows that share a doc_id do not mix; a very long document is scanned whole, as one row of
words; extra columns, whatever their names, are ignored, or pass through drop_contaminated; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, SHARE = 13, 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is not part of a word, once lower-cased, and words as they stand with what follows them.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PIECE = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"
LEAD = "^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"
#: Words of the longest array that a function may return.
ALL = 2_000_000_000


def word_array(text: str) -> Column:
    """Lower-cased words; A-Z alone change case."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), GAPS), "")


def _window_hashes(df: DataFrame, lengths: list[int], words: str = "words") -> DataFrame:
    """df with the array h{m} of the hashes of all windows of m words, for each length.

    A step keeps as many cells as its shorter side has, so the last of them may be of windows that do not fit: zip_with
    gives null there, and h{m} is cut to the windows that do.
    """
    df = df.withColumn("h1", F.transform(words, lambda w: F.xxhash64(w)))
    made = {1}

    def shifted(a: str, by: int) -> Column:
        return F.slice(F.col(a), by + 1, ALL)

    def join(n: int, a: int, b: int) -> None:
        nonlocal df
        if n not in made:
            both = F.zip_with(f"h{a}", shifted(f"h{b}", a), lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y)))
            df = df.withColumn(f"h{n}", both)
            made.add(n)

    for m in lengths:
        done = 0
        for bit in range(m.bit_length() - 1, -1, -1):
            size = 1 << bit
            if m & size:
                k = 1
                while k < size:
                    join(2 * k, k, k)
                    k *= 2
                if done:
                    join(done + size, done, size)
                done += size
    return df.drop(*(f"h{n}" for n in made if n not in lengths))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """m, wanted (words), key and items (ids) of each distinct window."""
    items = benchmark.select("item_id", word_array("text").alias("words"))
    items = items.withColumn("m", F.least(F.size("words"), F.lit(window))).where("m > 0")
    starts = F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)
    rows = items.select("item_id", "m", "words", F.explode(starts).alias("i")).select("item_id", "m", F.slice("words", F.col("i"), F.col("m")).alias("wanted"))
    distinct = common.durable(rows.groupBy("m", "wanted").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    lengths = _lengths(distinct)
    hashed = _window_hashes(distinct, lengths, "wanted")
    key = F.coalesce(*(F.when(F.col("m") == m, F.col(f"h{m}")[0]) for m in lengths)) if lengths else F.lit(0).cast("bigint")
    return common.durable(hashed.select("m", "wanted", key.alias("key"), "items"))


def _lengths(windows: DataFrame) -> list[int]:
    """At most as many as a window has words."""
    return sorted(r["m"] for r in windows.select("m").distinct().collect())


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, key, at, m, items: each verified occurrence of a benchmark window in a document (doc_id and text_key)."""
    wanted = benchmark_windows(benchmark, window)
    texts = docs.select(F.col("doc_id").alias("id"), common.text_key().alias("key"), word_array("text").alias("words"))
    lengths = _lengths(wanted)
    if not lengths:
        return texts.select("id", "key", F.lit(0).alias("at"), F.lit(0).alias("m"), F.array().cast("array<bigint>").alias("items")).limit(0)
    by_length = F.array(*(F.struct(F.lit(m).alias("m"), F.slice(f"h{m}", 1, F.greatest(F.size("words") - m + 1, F.lit(0))).alias("h")) for m in lengths))
    rows = _window_hashes(texts, lengths).select("id", "key", "words", F.explode(by_length).alias("w"))
    rows = rows.select("id", "key", "words", F.col("w.m").alias("m"), F.posexplode("w.h").alias("at", "h"))
    keys = common.durable(wanted.select(F.col("key").alias("wanted_key")).distinct())
    match = F.col("h") == F.col("wanted_key")
    seen = F.slice("words", F.col("at") + 1, F.col("m")).alias("seen")
    if common.fits(keys):
        found = rows.join(F.broadcast(keys), match, "left_semi").select("id", "key", "at", "m", "h", seen)
    else:  # only hashes are shuffled; the words of hits are read again
        places = common.durable(rows.drop("words").join(keys, match, "left_semi").groupBy("id", "key").agg(F.collect_set(F.struct("at", "m", "h")).alias("hits")))
        places = common.small(places.select(F.col("id").alias("hit_id"), F.col("key").alias("hit_key"), "hits"))
        again = texts.join(places, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")))
        found = again.select("id", "key", "words", F.explode("hits").alias("x")).select("id", "key", "words", "x.*").select("id", "key", "at", "m", "h", seen)
    known = common.small(wanted.select(F.col("key").alias("wanted_key"), "wanted", "items"))
    return common.durable(found).join(known, match & (F.col("seen") == F.col("wanted"))).select("id", "key", "at", "m", "items")


def _covered(spans: Column) -> Column:
    """Number of positions in the union of sorted spans (at, m)."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["at"] + s["m"] - F.greatest(acc["end"], s["at"]))).alias("n"),
        F.greatest(acc["end"], s["at"] + s["m"]).alias("end"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]


def _by_document(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """hit_id, hit_key, spans, items and n_hit of each document that has hits; small enough or shuffled."""
    hits = find_hits(docs, benchmark, window).groupBy(F.col("id").alias("hit_id"), F.col("key").alias("hit_key")).agg(
        F.array_sort(F.collect_set(F.struct("at", "m"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    return common.small(common.durable(hits.withColumn("n_hit", _covered(F.col("spans")).cast("long"))))


def _joined(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """rows (with id and key) and, where there are any, their hits."""
    return rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """id (doc_id), key (text_key), n_words, n_hit, items, spans and contaminated for each row of docs.

    A document is contaminated if it has hits and they are at least 1/share of its words.
    """
    counted = docs.select(F.col("doc_id").alias("id"), common.text_key().alias("key"), F.size(word_array("text")).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    found = _joined(counted, _by_document(docs, benchmark, window))
    return found.select("id", "key", "n_words", n_hit.alias("n_hit"), "items", "spans", ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """docs without its contaminated rows; the columns of docs."""
    bad = common.durable(contamination(docs, benchmark, window, share).where("contaminated").select("id", "key").distinct())
    bad = common.small(bad.select(F.col("id").alias("hit_id"), F.col("key").alias("hit_key")))
    rows = docs.select(common.packed(docs).alias("row"), F.col("doc_id").alias("id"), common.text_key().alias("key"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and clean_text, one row for each row of docs: the text as it stands, without the words that a benchmark window
    covers and without what lies between them and the next word."""
    rows = docs.select(F.col("doc_id").alias("id"), common.text_key().alias("key"), "text")
    joined = _joined(rows, _by_document(docs, benchmark, window))
    joined = joined.withColumn("pieces", F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["m"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), covered)
    clean = F.concat(F.regexp_extract("text", LEAD, 0), F.array_join(F.transform(kept, lambda i: F.get("pieces", i)), ""))
    return joined.select(F.col("id").alias("doc_id"), F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean).alias("clean_text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(common.documents(spark, sf_dir), benchmark)
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    ids = F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


_CLASS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_CLASS}')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, list_slice(w, i, i + least(len(w), {WINDOW}) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, list_slice(w, i, i + m - 1) AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
hits AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""
