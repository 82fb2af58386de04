"""Benchmark items inside long documents: size-partitioned MinHash containment search. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govlake.llm.native import bound, window_hashes, word_hashes, words_of
from govlake.llm.store import bounded, saved

SHINGLE = 5
PERCENT = 75

def lower_words(text: Column) -> Column:
    return words_of(F.lower(text))


def windows(words: Column, size: int) -> Column:
    """The `size` words from each word on, joined by a space."""
    one = lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.array_join(F.slice(w, i, size), " ")))
    return F.coalesce(bound(words, one), F.array().cast("array<string>"))


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, n, size, shingle, hash): distinct shingles of each item; one with fewer than SHINGLE words is one shingle of `size` words."""
    w = items.select(F.col(id_col).alias("item_id"), lower_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)

    def pairs(size: int) -> Column:
        hashes = bound(word_hashes(F.col("words")), lambda h: window_hashes(h, size))
        return F.array_distinct(F.arrays_zip(windows(F.col("words"), size).alias("shingle"), hashes.alias("hash")))

    size = F.least(F.size("words"), F.lit(SHINGLE))
    sets = F.coalesce(*[F.when(size == k, pairs(k)) for k in range(1, SHINGLE + 1)])
    rows = w.select("item_id", size.alias("size"), sets.alias("set"))
    return rows.select("item_id", F.size("set").alias("n"), "size", F.explode("set").alias("s")).select("item_id", "n", "size", "s.shingle", "s.hash")


def sketch(shingles: DataFrame) -> DataFrame:
    """The MinHash sketch of each item: its m smallest shingle hashes.

    Items are partitioned by size into [2^k, 2^(k+1)); m is one more than a quarter of the partition's
    upper size. An item contained to PERCENT lacks at most a quarter of its shingles, so it shares one of these m.
    """
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("int")
    m = F.floor(upper * (100 - PERCENT) / 100).cast("int") + 1
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("hash"))
    hashed = shingles.select("item_id", "n", "size", "hash", m.alias("m"))
    return hashed.withColumn("rank", rank).where("rank <= m").select("item_id", "n", "size", "hash")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, at, item_id, hits, n): rows that hold at least PERCENT of the n distinct shingles of an item.

    A row is known by its id and `at`, a hash of its text, so rows with null or repeated ids are judged by their own texts;
    rows of equal ids and texts are one. Every shingle of every document is looked up among the items' sketches; documents with a hit are then
    compared shingle by shingle with the items, as strings. Shingles are made by explode_outer, for which
    Spark doesn't add a filter that would make them a second time, and before the join. No item and no document is missed. Null and empty
    texts hold nothing; items without words match nothing. Repeated items count once; an item with a null id has the id null.
    """
    shingles = saved(item_shingles(items, item_col, item_text).distinct(), "shingles")
    sizes = [r[0] for r in shingles.select("size").distinct().collect()]  # at most SHINGLE numbers
    sketches = saved(sketch(shingles), "item-sketches")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("at"), F.col(text_col).alias("text")).where(F.col("text") != "")

    def hashes_of(size: int):
        return lambda h: window_hashes(h, size)

    if not sizes:
        return texts.select("id", "at", F.lit(None).cast(dict(items.dtypes)[item_col]).alias("item_id"), F.lit(0).cast("long").alias("hits"), F.lit(0).alias("n")).where("false")
    hashed = [texts.select("id", "at", F.explode_outer(bound(word_hashes(lower_words(F.col("text"))), hashes_of(k))).alias("hash")).join(bounded(sketches.where(F.col("size") == k)), "hash").select("id", "at") for k in sizes]
    found = bounded(saved(reduce(DataFrame.unionByName, hashed).distinct(), "candidates"))
    same = texts["id"].eqNullSafe(found["id"]) & (texts["at"] == found["at"])
    near = texts.join(found, same, "left_semi")
    strings = [near.select("id", "at", F.explode_outer(F.array_distinct(windows(lower_words(F.col("text")), k))).alias("shingle")).join(bounded(shingles.where(F.col("size") == k)), "shingle") for k in sizes]
    hits = reduce(DataFrame.unionByName, strings)
    counted = hits.groupBy("id", "at", "item_id", "n").agg(F.count_distinct("shingle").alias("hits"))
    return counted.where(100 * F.col("hits") >= PERCENT * F.col("n")).select("id", "at", "item_id", "hits", "n")


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item, those without an id included."""
    gone = bounded(saved(leaks(docs, items, id_col, text_col).select("id", "at").distinct(), "leaks"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["id"]) & (F.xxhash64(docs[text_col]) == gone["at"]), "left_anti")


def op8_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items held, the first of them, the highest containment and the verdict for every document."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = leaks(docs, items).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max(F.col("hits") / F.col("n")).alias("containment"))
    out = docs.select("doc_id").join(bounded(saved(found, "found")), "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "first_item", F.round(F.coalesce("containment", F.lit(0.0)), 6).alias("containment"), F.col("n_items").isNull().alias("kept"))


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
SQL = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, len(x) AS n, least(k, {SHINGLE}) AS size, unnest(x) AS shingle FROM (SELECT item_id, len(w) AS k, CASE WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda j: array_to_string(w[j:j + {SHINGLE} - 1], ' '))) END AS x FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
z AS (SELECT DISTINCT size FROM s),
e AS (SELECT DISTINCT doc_id, size, shingle FROM (SELECT doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda j: array_to_string(w[j:j + size - 1], ' '))) AS shingle FROM d, z)),
h AS (SELECT doc_id, item_id, n, count(*) AS hits FROM e JOIN s USING (size, shingle) GROUP BY ALL HAVING 100 * count(*) >= {PERCENT} * n),
g AS (SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item, max(hits / n) AS containment FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(n_items, 0) AS n_items, first_item, round(coalesce(containment, 0), 6) AS containment, n_items IS NULL AS kept FROM documents LEFT JOIN g USING (doc_id)
"""
