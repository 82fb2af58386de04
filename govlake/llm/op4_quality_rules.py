"""Quality rules and a hashed n-gram log-likelihood ratio of trusted and raw text. DataFrame operations only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.llm.native import bound, window_hashes, word_hashes, words_of
from govlake.llm.store import bounded, saved

BUCKETS = 1 << 14
#: Mean log-likelihood ratio of a text's n-grams below which it's rejected.
THRESHOLD = -0.1
#: Part of the raw corpus in the trusted multinomial, so that an n-gram that no trusted text has costs at most log(1 / MIX).
MIX = 0.2
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
_SYMBOLS = "[#*$%&|<>]"


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words in windows of `window` words that occur twice or more in the text.

    Windows are hashed; only a text in which two hashes are equal has its windows sorted to find them. Work is n log n in the text's words.
    """

    def covered(sorted_: Column) -> Column:
        """Words covered by the windows whose hash a neighbour in the order shares."""
        n = F.size(sorted_)
        twin = F.filter(sorted_, lambda x, i: F.coalesce((F.get(sorted_, i - 1).h == x.h) | (F.get(sorted_, i + 1).h == x.h), (F.get(sorted_, i - 1).h == x.h), (F.get(sorted_, i + 1).h == x.h), F.lit(False)))
        places = F.sort_array(F.transform(twin, lambda x: x.i))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total"))
        walked = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a.total + F.least(F.lit(window), p - a.last)).alias("total")))
        return F.when(n > 0, walked.total).otherwise(0)

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bound(pairs, covered))

    hashes = bound(word_hashes(words), lambda h: window_hashes(h, window))
    return F.coalesce(bound(hashes, of), F.lit(0)).cast("long")


def base_rules(text: Column) -> dict[str, Column]:
    """The plain rules' columns; a null text counts as an empty one."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words_of(text)).cast("long"),
        "word_chars": F.length(F.array_join(words_of(text), "")).cast("long"),
        "n_symbols": F.regexp_count(full, F.lit(_SYMBOLS)).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words_of(text)),
    }


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of a text's words and word pairs."""
    of = lambda hashes: F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    return bound(word_hashes(words_of(text)), lambda h: F.concat(of(h), of(window_hashes(h, 2))))


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row with one array: the log-likelihood ratio of each bucket between the multinomials of the trusted documents and of all.

    trusted holds ids. Every n-gram of every document counts. The array has `buckets` numbers whatever the corpus.
    """
    marks = bounded(saved(trusted.select(F.col(id_col).alias("id"), F.lit(1).alias("t")).where("id is not null").distinct(), "trusted"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks, "id", "left")
    grams = rows.select("t", F.explode_outer(ngram_buckets(F.col("text"), buckets)).alias("bucket")).where("bucket is not null")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("t").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "good"])
    one = every.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "good"))).alias("all"), F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw = lambda x: (x.raw + 1) / (F.col("raw") + buckets)
    ratio = lambda x: F.log((1 - MIX) * x.good / F.col("good") / raw(x) + MIX)
    return one.select(F.transform("all", lambda x: F.when(F.col("good") > 0, ratio(x)).otherwise(0.0)).alias("ratios"))


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) per row of docs.

    score is the sum of the ratios of the text's words and word pairs over their number; a text without words has score null.
    kept is false if base_failed, else score >= threshold. Without trusted documents all scores are 0 and the
    rules alone decide. Null ids are scored like others and never trusted; repeated rows count each.
    """
    numbers = ratios(docs, trusted, id_col, text_col, buckets).first()[0]  # `buckets` numbers
    table = F.from_json(F.lit(json.dumps(numbers)), "array<double>")
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def mean(t: Column) -> Column:
        return bound(ngram_buckets(text, buckets), lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(t, x)) / F.size(g)))

    out = rows.select("id", *[c.alias(n) for n, c in base_rules(text).items()], bound(table, mean).alias("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).withColumnRenamed("id", id_col)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base columns, score and verdict of every document; trusted are the labelled ones of quality that aren't toxic."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, labels.where("quality = 1 and toxic = 0")).withColumn("score", F.round("score", 9))
