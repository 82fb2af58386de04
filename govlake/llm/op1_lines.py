"""Removal of boilerplate lines by their frequency within a host. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.llm.store import saved

RATIO = 0.02
SALTS = 32
#: Boilerplate lines of all hosts up to which their keys are broadcast, 16 bytes each; beyond, the lines of all pages are looked up by shuffle.
BROADCAST_LINES = 50_000
_BLANKS = " \t\r\x0b\x0c"


def line_key(line: Column) -> Column:
    """128-bit key of a line without the blanks around it; null for a line of blanks."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = 1) -> DataFrame:
    """(host, key, pages) of the lines that stand on more than `ratio` of their host's pages; and, if asked for, on min_pages at least.

    A page counts once for each different line. At most (lines per page / ratio) lines of a host can exceed the
    ratio. Counts meet their host's total in SALTS parts, so that no host brings all its lines to one task.
    """
    pages = docs.select(F.coalesce(F.col(host_col), F.lit("")).alias("host"), lines_of(F.col(text_col)).alias("lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    totals = totals.select("host", "total", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    counts = pages.select("host", F.explode(_keys(F.col("lines"))).alias("key")).groupBy("host", "key").agg(F.count("*").alias("pages"))
    salted = counts.where(F.col("pages") >= min_pages).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return salted.join(totals, ["host", "salt"]).where(F.col("pages") > ratio * F.col("total")).select("host", "key", "pages")


def _keys(lines: Column) -> Column:
    """Keys of the different lines that aren't blank."""
    return F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: k.isNotNull()))


def _slot(key: Column, slots: Column) -> Column:
    return F.pmod(F.xxhash64(key), slots).cast("int")


def _hashed(rare: DataFrame) -> DataFrame:
    """(host, drop): the keys of each host as a hash table, an array of about a slot for four keys, so that a look-up costs the same whatever their number."""
    sized = rare.groupBy("host").agg(F.ceil(F.count("*") / 4).cast("int").alias("slots"))
    held = rare.join(sized, "host").select("host", _slot(F.col("key"), F.col("slots")).alias("slot"), "key")
    every = sized.select("host", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    filled = every.join(held, ["host", "slot"], "left").groupBy("host", "slot").agg(F.collect_list("key").alias("keys"))
    table = F.transform(F.array_sort(F.collect_list(F.struct("slot", "keys"))), lambda x: x["keys"])
    return filled.groupBy("host").agg(table.alias("drop"))


def without_boilerplate(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = 1, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """(page, text, n_lines, n_dropped): page is the row as it was, text without boilerplate lines.

    Lines are compared without blanks around them; lines of blanks are neither counted nor dropped. A null
    host is a host of its own. A null text stays null with 0 lines; a page that loses all lines has an empty
    text. Repeated rows are pages each; ids may be null. A host of one page loses every line, as each stands on all its pages.
    Up to broadcast_lines boilerplate lines are sent to all executors and no page moves. Beyond, line keys are matched in SALTS parts, so that no line
    brings all its pages to one task, and pages meet what they lose by id, host and a hash of the text.
    """
    rare = saved(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    pages = docs.select(F.struct(*docs.columns).alias("page"))
    text, host = F.col("page")[text_col], F.coalesce(F.col("page")[host_col], F.lit(""))
    if rare.count() <= broadcast_lines:
        joined = pages.join(F.broadcast(_hashed(rare)), host == F.col("host"), "left")
    else:
        salted = rare.select("host", "key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.xxhash64(text_col).alias("at"), F.col(text_col).alias("text"))
        entries = rows.select("id", "host", "at", F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(_keys(lines_of(F.col("text")))).alias("key"))
        hits = entries.join(salted, ["host", "key", "salt"], "left_semi")
        drops = hits.groupBy("id", "host", "at").agg(F.array(F.collect_set("key")).alias("drop")).hint("merge")
        joined = pages.join(drops, F.col("page")[id_col].eqNullSafe(drops["id"]) & (host == drops["host"]) & (F.xxhash64(text) == drops["at"]), "left")
    lines = lines_of(text)
    keyed = F.transform(lines, lambda line: F.struct(line.alias("line"), line_key(line).alias("key")))
    kept = F.transform(F.filter(keyed, lambda x: ~F.coalesce(F.array_contains(F.get(F.col("drop"), _slot(x.key, F.size("drop"))), x.key), F.lit(False))), lambda x: x.line)
    return joined.select(
        "page",
        F.when(F.col("drop").isNull(), text).otherwise(F.when(text.isNotNull(), F.array_join(kept, "\n"))).alias("text"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("drop").isNull() | text.isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"),
    )


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", min_pages: int = 1) -> DataFrame:
    """docs with boilerplate lines out of text_col, and n_chars, where there's such a column, as long as the text now is."""
    done = without_boilerplate(docs, id_col, host_col, text_col, min_pages=min_pages)
    new = {text_col: F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[new.get(c, F.col("page")[c]).alias(c) for c in docs.columns])


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on more than RATIO of its source's documents."""
    done = without_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select(F.col("page.doc_id").alias("doc_id"), "n_lines", "n_dropped", "text")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, host, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))))) AS bare FROM d),
t AS (SELECT host, count(*) AS total FROM d GROUP BY host),
b AS (SELECT host, bare FROM l JOIN t USING (host) WHERE bare <> '' GROUP BY host, bare, total HAVING count(*) > {RATIO} * total),
g AS (SELECT host, list(bare) AS bad FROM b GROUP BY host),
k AS (SELECT doc_id, text, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) AS kept FROM d LEFT JOIN g USING (host))
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines, len(lines) - len(kept) AS n_dropped,
  CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text FROM k
"""
