"""The corpus of obligations: queries, citations, verification, merging and changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlake.functions.folders import bounded
from govlake.functions.rules import host_of, slug, window_hashes


def plan_queries(profiles: DataFrame, packs: DataFrame, facets: DataFrame) -> DataFrame:
    """(project, pack, facet): always-on facets and those that a project's trigger calls for, for its packs; a framework pack answers only facets it hints.

    profiles: project, pack, trigger; packs: pack, framework, hints; facets: facet, trigger (null: always).
    """
    needs = facets.withColumnRenamed("trigger", "needs")
    always = profiles.withColumn("all", F.lit(1)).join(needs.where("needs is null").select(F.lit(1).alias("all"), "facet"), "all").drop("all")
    asked = always.unionByName(profiles.join(needs.where("needs is not null"), F.col("needs") == F.col("trigger")).drop("needs"))
    both = asked.join(packs, "pack").where(~F.col("framework") | F.array_contains("hints", F.col("facet")))
    return both.select("project", "pack", "facet").distinct()


def mark_primary(citations: DataFrame, authorities: DataFrame) -> DataFrame:
    """citations (id, url) with primary: the host is an authority or below one. Host suffixes meet authorities by equality."""
    parts = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = citations.withColumn("host", host_of(F.col("url")))
    good = hosts.select("host").distinct().select("host", F.explode(suffixes).alias("domain")).join(authorities, "domain", "left_semi").select("host", F.lit(True).alias("p")).distinct()
    return hosts.join(good, "host", "left").select("id", "url", F.coalesce("p", F.lit(False)).alias("primary"))


def build_obligations(raw: DataFrame) -> DataFrame:
    """raw (pack, provision, text, primary, amount, currency, confidence) as typed rows; reason says why a row is in quarantine.

    A penalty needs an amount above 0 and a currency; confidence is held to 0..1 and is 0.6 by default.
    """
    reason = F.when((F.coalesce(F.trim("provision"), F.lit("")) == "") | (F.coalesce(F.trim("text"), F.lit("")) == ""), "incomplete").when(~F.coalesce("primary", F.lit(False)), "no_primary_source")
    sound = (F.col("amount") > 0) & F.col("currency").isNotNull()
    return raw.select(
        F.concat_ws("-", "pack", slug(F.col("provision"))).alias("id"),
        reason.alias("reason"),
        F.when(sound, F.col("amount").cast("decimal(18,2)")).alias("penalty"),
        F.when(sound, F.col("currency")).alias("currency"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.6)))).alias("confidence"),
    )


def trap_gate(items: DataFrame, batch: list[str], failed: str, limit: int = 2) -> DataFrame:
    """Items with exclusion: all of a batch whose control question failed `limit` times are excluded."""
    bad = items.groupBy(*batch).agg(F.count_if(failed).alias("failures")).where(F.col("failures") >= limit).select(*batch, F.lit("fabrication_suspected").alias("exclusion"))
    return items.join(bad, batch, "left")


def apply_verification(obligations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, verification, confidence, keeps_penalty); obligations id, confidence; verdicts id, verdict."""
    v = F.col("verdict")
    state = F.when(v == "confirmed", "double_sourced").when(v == "contradicted", "disputed").when(v == "not_found", "excluded").otherwise("single_sourced")
    confidence = F.when(v == "confirmed", F.least(F.lit(1.0), F.col("confidence") + 0.1)).when(v == "unclear", F.greatest(F.lit(0.0), F.col("confidence") - 0.15)).otherwise(F.col("confidence"))
    return obligations.join(verdicts, "id", "left").select("id", state.alias("verification"), F.round(confidence, 6).alias("confidence"), F.coalesce(v == "confirmed", F.lit(False)).alias("keeps_penalty"))


def plain_page(html: Column) -> Column:
    """A page's text: no scripts, styles and tags, entities resolved, blanks collapsed, lower case."""
    text = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)\\b.*?</(script|style)>", " "), "<[^>]+>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return collapsed(text)


def collapsed(text: Column) -> Column:
    """Runs of blanks as one, none at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, "[ \t\r\n]+", " ")))


#: Characters that a quote must have, and of the pieces by which quotes of one or two words are looked up.
QUOTE, PIECE = 24, 12


def _needles(quotes: DataFrame) -> DataFrame:
    """(item_id, needle): each quote, and the third to eighth of its words of more than three letters if it has six of them."""
    q = quotes.select("item_id", collapsed(F.col("text")).alias("quote")).where(F.length("quote") >= QUOTE)
    long = F.filter(F.split("quote", " "), lambda w: F.length(w) > 3)
    run = F.when(F.size(long) >= 6, F.array_join(F.slice(long, 3, 6), " "))
    return q.select("item_id", F.explode(F.array_compact(F.array("quote", run))).alias("needle")).distinct()


def _keyed(needles: DataFrame, shingle: int) -> DataFrame:
    """needles with size and key: the hash of `size` words that stand whole in any text with the needle, as none of them is its
    first or last; size 0 and a piece of characters for needles of one or two words."""
    w = F.split("needle", " ")
    size = F.greatest(F.lit(0), F.least(F.lit(shingle), F.size(w) - 2))
    words = F.coalesce(*[F.when(size == k, window_hashes(F.slice(w, 2, k), k)[0]) for k in range(1, shingle + 1)])
    return needles.select("item_id", "needle", size.alias("size"), F.coalesce(words, F.xxhash64(F.left("needle", F.lit(PIECE)))).alias("key"))


def verify_quotes(quotes: DataFrame, sources: DataFrame, shingle: int = 6, pages: bool = False) -> DataFrame:
    """(item_id, n_sources): how many sources hold each quote of 24 characters or more; null for shorter ones, which can't be checked.

    A source holds a quote if it has its text, or the third to eighth of the quote's words of more than three letters, wherever they begin or
    end, blanks collapsed and in lower case; with pages, sources are HTML. Sources are looked up by hashes of words or characters
    that a holder must have, and only those found are searched. Null texts hold nothing; rows that repeat a source_id are
    one source with several texts; of rows that repeat an item_id any may be found.
    """
    needles = _keyed(_needles(quotes), shingle)
    body = plain_page(F.col("text")) if pages else collapsed(F.col("text"))
    bodies = sources.select("source_id", body.alias("body")).where("body <> ''")
    near = []
    for k in [r[0] for r in needles.select("size").distinct().collect()]:  # at most shingle + 1 numbers
        starts = F.sequence(F.lit(1), F.greatest(F.length("body") - (PIECE - 1), F.lit(1)))
        keys = window_hashes(F.split("body", " "), k) if k else F.transform(starts, lambda i: F.xxhash64(F.substring(F.col("body"), i, F.lit(PIECE))))
        own = bounded(needles.where(F.col("size") == k).select("item_id", "key"))
        near.append(bodies.select("source_id", F.explode_outer(F.array_distinct(keys)).alias("key")).join(own, "key").select("source_id", "item_id"))
    out = quotes.select("item_id", F.coalesce(F.length(collapsed(F.col("text"))) >= QUOTE, F.lit(False)).alias("long")).groupBy("item_id").agg(F.bool_or("long").alias("long"))
    if not near:
        return out.select("item_id", F.lit(None).cast("long").alias("n_sources"))
    found = reduce(DataFrame.unionByName, near).distinct().join(bodies, "source_id").join(needles.select("item_id", "needle"), "item_id").where(F.contains("body", "needle"))
    counts = found.groupBy("item_id").agg(F.count_distinct("source_id").alias("n"))
    return out.join(counts, "item_id", "left").select("item_id", F.when(F.col("long"), F.coalesce("n", F.lit(0).cast("long"))).alias("n_sources"))


def merge_obligations(rows: DataFrame, key: Column) -> DataFrame:
    """(key, n, first_id, facets): one row per key with the union of facets; the smallest id leads."""
    grouped = rows.groupBy(key.alias("key"))
    return grouped.agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.array_join(F.sort_array(F.collect_set("facet")), ",").alias("facets"), F.max("confidence").alias("confidence"))


def flag_stale(rows: DataFrame, date: str, ttl_days: int, as_of: str) -> DataFrame:
    """rows with stale: older than ttl_days, or without a readable date."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col(date).try_cast("date"))
    return rows.withColumn("stale", F.coalesce(age > ttl_days, F.lit(True)))


def corpus_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(id, status): new, changed, unchanged or removed, by a hash of the text."""
    p, c = (x.select("id", F.sha2("text", 256).alias(n)) for x, n in ((previous, "p"), (current, "c")))
    status = F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "removed").when(F.col("p") == F.col("c"), "unchanged").otherwise("changed")
    return p.join(c, "id", "full").select("id", status.alias("status"))


def exclusion_summary(excluded: DataFrame) -> DataFrame:
    """(reason, n, first_id) of what was left out."""
    return excluded.groupBy("reason").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def citation_inventory(citations: DataFrame) -> DataFrame:
    """(host, n, n_primary) of citations with their primary flag."""
    return citations.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count_if("primary").alias("n_primary"))


def region_summary(obligations: DataFrame) -> DataFrame:
    """(region, n, double_sourced, disputed)."""
    state = F.col("verification")
    return obligations.groupBy("region").agg(F.count("*").alias("n"), F.count_if(state == "double_sourced").alias("double_sourced"), F.count_if(state == "disputed").alias("disputed"))


def pack_coverage(packs: DataFrame, known: list[str]) -> DataFrame:
    """(pack, n, covered, missing) of facets against the known ones."""
    sets = packs.groupBy("pack").agg(F.count("*").alias("n"), F.collect_set("facet").alias("f"))
    every = F.array(*[F.lit(k) for k in known])
    return sets.select("pack", "n", F.size(F.array_intersect("f", every)).alias("covered"), F.array_join(F.sort_array(F.array_except(every, "f")), ",").alias("missing"))
