"""Spend and cache ledgers: append-only tables of calls (run_id, seat, phase, ts, ...)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from govlake.functions.blocks import Blocks

CHARS_PER_TOKEN = 3.6
CALL_CHARS = 60000
#: Fallback prices per million tokens, in and out. Fixed values.
PRICE_IN, PRICE_OUT = 3.0, 15.0
#: Spend is summed in exact decimals, so that no order of rows changes a comparison with a cap.
MONEY = "decimal(28,9)"


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (call_id, model, tokens_in, tokens_out, reported, cached) with cost: cached calls are free, a vendor's
    own figure of 0 or more wins, a model without a price takes that of *, or the fallback price where * has none.

    Of several prices of a model the highest holds, so no call is lost or doubled.
    """
    p = prices.groupBy("model").agg(F.max("price_in").alias("i"), F.max("price_out").alias("o"))
    other = p.where("model = '*'").first()
    di, do = (other.i, other.o) if other else (PRICE_IN, PRICE_OUT)
    joined = calls.join(p, "model", "left")
    counted = F.col("tokens_in") / 1e6 * F.coalesce("i", F.lit(di)) + F.col("tokens_out") / 1e6 * F.coalesce("o", F.lit(do))
    cost = F.when(F.col("cached"), 0.0).when(F.col("reported") >= 0, F.col("reported")).otherwise(counted)
    return joined.select("call_id", "model", F.round(cost, 9).alias("cost"))


def project_spend(assets: DataFrame, project: str = "project") -> DataFrame:
    """(project, tokens, calls, cost) that an audit of the assets would take."""
    tokens, calls = F.sum(F.ceil(F.length("content") / CHARS_PER_TOKEN)), F.greatest(F.lit(1), F.ceil(F.sum(F.length("content")) / CALL_CHARS))
    sized = assets.groupBy(project).agg(tokens.alias("tokens"), calls.alias("calls"))
    return sized.withColumn("cost", F.round(F.col("tokens") / 1e6 * PRICE_IN + F.col("calls") * 2000 / 1e6 * PRICE_OUT, 6))


def enforce_budget(calls: DataFrame, caps: dict | float, mode: str = "degrade", order: str = "ts", run_phases: tuple[str, ...] = ()) -> DataFrame:
    """calls with spent_before, refused, warned and ends, in time order per (run_id, seat).

    caps: highest spend of every seat, or by seat; a seat without one, or with 0 or less, has none. From the first call that would exceed its cap, calls are
    refused in the modes degrade and stop, where ends tells what the first refusal ends in stop mode (run for run_phases, else phase);
    in the mode warn no call is refused and those beyond the cap are marked. Cached calls cost nothing and are neither refused nor warned of. Sums are exact
    decimals; a run and seat of any weight is scanned by blocks.
    """
    cap = F.lit(None).cast(MONEY)
    for name, most in (caps if isinstance(caps, dict) else {None: caps}).items():
        own = F.lit(True) if name is None else F.col("row.seat") == name
        cap = F.when(own, F.lit(float(most) if most > 0 else None).cast(MONEY)).otherwise(cap)
    blocks = Blocks(calls, ["run_id", "seat"], [order, "call_id"])
    cached, cost = F.coalesce("row.cached", F.lit(False)), F.coalesce(F.col("row.cost").cast(MONEY), F.lit(0).cast(MONEY))
    rows = blocks.rows.withColumn("spent", F.when(cached, F.lit(0).cast(MONEY)).otherwise(cost))
    rows = rows.withColumn("own", F.sum("spent").over(blocks.run.rowsBetween(W.unboundedPreceding, -1)))
    rows = blocks.with_carry(rows, F.sum("spent"), lambda a, b: a + b, "carried")
    before = F.coalesce("own", F.lit(0)) + F.coalesce("carried", F.lit(0))
    rows = rows.withColumn("before", before).withColumn("breach", F.coalesce(~cached & (F.col("before") + cost > cap), F.lit(False)))
    rows = rows.withColumn("n", F.count_if("breach").over(blocks.run.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = blocks.with_carry(rows, F.count_if("breach"), lambda a, b: a + b, "earlier")
    nth = F.col("n") + F.coalesce("earlier", F.lit(0))
    refused, warned, ends = F.lit(False), F.lit(False), F.lit(None).cast("string")
    if mode == "warn":
        warned = F.col("breach")
    else:
        refused = (nth > 0) & ~cached
        if mode == "stop":
            ends = F.when(F.col("breach") & (nth == 1), F.when(F.col("row.phase").isin(*run_phases), "run").otherwise("phase"))
    out = {"spent_before": F.round(F.col("before").cast("double"), 6), "refused": refused, "warned": warned, "ends": ends}
    return rows.select(*[F.col("row")[c].alias(c) for c in calls.columns if c not in out], *[c.alias(k) for k, c in out.items()])


def spend_rollup(calls: DataFrame) -> DataFrame:
    """(seat, phase, run_id, level, calls, cached, tokens_in, tokens_out, cost, reported_share) by seat, by phase, by run and in all.

    reported_share is the share of calls whose cost is the vendor's own figure.
    """
    sums = [F.count("*").alias("calls"), F.count_if("cached").alias("cached"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 4).alias("cost"), F.round(F.count_if("reported") / F.count("*"), 6).alias("reported_share")]
    out = calls.groupingSets([["seat"], ["phase"], ["run_id"], []], "seat", "phase", "run_id").agg(F.grouping_id().cast("int").alias("level"), *sums)
    return out.select("seat", "phase", "run_id", "level", "calls", "cached", "tokens_in", "tokens_out", "cost", "reported_share")


def cache_key(version: Column, input_hash: Column, model: Column, params: Column) -> Column:
    """Key of a model call: the hash of its prompt's version, its input's hash, its model and its parameters, a map, in the order of their names. A null part counts as empty."""
    entries = F.array_sort(F.map_entries(F.coalesce(params, F.create_map().cast("map<string,string>"))))
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (version, input_hash, model)], F.to_json(entries)), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame, ttl_days: float) -> DataFrame:
    """(request_id, verdict, age_days): the newest entry of a request's key that isn't newer than it: hit, stale or miss; bypass, without an age, where a boolean column bypass of
    requests says so or ttl_days is 0 or less.

    Both sides meet in one sorted run per key, cut into blocks, and the last entry is carried forward, so no request is joined with all entries of its key and no
    key is one task.
    """
    skipped = F.coalesce("bypass", F.lit(False)) if "bypass" in requests.columns else F.lit(False)
    asked = requests.select("key", "ts", F.lit(1).alias("kind"), "request_id", (skipped | F.lit(ttl_days <= 0)).alias("bypass"))
    both = asked.unionByName(cache.select("key", "ts", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("request_id"), F.lit(False).alias("bypass")))
    blocks, entry = Blocks(both, ["key"], ["ts", "kind"]), F.when(F.col("row.kind") == 0, F.col("row.ts"))
    rows = blocks.rows.withColumn("entry", F.last(entry, True).over(blocks.run.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = blocks.with_carry(rows, F.max(entry), lambda a, b: b).where("row.kind = 1")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = F.round((micros(F.col("row.ts")) - micros(F.coalesce("entry", "carry"))) / 8.64e10, 6)
    rows = rows.select("row.request_id", "row.bypass", F.when(~F.col("row.bypass"), age).alias("age_days"))
    verdict = F.when(F.col("bypass"), "bypass").when(F.col("age_days").isNull(), "miss").when(F.col("age_days") <= ttl_days, "hit").otherwise("stale")
    return rows.select("request_id", verdict.alias("verdict"), "age_days")


def cache_stats(cache: DataFrame, value: str, created: str, as_of: Column) -> DataFrame:
    """(entries, bytes, oldest_days) of a cache; an empty one has no bytes and no age."""
    return cache.agg(F.count("*").alias("entries"), F.sum(F.octet_length(value)).alias("bytes"), F.round(F.max((F.unix_micros(as_of) - F.unix_micros(F.col(created).cast("timestamp"))) / 8.64e10), 6).alias("oldest_days"))


@F.pandas_udf(StringType())
def _first_json(text: pd.Series) -> pd.Series:
    """The JSON object or array that begins at a text's first brace or bracket, whatever follows it; null where it has none."""
    read, out = json.JSONDecoder().raw_decode, []
    for t in text:
        found = t is not None and re.search(r"[\[{]", t)
        try:
            out.append(t[found.start() : read(t, found.start())[1]] if found else None)
        except (ValueError, RecursionError):
            out.append(None)
    return pd.Series(out, dtype="object")


def parse_responses(responses: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """responses with parsed (array of the schema's rows) and quarantined: the first JSON value of the first fenced block, else of the text.

    An object is one row, an array one per element. A text without a whole object or array, a null one included, is in quarantine with
    parsed null; fields that the schema names and a value lacks are null.
    """
    fence = F.nullif(F.regexp_extract(text, "```[a-z]*\\s*([\\s\\S]*?)```", 1), F.lit(""))
    body = F.coalesce(_first_json(fence), _first_json(F.col(text)))
    rows = F.from_json(F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body), f"array<struct<{schema}>>")
    return responses.withColumn("parsed", rows).withColumn("quarantined", F.col("parsed").isNull())
