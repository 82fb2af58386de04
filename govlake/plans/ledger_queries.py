"""Ledger and obligation-corpus operators over the given tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.operators import corpus as c
from govlake.operators import ledgers as m
from govlake.plans.tables import ASSETS, assets, rows, sql_values, table

PRICES = [("*", 3.0, 15.0), ("purchase", 1.0, 2.0), ("error", 10.0, 30.0)]
CAP = 500.0
CAPS = {0: 500.0, 1: 300.0, 2: 0.0}
RUN_PHASES = ("purchase", "error")
FACETS = [("lawful_basis", None), ("breach", None), ("children", "HOUSEHOLD"), ("credit", "AUTOMOBILE"), ("transfer", "MACHINERY")]
HINTS = ["breach", "children"]
DOMAINS = [("example.org",), ("therin.example.net",), ("therha.example.com",)]


def _calls(s, sf):
    e = table(s, sf, "events")
    return e.select(F.col("event_id").alias("call_id"), F.col("user_id").alias("run_id"), (F.col("user_id") % 3).alias("seat"), F.col("event_type").alias("phase"), "ts", F.col("value").alias("cost"), (F.col("event_type") == "view").alias("cached"), (F.col("event_id") % 4 == 0).alias("reported"), F.length("props").alias("tokens_in"), (F.col("event_id") % 100).alias("tokens_out"))


def _budgets(s, sf):
    modes = [m.enforce_budget(_calls(s, sf), CAPS, mode, run_phases=RUN_PHASES).withColumn("mode", F.lit(mode)) for mode in ("degrade", "stop", "warn")]
    return reduce(DataFrame.unionByName, modes).select("mode", "call_id", "spent_before", "refused", "warned", "ends")


def _responses(s, sf):
    """Event properties in prose, in fenced arrays and cut short."""
    k = F.col("event_id") % 3
    text = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("Sure: "), F.expr("left(props, length(props) - 1)"))).when(k == 0, F.concat(F.lit("Sure: "), "props", F.lit("} done"))).when(k == 1, F.concat(F.lit("See\n```json\n["), "props", F.lit(", "), "props", F.lit("]\n``` {"))).otherwise(F.col("props"))
    out = m.parse_responses(table(s, sf, "events").select("event_id", text.alias("text")), "k int")
    return out.select("event_id", F.array_join(F.transform("parsed", lambda x: x.k.cast("string")), ",").alias("ks"), "quarantined")


def _priced(s, sf):
    e = table(s, sf, "events")
    return e.select(F.col("event_id").alias("call_id"), F.col("event_type").alias("model"), (F.col("user_id") * 100).alias("tokens_in"), F.length("props").alias("tokens_out"), F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("reported"), (F.col("event_type") == "view").alias("cached"))


def _lookup(s, sf):
    e = table(s, sf, "events")
    params = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("group"), (F.col("user_id") % 5).cast("string"))
    e = e.withColumn("key", m.cache_key(F.lit("v1"), F.lit("input"), F.lit("model"), params))
    kept = F.col("event_type").isin("purchase", "view")
    return m.cache_lookup(e.where(~kept).select("key", "ts", F.col("event_id").alias("request_id"), (F.col("event_id") % 10 == 0).alias("bypass")), e.where(kept).select("key", "ts"), 0.5)


def _cache_keys(s, sf):
    """Keys of the events, their parameters in two orders."""
    user, k, parts = F.col("user_id").cast("string"), F.get_json_object("props", "$.k"), (F.lit("v2"), F.sha2("props", 256), F.col("event_type"))
    orders = [F.create_map(F.lit("user"), user, F.lit("k"), k), F.create_map(F.lit("k"), k, F.lit("user"), user)]
    return table(s, sf, "events").select("event_id", *[m.cache_key(*parts, p).alias(f"key{i}") for i, p in enumerate(orders)])


def _split(s, sf):
    d = table(s, sf, "documents")
    before = d.select(F.col("doc_id").alias("id"), "text")
    after = d.select(F.when(F.col("doc_id") % 5 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("id"), F.concat("text", F.when(F.col("doc_id") % 7 == 0, "!").otherwise("")).alias("text"))
    return before, after


def _verdicts(s, sf):
    v = F.when(F.col("toxic") == 1, "contradicted").when(F.col("quality") == 1, "confirmed").otherwise("unclear")
    return table(s, sf, "labels").select(F.col("doc_id").alias("id"), v.alias("verdict"))


def _raw(s, sf):
    o = table(s, sf, "orders")
    n = table(s, sf, "pages").count()
    pages = table(s, sf, "pages").select(F.col("page_id").alias("p"), "url")
    j = o.withColumn("p", F.col("o_orderkey") % n).join(pages, "p")
    return j.select(F.col("o_orderpriority").alias("pack"), F.concat(F.lit("Article "), F.col("o_orderkey").cast("string")).alias("provision"), F.col("o_orderstatus").alias("text"), F.col("url").startswith("https").alias("primary"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("amount"), F.lit("EUR").alias("currency"), (F.col("o_orderkey") % 13 / 10).alias("confidence"))


def _packs(s, sf):
    regions = table(s, sf, "nation").select(F.col("n_name").alias("pack"), F.lit(False).alias("framework"))
    frames = table(s, sf, "region").select(F.col("r_name").alias("pack"), F.lit(True).alias("framework"))
    return regions.unionByName(frames).withColumn("hints", F.array(*map(F.lit, HINTS)))


def _profiles(s, sf):
    cust = table(s, sf, "customer").join(F.broadcast(table(s, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(s, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return cust.select(F.col("c_custkey").alias("project"), F.explode(F.array("n_name", "r_name")).alias("pack"), F.col("c_mktsegment").alias("trigger"))


QUERIES = {
    "l1_price_calls": lambda s, sf: m.price_calls(_priced(s, sf), rows(s, PRICES, "model string, price_in double, price_out double")),
    "l2_project_spend": lambda s, sf: m.project_spend(assets(s, sf)),
    "l3_enforce_budget": _budgets,
    "l4_spend_rollup": lambda s, sf: m.spend_rollup(_calls(s, sf)),
    "l5_cache_lookup": _lookup,
    "l5_cache_keys": _cache_keys,
    "l6_cache_stats": lambda s, sf: m.cache_stats(table(s, sf, "events"), "props", "ts", F.lit("2024-02-01 00:00:00").cast("timestamp")),
    "l7_parse_responses": _responses,
    "c1_plan_queries": lambda s, sf: c.plan_queries(_profiles(s, sf), _packs(s, sf), rows(s, FACETS, "facet string, trigger string")),
    "c2_mark_primary": lambda s, sf: c.mark_primary(table(s, sf, "pages").select(F.col("page_id").alias("id"), "url"), rows(s, DOMAINS, "domain string")),
    "c3_build_obligations": lambda s, sf: c.build_obligations(_raw(s, sf)),
    "c4_trap_gate": lambda s, sf: c.trap_gate(table(s, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), (F.col("event_type") == "error").alias("failed")), ["user_id", "day"], "failed").select("event_id", "exclusion"),
    "c5_apply_verification": lambda s, sf: c.apply_verification(table(s, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 11 / 10).alias("confidence")), _verdicts(s, sf)),
    "c6_verify_quotes": lambda s, sf: c.verify_quotes(table(s, sf, "benchmark"), table(s, sf, "documents").select(F.col("doc_id").alias("source_id"), "text")),
    "c7_merge_obligations": lambda s, sf: c.merge_obligations(table(s, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("facet"), "text", (F.col("doc_id") % 10 / 10).alias("confidence")), F.sha2(F.lower(F.trim("text")), 256)),
    "c8_flag_stale": lambda s, sf: c.flag_stale(table(s, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("retrieved")), "retrieved", 365, "1999-01-01").groupBy("stale").agg(F.count("*").alias("n")),
    "c9_corpus_changes": lambda s, sf: c.corpus_changes(*_split(s, sf)),
    "c10_exclusion_summary": lambda s, sf: c.exclusion_summary(c.build_obligations(_raw(s, sf)).where("reason is not null")),
    "c11_citation_inventory": lambda s, sf: c.citation_inventory(c.mark_primary(table(s, sf, "pages").select(F.col("page_id").alias("id"), "url"), rows(s, DOMAINS, "domain string"))),
    "c12_region_summary": lambda s, sf: c.region_summary(c.apply_verification(table(s, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(0.5).alias("confidence")), _verdicts(s, sf)).join(table(s, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("region")), "id")),
    "c13_pack_coverage": lambda s, sf: c.pack_coverage(table(s, sf, "part").select(F.col("p_brand").alias("pack"), F.split("p_type", " ")[0].alias("facet")), ["PROMO", "STANDARD", "SMALL", "MEDIUM", "ECONOMY", "LARGE"]),
}

_FACETS = sql_values(FACETS, "facet, needs")
_STATE = "CASE WHEN toxic = 1 THEN 'disputed' WHEN quality = 1 THEN 'double_sourced' ELSE 'single_sourced' END"
_PRIMARY = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host"
_IS = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for (d,) in DOMAINS)
_RAW = r"""r AS (SELECT o_orderpriority || '-' || regexp_replace(regexp_replace(lower('Article ' || o_orderkey), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS id,
  CASE WHEN NOT starts_with(url, 'https') THEN 'no_primary_source' END AS reason, CASE WHEN o_orderstatus <> 'P' AND o_totalprice > 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS penalty,
  CASE WHEN o_orderstatus <> 'P' AND o_totalprice > 0 THEN 'EUR' END AS currency, least(1.0, greatest(0.0, (o_orderkey % 13) / 10)) AS confidence
  FROM orders JOIN pages ON page_id = o_orderkey % (SELECT count(*) FROM pages))"""
_COLLAPSE = "lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))"

SQL = {
    "l1_price_calls": f"""WITH e AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN value END AS reported FROM events), p AS (SELECT * FROM {sql_values(PRICES, 'model, i, o')})
      SELECT event_id AS call_id, event_type AS model, round(CASE WHEN event_type = 'view' THEN 0 WHEN reported >= 0 THEN reported ELSE user_id * 100 / 1e6 * coalesce(i, 3) + length(props) / 1e6 * coalesce(o, 15) END, 9) AS cost FROM e LEFT JOIN p ON event_type = model""",
    "l2_project_spend": f"WITH {ASSETS}, s AS (SELECT project, sum(ceil(length(content) / 3.6)) AS tokens, greatest(1, ceil(sum(length(content)) / 60000)) AS calls FROM a GROUP BY project) SELECT project, tokens, calls, round(tokens / 1e6 * 3 + calls * 2000 / 1e6 * 15, 6) AS cost FROM s",
    "l3_enforce_budget": """WITH c AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 300 END AS cap FROM events),
      b AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'view' THEN 0 ELSE value END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c),
      x AS (SELECT *, coalesce(event_type <> 'view' AND spent + value > cap, false) AS over FROM b),
      f AS (SELECT *, sum(CAST(over AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM x)
      SELECT mode, event_id AS call_id, round(spent, 6) AS spent_before, mode <> 'warn' AND n > 0 AND event_type <> 'view' AS refused, mode = 'warn' AND over AS warned,
      CASE WHEN mode = 'stop' AND over AND n = 1 THEN CASE WHEN event_type IN ('purchase', 'error') THEN 'run' ELSE 'phase' END END AS ends FROM f, (VALUES ('degrade'), ('stop'), ('warn')) AS m(mode)""",
    "l4_spend_rollup": """SELECT user_id % 3 AS seat, event_type AS phase, user_id AS run_id, CAST(grouping_id(user_id % 3, event_type, user_id) AS INT) AS level, count(*) AS calls, count(*) FILTER (event_type = 'view') AS cached,
      sum(length(props)) AS tokens_in, sum(event_id % 100) AS tokens_out, round(sum(value), 4) AS cost, round(count(*) FILTER (event_id % 4 = 0) / count(*), 6) AS reported_share FROM events GROUP BY GROUPING SETS ((user_id % 3), (event_type), (user_id), ())""",
    "l5_cache_lookup": """WITH r AS (SELECT * FROM events WHERE event_type NOT IN ('purchase', 'view')), c AS (SELECT * FROM events WHERE event_type IN ('purchase', 'view')),
      j AS (SELECT r.event_id, (epoch_us(r.ts) - max(epoch_us(c.ts))) / 8.64e10 AS age FROM r LEFT JOIN c ON r.user_id = c.user_id AND c.ts <= r.ts GROUP BY r.event_id, r.ts)
      SELECT event_id AS request_id, CASE WHEN event_id % 10 = 0 THEN 'bypass' WHEN age IS NULL THEN 'miss' WHEN round(age, 6) <= 0.5 THEN 'hit' ELSE 'stale' END AS verdict, CASE WHEN event_id % 10 > 0 THEN round(age, 6) END AS age_days FROM j""",
    "l5_cache_keys": """WITH k AS (SELECT event_id, sha256('v2|' || sha256(props) || '|' || event_type || '|[{"key":"k","value":"' || json_extract_string(props, '$.k') || '"},{"key":"user","value":"' || user_id || '"}]') AS k FROM events) SELECT event_id, k AS key0, k AS key1 FROM k""",
    "l6_cache_stats": "SELECT count(*) AS entries, sum(strlen(props)) AS bytes, round(max(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 8.64e10, 6) AS oldest_days FROM events",
    "l7_parse_responses": """WITH p AS (SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events)
      SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 1 THEN k || ',' || k ELSE k END AS ks, event_id % 11 = 0 AS quarantined FROM p""",
    "c1_plan_queries": f"""WITH p AS (SELECT c_custkey AS project, n_name AS pack, c_mktsegment AS t, false AS f FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, r_name, c_mktsegment, true FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
      SELECT DISTINCT project, pack, facet FROM p JOIN (SELECT * FROM {_FACETS}) ON (needs IS NULL OR needs = t) WHERE NOT f OR facet IN {tuple(HINTS)}""",
    "c2_mark_primary": f"SELECT id, url, ({_IS}) AS \"primary\" FROM (SELECT page_id AS id, url, {_PRIMARY} FROM pages)",
    "c3_build_obligations": f"WITH {_RAW} SELECT * FROM r",
    "c4_trap_gate": "WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events GROUP BY ALL HAVING count(*) FILTER (event_type = 'error') >= 2) SELECT event_id, CASE WHEN b.user_id IS NOT NULL THEN 'fabrication_suspected' END AS exclusion FROM events e LEFT JOIN b ON e.user_id = b.user_id AND CAST(ts AS DATE) = day",
    "c5_apply_verification": f"""WITH d AS (SELECT doc_id AS id, (doc_id % 11) / 10 AS c, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
      SELECT id, {_STATE} AS verification, round(CASE WHEN toxic = 1 THEN c WHEN quality = 1 THEN least(1.0, c + 0.1) WHEN quality = 0 THEN greatest(0.0, c - 0.15) ELSE c END, 6) AS confidence, coalesce(toxic <> 1 AND quality = 1, false) AS keeps_penalty FROM d""",
    "c6_verify_quotes": f"""WITH q AS (SELECT item_id, quote, list_filter(string_split(quote, ' '), lambda x: length(x) > 3) AS w FROM (SELECT item_id, {_COLLAPSE} AS quote FROM benchmark)),
      r AS (SELECT item_id, quote, CASE WHEN len(w) >= 6 THEN array_to_string(w[3:8], ' ') ELSE quote END AS run FROM q), d AS (SELECT {_COLLAPSE} AS body FROM documents)
      SELECT item_id, CASE WHEN length(any_value(quote)) >= 24 THEN count(body) END AS n_sources FROM r LEFT JOIN d ON contains(body, quote) OR contains(body, run) GROUP BY item_id""",
    "c7_merge_obligations": "SELECT sha256(lower(trim(text))) AS key, count(*) AS n, min(doc_id) AS first_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS facets, max((doc_id % 10) / 10) AS confidence FROM documents GROUP BY 1",
    "c8_flag_stale": "SELECT CASE WHEN o_orderkey % 9 = 0 THEN true ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') > 365 END AS stale, count(*) AS n FROM orders GROUP BY 1",
    "c9_corpus_changes": "WITH p AS (SELECT doc_id AS id, text FROM documents), c AS (SELECT CASE WHEN doc_id % 5 = 0 THEN -doc_id - 1 ELSE doc_id END AS id, text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END AS text FROM documents) SELECT id, CASE WHEN p.text IS NULL THEN 'new' WHEN c.text IS NULL THEN 'removed' WHEN p.text = c.text THEN 'unchanged' ELSE 'changed' END AS status FROM p FULL JOIN c USING (id)",
    "c10_exclusion_summary": f"WITH {_RAW} SELECT reason, count(*) AS n, min(id) AS first_id FROM r WHERE reason IS NOT NULL GROUP BY 1",
    "c11_citation_inventory": f"SELECT host, count(*) AS n, count(*) FILTER ({_IS}) AS n_primary FROM (SELECT {_PRIMARY} FROM pages) GROUP BY host",
    "c12_region_summary": f"SELECT source AS region, count(*) AS n, count(*) FILTER ({_STATE} = 'double_sourced') AS double_sourced, count(*) FILTER ({_STATE} = 'disputed') AS disputed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "c13_pack_coverage": """WITH p AS (SELECT p_brand AS pack, count(*) AS n, list(DISTINCT string_split(p_type, ' ')[1]) AS f FROM part GROUP BY 1), k AS (SELECT ['PROMO', 'STANDARD', 'SMALL', 'MEDIUM', 'ECONOMY', 'LARGE'] AS k)
      SELECT pack, n, len(list_intersect(f, k)) AS covered, array_to_string(list_sort(list_filter(k, lambda x: NOT list_contains(f, x))), ',') AS missing FROM p, k""",
}
