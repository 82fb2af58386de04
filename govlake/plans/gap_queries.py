"""Gap and return-on-investment operators over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlake.operators import detect as d
from govlake.operators import gaps as g
from govlake.operators import roi as v
from govlake.plans.tables import ASSETS, RANK_SQL, SUPPRESSED_SQL, assets, hits_sql, rows, sql_values, table

BANDS = [("gaps", 1.0, 2.5, 1.0, "survey"), ("critical", 4.0, 9.0, 2.0, None)]
RATES = [("lawyer", 120.0, 300.0), ("consultant", 90.0, 220.0)]
DEFAULTS = [("hours", "survey"), ("rate", None), ("days", "n/a"), ("n/a", None)]
_SEV = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "low"}


def _orders(s, sf):
    """orders as gaps: severity by priority, region by customer, a cited maximum for finished ones."""
    sev = F.coalesce(F.create_map(*[F.lit(x) for kv in _SEV.items() for x in kv])[F.col("o_orderpriority")], F.lit("info"))
    o, cust = table(s, sf, "orders"), table(s, sf, "customer")
    j = o.join(cust, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(s, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project"), F.col("n_name").alias("region"), sev.alias("severity"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("maximum"), F.lit("EUR").alias("currency"), (F.col("o_orderkey") % 17).alias("file"), (F.col("o_orderstatus") == "O").alias("pre_launch"))


def _events(s, sf):
    sev = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").otherwise("medium")
    return table(s, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("run"), sev.alias("severity"))


def _hits(s, sf):
    a = assets(s, sf)
    return d.suppress_hits(d.hits(a)).join(a.select("path", "project"), "path")


def _evidence(s, sf):
    n = lambda c: F.count_if(c)
    return assets(s, sf).groupBy("project").agg(n(F.col("content").contains("@")).alias("n_personal"), n(F.col("content").contains("with")).alias("n_vendor"), n(F.col("content").contains("reserved")).alias("n_deletion"), n(F.col("content").contains("health")).alias("n_special"), n(F.col("content").contains("model")).alias("n_ai"), n(F.col("content").contains("http")).alias("n_plain"))


def _claims(s, sf):
    has = lambda w: F.max(F.col("content").contains(w))
    return assets(s, sf).groupBy("project").agg(has("und").alias("no_personal"), has("dans").alias("no_vendor"), has("the").alias("deletable"), has("que").alias("no_sensitive"), has("for").alias("no_ai"), has("with").alias("encrypted"))


def _adversary(s, sf):
    e = table(s, sf, "events")
    adv = e.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.array(F.col("event_id") - 1, F.col("event_id") + 7).alias("anchors"), F.col("user_id").alias("file"), F.when(F.col("event_id") % 2 == 0, "critical").otherwise("low").alias("severity"))
    return adv, e.where("event_type = 'signup' and user_id % 3 = 0").select(F.col("event_id").alias("eid"), F.col("user_id").alias("file"))


def _answers(s, sf):
    status = F.when(F.col("toxic") == 1, "unsatisfied").when(F.col("quality") == 1, "satisfied").otherwise("partial")
    return table(s, sf, "labels").select(F.col("doc_id").alias("id"), status.alias("status"), (F.col("doc_id") % 14 / 10 - 0.1).alias("confidence"))


def _obligations(s, sf):
    return table(s, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 1, "low").when(F.col("doc_id") % 5 == 2, "grave").alias("given"), (F.col("doc_id") % 4 == 0).alias("criminal"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("maximum"))


def _nodes(s, sf):
    p = table(s, sf, "part").select(F.col("p_partkey").alias("id"))
    edges = p.select("id", F.floor(F.col("id") / 2).alias("needs")).unionByName(s.createDataFrame([(11, 13), (13, 17), (17, 11)], "id long, needs long"))
    return p, edges


def _counts(s, sf):
    o = _orders(s, sf).groupBy("project").agg(F.count("*").alias("gaps"), F.count_if(F.col("severity") == "critical").alias("critical"))
    return o.select("project", F.explode(F.array(F.struct(F.lit("gaps").alias("key"), F.col("gaps").alias("n")), F.struct(F.lit("critical").alias("key"), F.col("critical").alias("n")))).alias("x")).select("project", "x.*")


def _ranges(s, sf):
    return v.traced_ranges(_counts(s, sf), rows(s, BANDS, "key string, low double, high double, divisor double, source string"), "project")


def _alternatives(s, sf):
    who = table(s, sf, "customer").select(F.col("c_custkey").alias("project"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "student").otherwise("firm").alias("profile"))
    totals = _ranges(s, sf).where("key = 'total'").join(who, "project")
    return v.alternatives(totals, rows(s, RATES, "alternative string, rate_low double, rate_high double"), "project")


def _spend(s, sf):
    e = table(s, sf, "events").select(F.col("user_id").alias("run_id"), "ts", F.col("value").alias("cost"), (F.col("event_type") == "purchase").alias("reported"))
    return v.spend_vs_value(e, _ranges(s, sf).where("key = 'total'").select(F.col("project").alias("run_id"), F.col("low").alias("hours_low"), F.col("high").alias("hours_high")))


def _merging(s, sf):
    """documents as gaps with evidence, edges between them, and the merged gaps."""
    d = table(s, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project"), "text", F.when(F.col("doc_id") % 3 == 0, "high").otherwise("low").alias("severity"), F.array("lang", (F.col("n_chars") % 100).cast("string")).alias("evidence"))
    key = F.sha2(F.lower(F.trim("text")), 256)
    return d, d.select("project", "id", (F.col("id") - 1).alias("needs")).unionByName(d.select("project", "id", F.floor(F.col("id") / 2).alias("needs"))), g.merge_gaps(d, key), key


def _evidence_of_merged(s, sf):
    d, _, merged, key = _merging(s, sf)
    return g.merged_evidence(d, merged, key)


def _needs_of_merged(s, sf):
    return g.merged_dependencies(*_merging(s, sf))


def _prose(s, sf):
    """documents as gaps: each sentence a part."""
    p = F.split("text", "[.]")
    parts = {n: F.get(p, F.lit(i)) for i, n in enumerate(("what", "legal", "engineering", "residual", "if_unfixed", "if_fixed"))}
    lists = {"how": F.filter(p, lambda x: F.length(x) >= 50), "citations": F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), "prompt": F.col("text")}
    return table(s, sf, "documents").select("doc_id", *[c.alias(n) for n, c in (parts | lists).items()])


def _related(s, sf):
    return table(s, sf, "events").select((F.col("event_id") % 997).alias("id"), F.when(F.col("event_type") == "error", "critical").otherwise("low").alias("severity"))


def _checks():
    text = F.col("text")
    low = F.lower(text)
    return {
        "short": F.length(text) < 200,
        "no_link": ~text.contains("http"),
        "no_number": ~text.rlike("[0-9]"),
        "one_line": ~text.contains("\n"),
        "vague": low.rlike("improve|consider|ensure") & ~low.rlike("table|column|file"),
        "dangling": low.rlike("see above|the report"),
    }


QUERIES = {
    "g1_derive_profile": lambda s, sf: g.derive_profile(_hits(s, sf), assets(s, sf)),
    "g2_contradictions": lambda s, sf: g.contradictions(_claims(s, sf), _evidence(s, sf)),
    "g3_evidence_digest": lambda s, sf: g.evidence_digest(table(s, sf, "events"), "event_type", "event_id"),
    "g4_reconcile": lambda s, sf: g.reconcile(*_adversary(s, sf)),
    "g5_complete_adjudications": lambda s, sf: g.complete_adjudications(_obligations(s, sf), _answers(s, sf)),
    "g6_build_gaps": lambda s, sf: g.build_gaps(g.complete_adjudications(_obligations(s, sf), _answers(s, sf)), _obligations(s, sf), _related(s, sf)),
    "g7_gap_checks": lambda s, sf: g.validate_gaps(_prose(s, sf), g.gap_checks(), "doc_id"),
    "g8_merged_evidence": _evidence_of_merged,
    "g8_merged_dependencies": _needs_of_merged,
    "g7_validate_gaps": lambda s, sf: g.validate_gaps(table(s, sf, "documents"), _checks(), "doc_id"),
    "g8_merge_gaps": lambda s, sf: g.merge_gaps(table(s, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project"), "text", F.when(F.col("doc_id") % 3 == 0, "high").otherwise("low").alias("severity")), F.sha2(F.lower(F.trim("text")), 256)),
    "g9_remediation_order": lambda s, sf: g.remediation_order(*_nodes(s, sf)),
    "g10_commit_batches": lambda s, sf: g.commit_batches(table(s, sf, "documents").withColumn("severity", F.when(F.col("doc_id") % 50 == 0, "critical").otherwise("low")), F.col("text")),
    "g11_exposure_ledger": lambda s, sf: g.exposure_ledger(_orders(s, sf)),
    "g12_filter_gaps": lambda s, sf: g.filter_gaps(_orders(s, sf), "high", "NATION_3", _orders(s, sf).where("id % 4 = 0").select("id")),
    "g13_diff_runs": lambda s, sf: g.diff_runs(_events(s, sf).where("run < date '2024-01-08'"), _events(s, sf).where("run >= date '2024-01-08' and run < date '2024-01-15'"), ["user_id", "event_type"]),
    "g14_ci_gate": lambda s, sf: g.ci_gate(_events(s, sf), _events(s, sf).where("event_id % 3 = 0").select("user_id", "event_type").distinct(), ["user_id", "event_type"], "high", "user_id"),
    "g15_trend": lambda s, sf: g.trend(_events(s, sf), "run"),
    "g16_share_counts": lambda s, sf: g.share_counts(_orders(s, sf), "project", "k"),
    "g17_top_gaps": lambda s, sf: g.top_gaps(_orders(s, sf), "project", ["id"]).select("project", "id", "severity", "nth"),
    "v1_roi_counts": lambda s, sf: v.roi_counts(_orders(s, sf), "project"),
    "v2_traced_ranges": _ranges,
    "v3_alternatives": _alternatives,
    "v4_cited_exposure": lambda s, sf: v.cited_exposure(_orders(s, sf).withColumn("url", F.when(F.col("id") % 5 > 0, "https://x.org").otherwise("ftp://x.org")), "project"),
    "v5_retrofit": lambda s, sf: v.retrofit(_orders(s, sf).join(table(s, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("days")), "id"), "project"),
    "v6_spend_vs_value": _spend,
    "v7_unsourced_assumptions": lambda s, sf: v.unsourced_assumptions(rows(s, DEFAULTS, "key string, source string"), table(s, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("project"), F.lit("rate").alias("key"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).alias("source")), table(s, sf, "supplier").select(F.col("s_suppkey").alias("project"))),
}

_S = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in _SEV.items()) + " ELSE 'info' END"
_O = f"o AS (SELECT o_orderkey AS id, o_custkey AS project, n_name AS region, {_S} AS severity, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS maximum, 'EUR' AS currency, o_orderkey % 17 AS file, o_orderstatus = 'O' AS pre_launch FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_E = "e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS run, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' ELSE 'medium' END AS severity FROM events)"
_OB = "b AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 1 THEN 'low' WHEN doc_id % 5 = 2 THEN 'grave' END AS given, doc_id % 4 = 0 AS criminal, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS maximum FROM documents)"
_AD = "j AS (SELECT b.id, CASE WHEN l.doc_id IS NULL THEN 'indeterminate' WHEN toxic = 1 THEN 'unsatisfied' WHEN quality = 1 THEN 'satisfied' ELSE 'partial' END AS status, CASE WHEN l.doc_id IS NULL THEN 0 ELSE least(1.0, greatest(0.0, (l.doc_id % 14) / 10 - 0.1)) END AS confidence FROM b LEFT JOIN labels l ON l.doc_id = b.id)"
_R = f"{_O}, n AS (SELECT project, count(*) AS gaps, count(*) FILTER (severity = 'critical') AS critical FROM o GROUP BY project), c AS (SELECT project, 'gaps' AS key, gaps AS n FROM n UNION ALL SELECT project, 'critical', critical FROM n), r AS (SELECT project, key, n * low / divisor AS low, n * high / divisor AS high, source IS NULL AS unsourced FROM c JOIN (SELECT * FROM {sql_values(BANDS, 'key, low, high, divisor, source')}) USING (key)), t AS (SELECT project, 'total' AS key, sum(low) AS low, sum(high) AS high, bool_or(unsourced) AS unsourced FROM r GROUP BY project)"
_CHECKS = {"short": "length(text) < 200", "no_link": "NOT contains(text, 'http')", "no_number": "NOT regexp_matches(text, '[0-9]')", "one_line": "NOT contains(text, chr(10))", "vague": "regexp_matches(lower(text), 'improve|consider|ensure') AND NOT regexp_matches(lower(text), 'table|column|file')", "dangling": "regexp_matches(lower(text), 'see above|the report')"}

_ELEVEN = ", ".join(
    f"CASE WHEN {q} THEN '{n}' END"
    for n, q in {
        "what_short": "length(p[1]) < 20",
        "what_vague": f"length(p[1]) >= 20 AND regexp_matches(w, '^(?:{g.VAGUE})\\b') AND NOT regexp_matches(w, '[./_]|\\b(?:{g.CONCRETE})\\b')",
        "legal": "coalesce(length(p[2]), 0) < 10",
        "engineering": "coalesce(length(p[3]), 0) < 10",
        "citations": "NOT regexp_matches(text, '[0-9]')",
        "how": "len(list_filter(p, lambda x: length(x) >= 50)) = 0",
        "residual": "coalesce(trim(p[4]), '') = ''",
        "if_unfixed": "coalesce(length(p[5]), 0) < 20",
        "if_fixed": "coalesce(length(p[6]), 0) < 10",
        "prompt_short": "length(text) < 200",
        "prompt_dangling": f"regexp_matches(lower(text), '{g.LEANING}')",
    }.items()
)
_MERGED = "d AS (SELECT doc_id AS id, source AS project, sha256(lower(trim(text))) AS key, lang, n_chars FROM documents), m AS (SELECT project, key, min(id) AS first_id, min(CASE WHEN id % 3 = 0 THEN 1 ELSE 3 END) AS rank FROM d GROUP BY 1, 2), o AS (SELECT project, key, 'GAP-' || lpad(CAST(row_number() OVER (PARTITION BY project ORDER BY rank, first_id) AS VARCHAR), 6, '0') AS gap FROM m), i AS (SELECT d.*, gap FROM d JOIN o USING (project, key))"

SQL = {
    "g1_derive_profile": f"""WITH {ASSETS}, h AS ({hits_sql(key='path, project')}), k AS (SELECT project, array_to_string(list_sort(list(DISTINCT rule)), ',') AS categories, count(*) AS n_hits FROM h WHERE NOT ({SUPPRESSED_SQL}) GROUP BY project)
      SELECT project, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages, coalesce(any_value(categories), '') AS categories, coalesce(any_value(n_hits), 0) AS n_hits FROM a LEFT JOIN k USING (project) GROUP BY project""",
    "g2_contradictions": f"""WITH {ASSETS}, x AS (SELECT project, bool_or(contains(content, 'und')) AS a1, bool_or(contains(content, 'dans')) AS a2, bool_or(contains(content, 'the')) AS a3, count(*) FILTER (contains(content, '@')) AS p, count(*) FILTER (contains(content, 'with')) AS v, count(*) FILTER (contains(content, 'reserved')) AS e, bool_or(contains(content, 'que')) AS a4, bool_or(contains(content, 'for')) AS a5, bool_or(contains(content, 'with')) AS a6,
      count(*) FILTER (contains(content, 'health')) AS h, count(*) FILTER (contains(content, 'model')) AS ai, count(*) FILTER (contains(content, 'http')) AS pl FROM a GROUP BY project)
      SELECT project, 'no_personal' AS claim, p AS n, true AS blocking FROM x WHERE a1 AND p > 0 UNION ALL SELECT project, 'no_vendor', v, false FROM x WHERE a2 AND v > 0 UNION ALL SELECT project, 'deletable', e, false FROM x WHERE a3 AND e = 0
      UNION ALL SELECT project, 'no_sensitive', h, true FROM x WHERE a4 AND h > 0 UNION ALL SELECT project, 'no_ai', ai, true FROM x WHERE a5 AND ai > 0 UNION ALL SELECT project, 'encrypted', pl, false FROM x WHERE a6 AND pl > 0""",
    "g3_evidence_digest": "SELECT event_type, event_id, nth, n, greatest(n - 40, 0) AS overflow FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE nth <= 40",
    "g4_reconcile": """WITH a AS (SELECT * FROM events WHERE event_type = 'error'), s AS (SELECT * FROM events WHERE event_type = 'signup' AND user_id % 3 = 0),
      m AS (SELECT a.event_id AS id, count(DISTINCT s.event_id) AS n FROM a JOIN s ON s.event_id IN (a.event_id - 1, a.event_id + 7) OR s.user_id = a.user_id GROUP BY 1)
      SELECT event_id AS id, coalesce(n, 0) AS n_anchors, CASE WHEN n > 0 THEN 'confirmed' ELSE 'unconfirmed' END AS status, CASE WHEN event_id % 2 <> 0 THEN 'low' WHEN n > 0 THEN 'critical' ELSE 'high' END AS severity FROM a LEFT JOIN m ON id = event_id""",
    "g5_complete_adjudications": f"WITH {_OB}, {_AD} SELECT * FROM j",
    "g6_build_gaps": f"""WITH {_OB}, {_AD}, c AS (SELECT DISTINCT event_id % 997 AS r FROM events WHERE event_type = 'error') SELECT id, CASE WHEN given = 'low' THEN 'low' WHEN criminal OR r IS NOT NULL THEN 'critical' WHEN maximum IS NOT NULL THEN 'high' ELSE 'medium' END AS severity,
      concat_ws(',', CASE WHEN given = 'low' THEN 'given' END, CASE WHEN r IS NOT NULL THEN 'adversary' END, CASE WHEN criminal THEN 'criminal' END, CASE WHEN maximum IS NOT NULL THEN 'maximum' END) AS basis, CAST(maximum AS DECIMAL(18,2)) AS maximum FROM j JOIN b USING (id) LEFT JOIN c ON r = id WHERE status IN ('partial', 'unsatisfied')""",
    "g7_validate_gaps": "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {q} THEN '{n}' END" for n, q in _CHECKS.items()) + ") AS problems, " + " + ".join(f"CAST({q} AS INT)" for q in _CHECKS.values()) + " AS n FROM documents",
    "g8_merge_gaps": "WITH m AS (SELECT source AS project, sha256(lower(trim(text))) AS key, min(doc_id) AS first_id, count(*) AS n, min(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 3 END) AS rank FROM documents GROUP BY 1, 2) SELECT *, 'GAP-' || lpad(CAST(row_number() OVER (PARTITION BY project ORDER BY rank, first_id) AS VARCHAR), 6, '0') AS gap FROM m",
    "g7_gap_checks": f"""WITH p AS (SELECT doc_id, text, string_split(text, '.') AS p, lower(string_split(text, '.')[1]) AS w FROM documents),
      c AS (SELECT doc_id, [{_ELEVEN}] AS c FROM p), d AS (SELECT doc_id, list_filter(c, lambda x: x IS NOT NULL) AS c FROM c) SELECT doc_id, array_to_string(c, ',') AS problems, len(c) AS n FROM d""",
    "g8_merged_evidence": f"WITH {_MERGED} SELECT DISTINCT project, gap, unnest([lang, CAST(n_chars % 100 AS VARCHAR)]) AS evidence FROM i",
    "g8_merged_dependencies": f"WITH {_MERGED}, e AS (SELECT project, id, id - 1 AS needs FROM i UNION ALL SELECT project, id, id // 2 FROM i) SELECT DISTINCT e.project, a.gap, b.gap AS needs FROM e JOIN i a ON a.project = e.project AND a.id = e.id JOIN i b ON b.project = e.project AND b.id = e.needs WHERE a.gap <> b.gap",
    "g9_remediation_order": """WITH RECURSIVE c AS (SELECT count(*) AS c FROM part), p AS (SELECT p_partkey AS id, p_partkey // 2 AS needs FROM part UNION SELECT * FROM (VALUES (11, 13), (13, 17), (17, 11))),
      e AS (SELECT DISTINCT id, needs FROM p WHERE id <> needs AND id IN (SELECT p_partkey FROM part) AND needs IN (SELECT p_partkey FROM part)),
      w AS (SELECT id, needs AS at, 1 AS n FROM e UNION SELECT w.id, e.needs, n + 1 FROM w JOIN e ON e.id = w.at WHERE n < (SELECT c FROM c))
      SELECT p_partkey AS id, CASE WHEN coalesce(max(n), 0) < any_value(c) THEN coalesce(max(n), 0) END AS level FROM part CROSS JOIN c LEFT JOIN w ON w.id = p_partkey GROUP BY 1""",
    "g10_commit_batches": "SELECT CASE WHEN doc_id % 50 = 0 THEN 'critical' WHEN regexp_matches(lower(text), 'schema|table|column') THEN 'schema' WHEN regexp_matches(lower(text), 'token|secret|key') THEN 'security' WHEN regexp_matches(lower(text), 'licen[cs]e|rights|copyright') THEN 'documentation' ELSE 'other' END AS batch, count(*) AS n FROM documents GROUP BY 1",
    "g11_exposure_ledger": f"WITH {_O} SELECT region, currency, CASE WHEN maximum IS NOT NULL THEN 'quantified' WHEN severity IN ('critical', 'high') THEN 'qualitative' ELSE 'unknown' END AS bucket, count(*) AS n, max(maximum) AS highest FROM o GROUP BY 1, 2, 3",
    "g12_filter_gaps": f"WITH {_O} SELECT * FROM o WHERE severity IN ('critical', 'high') AND region = 'NATION_3' AND id % 4 <> 0",
    "g13_diff_runs": f"WITH {_E}, a AS (SELECT DISTINCT user_id, event_type FROM e WHERE run < DATE '2024-01-08'), b AS (SELECT DISTINCT user_id, event_type FROM e WHERE run >= DATE '2024-01-08' AND run < DATE '2024-01-15') SELECT *, 'opened' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'closed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
    "g14_ci_gate": f"WITH {_E}, b AS (SELECT DISTINCT user_id, event_type FROM e WHERE event_id % 3 = 0), x AS (SELECT user_id, count(*) AS n FROM e WHERE severity IN ('critical', 'high') AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM b) GROUP BY 1) SELECT DISTINCT e.user_id, coalesce(n, 0) AS n_new, n IS NULL AS passes FROM e LEFT JOIN x USING (user_id)",
    "g15_trend": f"WITH {_E}, c AS (SELECT run, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM e GROUP BY run ORDER BY run DESC LIMIT 8) SELECT *, n - lag(n) OVER (ORDER BY run) AS delta FROM c",
    "g16_share_counts": f"WITH {_O} SELECT sha256('k:' || project) AS signature, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM o GROUP BY 1",
    "g17_top_gaps": f"WITH {_O} SELECT project, id, severity, row_number() OVER (PARTITION BY project ORDER BY {RANK_SQL.format(c='severity')}, id) AS nth FROM o QUALIFY nth <= 3",
    "v1_roi_counts": f"WITH {_O} SELECT project, count(*) AS gaps, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(DISTINCT file) AS files FROM o GROUP BY 1",
    "v2_traced_ranges": f"WITH {_R} SELECT project, key, round(low, 4) AS low, round(high, 4) AS high, unsourced FROM (SELECT * FROM r UNION ALL SELECT * FROM t)",
    "v3_alternatives": f"WITH {_R} SELECT project, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN round(round(low, 4) * 90, 2) END AS money_low, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN round(round(high, 4) * 300, 2) END AS money_high FROM t JOIN customer ON project = c_custkey",
    "v4_cited_exposure": f"WITH {_O} SELECT project, count(maximum) AS cited, count(*) - count(maximum) AS unquantified, count(maximum) FILTER (id % 5 = 0) AS violations FROM o GROUP BY 1",
    "v5_retrofit": f"WITH {_O} SELECT project, count(*) AS gaps, round(sum(l_quantity), 2) AS days_now, round(sum(l_quantity) * 2, 2) AS days_low, round(sum(l_quantity) * 6, 2) AS days_high FROM o JOIN lineitem ON l_orderkey = id WHERE pre_launch GROUP BY 1",
    "v6_spend_vs_value": f"WITH {_R}, s AS (SELECT user_id AS run_id, round(sum(value), 4) AS cost, round((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 60000, 1) AS minutes, bool_or(event_type = 'purchase') AS reported FROM events GROUP BY 1) SELECT run_id, cost, minutes, reported, round(low, 4) AS hours_low, round(high, 4) AS hours_high FROM s LEFT JOIN t ON project = run_id",
    "v7_unsourced_assumptions": "SELECT 'rate' AS key, count(*) AS projects FROM supplier WHERE NOT (s_suppkey % 4 = 0) HAVING count(*) > 0",
}
