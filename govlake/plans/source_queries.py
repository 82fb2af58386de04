"""Sources, exports and streams over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlake.functions.folders import work_folder
from govlake.operators import detect as d
from govlake.plans.ledger_queries import CAPS, RUN_PHASES
from govlake.plans.ledger_queries import SQL as LEDGER_SQL
from govlake.plans.redact_queries import GLOBS, HOSTS, bound_to_files
from govlake.plans.redact_queries import _DENY as DENY_SQL
from govlake.plans.redact_queries import _HOSTS as HOSTS_SQL
from govlake.plans.tables import ASSETS, SUPPRESSED_SQL, assets, hits_sql, table
from govlake.sources import files as f
from govlake.streaming import jobs as t

PHASES = ["click", "view", "signup", "purchase", "error"]


def _stream(s, sf, name):
    """A table as a stream of files. The glob lets it be one file or a folder of them."""
    return s.readStream.schema(table(s, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def _file_tree(s, sf):
    """documents as files, one each, in a source, a vendored and a build folder, some with a NUL, scanned up to 4 KB."""
    root, docs = work_folder(s, "tree"), table(s, sf, "documents")
    text = F.concat("text", F.when(F.col("doc_id") % 12 == 2, F.lit("\0")).otherwise(F.lit("")))
    folder = F.get(F.array(*[F.lit(x) for x in ("src", "node_modules/p", "lib/deep", "dist")]), (F.col("doc_id") % 4).cast("int"))
    f.write_files(docs.select(folder.alias("folder"), text.alias("value")).where("folder is not null"), root)
    return f.scan_files(s, root, max_kb=4).select(F.split("path", "/")[0].alias("folder"), "ext", "size", F.sha2("content", 256).alias("sha256"))


def _scanning(s, sf):
    """Orders as gaps, errors as adversary findings and the hits in documents, by run."""
    gaps = table(s, sf, "orders").select((F.col("o_orderkey") % 3).cast("string").alias("run_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("ob-"), (F.col("o_custkey") % 40).cast("string"))).alias("obligation"), F.when(F.col("o_orderstatus") == "F", "critical").when(F.col("o_orderstatus") == "O", "medium").otherwise("info").alias("severity"), F.when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit("src/f"), (F.col("o_custkey") % 9).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(".ts:"), (F.col("o_orderkey") % 90 + 1).cast("string"))).otherwise(".ts"))).alias("anchor"), F.col("o_orderstatus").alias("fix"))
    adversary = table(s, sf, "events").where("event_type = 'error'").select((F.col("user_id") % 3).cast("string").alias("run_id"), F.col("event_id").alias("id"), F.col("props").alias("title"), F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("category"), F.lit("high").alias("severity"), F.when(F.col("event_id") % 2 == 0, "unconfirmed").otherwise("confirmed").alias("status"), F.concat(F.lit("api/u"), F.col("user_id").cast("string"), F.lit(".py:7-9")).alias("location"))
    found = d.scan_secrets(assets(s, sf)).select(F.lit("0").alias("run_id"), "rule", F.lit("secret").alias("kind"), "severity", "path", "line", "snippet_hash")
    folder = work_folder(s, "scanning")
    f.write_code_scanning(f.code_scanning(gaps, adversary, found), folder)
    return f.read_code_scanning(s, folder)


def _results(s, sf):
    r = _scanning(s, sf).where("result is not null").select("run_id", "result.*")
    props = F.array_join(F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.concat_ws("=", e.key, e.value))), ",")
    place = F.col("locations")[0]["physical"]
    return r.select("run_id", F.col("ruleId").alias("rule_id"), "level", place["artifact"].alias("uri"), place["region"]["start"].alias("line"), F.col("fingerprints.id").alias("fingerprint"), F.col("message.text").alias("message"), props.alias("properties"))


def _rules(s, sf):
    return _scanning(s, sf).where("rule is not null").select("run_id", "rule.*")


def _ledger(s, sf):
    path = work_folder(s, "ledger")
    rows = table(s, sf, "events").select("event_id", "user_id", "event_type", "value")
    f.append_ledger(rows.where("event_id % 2 = 0"), path)
    f.append_ledger(rows.where("event_id % 2 = 1"), path)
    return f.read_ledger(s, path, "event_id long, user_id long, event_type string, value double")


def _latest(s, sf):
    e = table(s, sf, "events")
    journal = e.select((F.col("user_id") % 7).alias("project"), F.col("event_id").alias("run_id"), F.lit(6).alias("phase"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("event"), "ts")
    return f.latest_run(journal, e.where("event_id % 3 = 0").select(F.col("event_id").alias("run_id")), "project")


def _changed(s, sf):
    a = assets(s, sf)
    now = a.withColumn("content", F.concat("content", F.when(F.col("doc_id") % 7 == 0, "!").otherwise("")))
    return f.changed_since(a, now.withColumn("path", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))))


def _payload_stream(s, sf):
    text = F.concat(F.lit("["), F.col("role"), F.lit("]\n"), F.col("text"), F.lit("\n"), F.col("head"))
    return bound_to_files(s, sf, _stream(s, sf, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("payload_id"), "path", "url", text.alias("payload"))


def _gate_table(s, sf, name):
    folder = work_folder(s, "gate")
    t.gate_to_tables(_payload_stream(s, sf), folder, GLOBS, HOSTS).awaitTermination()
    return t.gate_table(s, folder, name)


def _call_stream(s, sf):
    return _stream(s, sf, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("run_id"), (F.col("user_id") % 3).alias("seat"), F.col("event_type").alias("phase"), "ts", F.col("value").alias("cost"), (F.col("event_type") == "view").alias("cached"))


def _egress(s, sf):
    return _stream(s, sf, "events").select("ts", F.col("event_type").alias("destination"), F.length("props").alias("bytes"))


def _times(df):
    """df with its times as strings."""
    return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema if f.dataType.simpleString() == "timestamp"})


def _manifests(s, sf):
    """Each part as the manifest of a project: one of four dialects by its number."""
    p = table(s, sf, "part")
    name, version = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0"))
    kind = F.col("p_partkey") % 4
    path = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/"), F.element_at(F.array(*map(F.lit, ("package.json", "requirements.txt", "pyproject.toml", "go.mod"))), (kind + 1).cast("int")))
    bodies = [F.concat(F.lit('{"dependencies": {"'), name, F.lit('": "^'), version, F.lit('"}, "devDependencies": {"jest": ""}}')), F.concat(name, F.lit("=="), version, F.lit("\n# note\nrequests\n")), F.concat(F.lit('[project]\ndependencies = [\n  "'), name, F.lit(">="), version, F.lit('",\n]\n')), F.concat(F.lit("module m\nrequire x.org/"), name, F.lit(" v"), version, F.lit("\n"))]
    return p.select(path.alias("path"), F.when(kind == 0, bodies[0]).when(kind == 1, bodies[1]).when(kind == 2, bodies[2]).otherwise(bodies[3]).alias("content"))


QUERIES = {
    "s1_scan_files": _file_tree,
    "s8_results": _results,
    "s8_rules": _rules,
    "s9_component_inventory": lambda s, sf: f.component_inventory(_manifests(s, sf)),
    "s2_ledger": _ledger,
    "s3_latest_run": _latest,
    "s6_changed_since": _changed,
    "s7_export_manifest": lambda s, sf: f.export_manifest(assets(s, sf)),
    "s8_export_findings": lambda s, sf: f.export_findings(d.scan_pii(assets(s, sf)).unionByName(d.scan_secrets(assets(s, sf)))),
    "t1_stream_gate": lambda s, sf: t.drained(t.stream_gate(_payload_stream(s, sf), GLOBS, HOSTS)),
    "t1_passed": lambda s, sf: _gate_table(s, sf, "passed").select("payload_id", "url", F.sha2("payload", 256).alias("sha256")),
    "t1_quarantine": lambda s, sf: _gate_table(s, sf, "quarantine"),
    "t1_ledger": lambda s, sf: _gate_table(s, sf, "ledger"),
    "t2_stream_budget": lambda s, sf: t.finished(_call_stream(s, sf), lambda x: t.stream_budget(x, CAPS, "stop", RUN_PHASES)).select("call_id", "spent_before", "refused", "warned", "ends"),
    "t3_stream_changes": lambda s, sf: t.finished(_stream(s, sf, "events").select("ts", F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text")), t.stream_changes),
    "t4_run_progress": lambda s, sf: t.run_progress(table(s, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("phase"), F.when(F.col("value") > 40, "done").otherwise("begun").alias("event")), PHASES),
    "t5_egress_windows": lambda s, sf: _times(t.finished(_egress(s, sf), t.egress_windows)),
    "t5_sliding_windows": lambda s, sf: _times(t.finished(_egress(s, sf), lambda x: t.egress_windows(x, "2 hours", slide="30 minutes"))),
    "t5_egress_sessions": lambda s, sf: _times(t.finished(_egress(s, sf), lambda x: t.egress_sessions(x, "20 minutes"))),
    "t6_first_sightings": lambda s, sf: t.drained(t.first_sightings(_stream(s, sf, "events"), ["user_id", "event_type"], "31 days")),
}

_H = f"WITH {ASSETS}, h AS ({hits_sql()}), k AS (SELECT * FROM h WHERE NOT ({SUPPRESSED_SQL}))"
_PAYLOADS = f"{ASSETS}, q AS (SELECT conv_id * 1000 + turn AS payload_id, path, url, '[' || role || ']' || chr(10) || text || chr(10) || content AS payload FROM conversations LEFT JOIN a ON conv_id % (SELECT count(*) FROM documents) = doc_id LEFT JOIN pages ON conv_id % (SELECT count(*) FROM pages) = page_id)"
_GATED = f"h AS ({hits_sql('q', 'payload_id', 'payload')}), k AS (SELECT payload_id, rule, pos, line FROM h WHERE NOT ({SUPPRESSED_SQL})), n AS (SELECT payload_id, count(*) AS n_hits FROM k GROUP BY 1)"
_VERDICT = f"CASE WHEN {DENY_SQL.format(c='path')} IS NOT NULL THEN 'denied_path' WHEN n_hits > 0 THEN 'forbidden_pattern' WHEN lower(regexp_extract(url, '^https://([^/:?#]+)', 1)) NOT IN ({HOSTS_SQL}) THEN 'host_not_pinned' ELSE 'pass' END"
_SCAN = f"""WITH {ASSETS}, h AS ({hits_sql()}), k AS (SELECT * FROM h WHERE kind = 'secret' AND NOT ({SUPPRESSED_SQL})),
      g AS (SELECT CAST(o_orderkey % 3 AS VARCHAR) AS run_id, 'gap/' || CASE WHEN o_orderkey % 5 > 0 THEN 'ob-' || o_custkey % 40 ELSE CAST(o_orderkey AS VARCHAR) END AS rule_id, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE 'note' END AS level,
        CASE WHEN o_orderkey % 7 > 0 THEN 'src/f' || o_custkey % 9 || '.ts' ELSE '.' END AS uri, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 2 = 0 THEN o_orderkey % 90 + 1 ELSE 1 END AS line, CAST(o_orderkey AS VARCHAR) AS fingerprint, o_orderpriority || chr(10) || chr(10) || o_orderstatus AS message,
        concat_ws(',', CASE WHEN o_orderkey % 5 > 0 THEN 'obligation=ob-' || o_custkey % 40 END, 'severity=' || CASE o_orderstatus WHEN 'F' THEN 'critical' WHEN 'O' THEN 'medium' ELSE 'info' END) AS properties FROM orders),
      v AS (SELECT CAST(user_id % 3 AS VARCHAR) AS run_id, 'security/c' || user_id % 5 AS rule_id, 'error' AS level, 'api/u' || user_id || '.py' AS uri, 7 AS line, CAST(event_id AS VARCHAR) AS fingerprint, props || CASE WHEN event_id % 2 = 0 THEN chr(10) || chr(10) || '(Unconfirmed: no local evidence anchor.)' ELSE '' END AS message,
        'severity=high,status=' || CASE WHEN event_id % 2 = 0 THEN 'unconfirmed' ELSE 'confirmed' END AS properties FROM events WHERE event_type = 'error'),
      e AS (SELECT '0' AS run_id, 'evidence/' || rule AS rule_id, 'error' AS level, path AS uri, line, left(sha256(path || ':' || rule || ':' || pos), 12) AS fingerprint, rule AS message, 'kind=secret,severity=' || severity AS properties FROM k),
      r AS (SELECT * FROM g UNION ALL SELECT * FROM v UNION ALL SELECT * FROM e)"""
SQL = {
    "s1_scan_files": "WITH d AS (SELECT doc_id, text || chr(10) AS content FROM documents) SELECT CASE doc_id % 4 WHEN 0 THEN 'src' ELSE 'lib' END AS folder, 'txt' AS ext, strlen(content) AS size, sha256(content) AS sha256 FROM d WHERE doc_id % 4 IN (0, 2) AND strlen(content) <= 4096 AND doc_id % 12 <> 2",
    "s8_results": f"{_SCAN} SELECT * FROM r",
    "s8_rules": f"{_SCAN} SELECT run_id, rule_id AS id, left(min(message), 80) AS name, min(level) AS level FROM r GROUP BY run_id, rule_id",
    "s9_component_inventory": """WITH p AS (SELECT 'p' || p_partkey || '/' || ['package.json', 'requirements.txt', 'pyproject.toml', 'go.mod'][p_partkey % 4 + 1] AS path, p_partkey % 4 AS k, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS n, '1.' || p_size || '.0' AS version FROM part),
      c AS (SELECT path, ['npm', 'pypi', 'pypi', 'go'][k + 1] AS ecosystem, CASE WHEN k = 3 THEN 'x.org/' ELSE '' END || n AS name, version FROM p UNION ALL SELECT path, 'npm', 'jest', '*' FROM p WHERE k = 0 UNION ALL SELECT path, 'pypi', 'requests', '*' FROM p WHERE k = 1)
      SELECT *, 'pkg:' || ecosystem || '/' || name || '@' || version AS purl FROM c""",
    "s2_ledger": "SELECT event_id, user_id, event_type, value FROM events",
    "s3_latest_run": "SELECT user_id % 7 AS project, event_id AS run_id, ts FROM events WHERE event_type <> 'error' AND event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts DESC, event_id DESC) = 1",
    "s6_changed_since": f"WITH {ASSETS} SELECT CASE WHEN doc_id % 5 = 0 THEN 'moved/' || path ELSE path END AS path FROM a WHERE doc_id % 5 = 0 OR doc_id % 7 = 0",
    "s7_export_manifest": f"WITH {ASSETS} SELECT path, sha256(content) AS sha256, strlen(content) AS bytes FROM a",
    "s8_export_findings": f"""{_H}, x AS (SELECT 'evidence/' || rule AS rule_id, CASE WHEN kind = 'secret' OR severity = 'critical' THEN 'error' ELSE 'warning' END AS level, path AS uri, line, left(sha256(path || ':' || rule || ':' || pos), 12) AS snippet_hash FROM k
      WHERE rule <> 'phone_e164' OR path IN (SELECT path FROM a WHERE regexp_matches(lower(content), '\\bphone|tel|mobile|msisdn')))
      SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY uri, line, snippet_hash) = 1 AS first FROM x""",
    "t1_stream_gate": f"""WITH {_PAYLOADS}, {_GATED}
      SELECT payload_id, {_VERDICT} AS verdict, coalesce(n_hits, 0) AS n_hits FROM q LEFT JOIN n USING (payload_id)""",
    "t1_passed": f"WITH {_PAYLOADS}, {_GATED} SELECT payload_id, url, sha256(payload) AS sha256 FROM q LEFT JOIN n USING (payload_id) WHERE {_VERDICT} = 'pass'",
    "t1_quarantine": f"WITH {_PAYLOADS}, {_GATED} SELECT payload_id, {_VERDICT} AS verdict, rule, pos, line FROM q LEFT JOIN n USING (payload_id) LEFT JOIN k USING (payload_id) WHERE {_VERDICT} <> 'pass'",
    "t1_ledger": f"WITH {_PAYLOADS}, {_GATED} SELECT payload_id, lower(regexp_extract(url, '^https://([^/:?#]+)', 1)) AS destination, strlen(payload) AS bytes, sha256(payload) AS sha256, path FROM q LEFT JOIN n USING (payload_id) WHERE {_VERDICT} = 'pass'",
    "t2_stream_budget": f"SELECT call_id, spent_before, refused, warned, ends FROM ({LEDGER_SQL['l3_enforce_budget']}) WHERE mode = 'stop'",
    "t3_stream_changes": "WITH l AS (SELECT user_id AS id, event_id AS seq, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT id, seq, CASE WHEN p IS NULL THEN 'NEW' ELSE 'CHANGED' END AS status FROM l WHERE p IS NULL OR p <> event_type",
    "t4_run_progress": "WITH s AS (SELECT user_id AS run_id, list_sort(list(DISTINCT event_type)) AS s FROM events WHERE value > 40 GROUP BY 1) SELECT run_id, array_to_string(s, ',') AS done, list_filter(['click', 'view', 'signup', 'purchase', 'error'], lambda x: NOT list_contains(s, x))[1] AS next FROM s",
    "t5_egress_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS destination, count(*) AS calls, sum(length(props)) AS bytes FROM events GROUP BY 1, 2",
    "t5_sliding_windows": "WITH w AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * unnest(range(4))) AS w FROM events) SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS destination, count(*) AS calls, sum(length(props)) AS bytes FROM w GROUP BY 1, 2",
    "t5_egress_sessions": """WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) >= 1200000000, true) AS cut FROM events), i AS (SELECT *, sum(cut::INT) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
      s AS (SELECT event_type AS destination, min(ts) AS a, max(ts) + INTERVAL 20 MINUTE AS b, count(*) AS calls, sum(length(props)) AS bytes FROM i GROUP BY event_type, n)
      SELECT rtrim(rtrim(strftime(a, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS session_start, rtrim(rtrim(strftime(b, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS session_end, destination, calls, bytes FROM s""",
    "t6_first_sightings": "SELECT DISTINCT user_id, event_type FROM events",
}
