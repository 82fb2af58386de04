"""Detection operators over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlake.functions.rules import ENTROPY_SHAPE, glob_regex
from govlake.operators import detect as d
from govlake.plans.tables import ASSETS, LUHN, REASON_SQL, SUPPRESSED_SQL, assets, hits_sql, quoted, rows, sql_values, table

LEXICON = [(c, s, t, i) for i, (c, s, t) in enumerate([("person", False, "der"), ("person", False, "the"), ("health", True, "therou"), ("health", True, "ione"), ("place", False, "sur"), ("place", False, "with"), ("faith", True, "ofth"), ("faith", True, "ungen"), ("contact", False, "dans"), ("contact", False, "this"), ("money", False, "name"), ("money", True, "acctbal"), ("group", True, "mktsegment"), ("kind", True, "type")])]
SIGNALS = {"consent": "und|avec", "retention": "licen[cs]e", "deletion": "reserved|copyright", "audit": "token", "authentication": "password|token"}
INJECTION = "ignore|disgusting|stupid|idiot"
ADVISORIES = [("Brand#11", "PROMO", "3.2.1", "ADV-1", "high"), ("Brand#12", "PROMO", "2", "ADV-2", "critical")]
SPECS = [("privacy_notice", "**/doc_1*.txt", "high"), ("retention_policy", "**/en/**", "medium"), ("dpia", "**/privacy/**", "high"), ("security_policy", "SECURITY*", "low"), ("german_notice", "**/de/doc_*7.txt", "medium"), ("register", "src1/**", "info")]
SIGNATURES = [("Brand#11", "Next.js"), ("Brand#12", "Supabase"), ("Brand#23", "Django"), ("Brand#35", "Rails"), ("Brand#44", "Flask")]
IGNORED_HOSTS = r"^(localhost|127\.|0\.0\.0\.0|schema\.org|www\.w3\.org)"
SPECIAL = ["card_number", "social_security"]


def _components(spark, sf):
    p = table(spark, sf, "part")
    version = F.concat_ws(".", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string"), (F.col("p_partkey") % 7).cast("string"))
    return p.select(F.col("p_partkey").alias("component"), F.col("p_brand").alias("ecosystem"), F.split("p_type", " ")[0].alias("package"), version.alias("version"))


def _found(spark, sf):
    return d.suppress_hits(d.hits(assets(spark, sf)))


def _misconfig(spark, sf):
    """pages behind one of eight paths and one of thirteen settings."""
    one = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % n + 1).cast("int"))
    path = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("/"), one(MISCONFIG_PATHS, 8))
    return d.scan_misconfig(table(spark, sf, "pages").select(path.alias("path"), F.concat(one(MISCONFIG_TEXTS, 13), F.lit("\n"), "html").alias("content")))


def _with_examples(spark, sf):
    """Assets with a documentation address, an environment reference, a placeholder or a sender that takes no reply behind their text."""
    a, k = assets(spark, sf), F.col("doc_id") % 5
    more = F.when(k == 0, F.concat(F.lit(" u"), F.col("doc_id").cast("string"), F.lit("@example.com"))).when(k == 1, ' token = "process.env.TOKEN_OF_APP"').when(k == 2, ' secret: "YOUR_SECRET_STANDS_HERE"').when(k == 3, " noreply@corp.org").otherwise("")
    return a.withColumn("content", F.concat("content", more))


MISCONFIG_PATHS = ("web/p.tsx", "web/api/p.ts", "Dockerfile", "x/.github/workflows/a.yml", "next.config.js", "cfg.py", "a.test.py", "infra/main.tf")
MISCONFIG_TEXTS = ("x", "const k = process.env.SERVICE_ROLE_KEY", "NEXT_PUBLIC_ADMIN_TOKEN=1", "res.set('Access-Control-Allow-Origin', '*')", "cors({ origin: true })", "acl = \"public-read\"", "public_access_block = false", "uses: actions/checkout@v4", "USER redis", "USER root", "DEBUG = True", "requests.get(u, verify=False)", "Content-Security-Policy Strict-Transport-Security")


QUERIES = {
    "d16_schema_protection": lambda s, sf: d.schema_protection(table(s, sf, "part").select(F.concat(F.lit("db/"), F.col("p_partkey").cast("string"), F.lit(".sql")).alias("path"), F.concat(F.lit("CREATE TABLE t"), F.col("p_partkey").cast("string"), F.lit(" (x int);"), F.when(F.col("p_size") % 3 > 0, "\nALTER TABLE t ENABLE  ROW LEVEL SECURITY;").otherwise(""), F.when(F.col("p_size") % 3 == 2, "\ncreate policy p;").otherwise("")).alias("content"))),
    "d1_scan_secrets": lambda s, sf: d.scan_secrets(assets(s, sf)),
    "d2_scan_pii": lambda s, sf: d.scan_pii(assets(s, sf)),
    "d3_scan_cards": lambda s, sf: d.scan_cards(assets(s, sf)),
    "d4_scan_entropy": lambda s, sf: d.scan_entropy(assets(s, sf)),
    "d5_suppress_hits": lambda s, sf: d.suppressed_counts(d.hits(_with_examples(s, sf))),
    "d6_context_gate": lambda s, sf: d.context_gate(_found(s, sf), assets(s, sf), words="the|und").groupBy("rule").agg(F.count("*").alias("n")),
    "d7_locate_hits": lambda s, sf: d.locate_hits(_found(s, sf)),
    "d8_dedupe_history": lambda s, sf: d.dedupe_history(assets(s, sf), ["lang", "project"], "doc_id"),
    "d9_classify_symbols": lambda s, sf: d.classify_symbols(assets(s, sf), F.broadcast(rows(s, LEXICON, "category string, special boolean, term string, ord int"))),
    "d10_classify_columns": lambda s, sf: d.classify_columns(d.catalog_columns({t: table(s, sf, t) for t in ("customer", "supplier", "part", "orders", "nation", "documents")}), rows(s, LEXICON, "category string, special boolean, term string, ord int")),
    "d11_scan_signals": lambda s, sf: d.scan_signals(assets(s, sf), SIGNALS),
    "d12_pii_in_sink": lambda s, sf: d.pii_in_sink(_found(s, sf), assets(s, sf), "the", SPECIAL),
    "d13_vendor_calls": lambda s, sf: d.vendor_calls(_found(s, sf), assets(s, sf), "with|mit"),
    "d14_outbound_hosts": lambda s, sf: d.outbound_hosts(table(s, sf, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("html")), "page_id", "html", IGNORED_HOSTS),
    "d15_scan_misconfig": _misconfig,
    "d17_injection_lines": lambda s, sf: d.injection_lines(assets(s, sf), INJECTION),
    "d18_dependency_vulns": lambda s, sf: d.dependency_vulns(_components(s, sf), rows(s, ADVISORIES, "ecosystem string, package string, fixed string, advisory string, severity string")),
    "d19_license_classes": lambda s, sf: d.license_classes(assets(s, sf)),
    "d20_artifact_presence": lambda s, sf: d.artifact_presence(assets(s, sf), [(n, glob_regex(g), v) for n, g, v in SPECS]),
    "d21_detect_stack": lambda s, sf: d.detect_stack(table(s, sf, "part").join(table(s, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey"), "p_partkey").select(F.col("l_suppkey").alias("project"), F.col("p_brand").alias("package")), rows(s, SIGNATURES, "package string, framework string")),
    "d22_corpus_profile": lambda s, sf: d.corpus_profile(assets(s, sf)),
    "d23_snapshot_fingerprint": lambda s, sf: d.snapshot_fingerprint(assets(s, sf)),
    "d24_assert_clean": lambda s, sf: d.assert_clean(assets(s, sf).select("path", "content", "project")),
}

H = f"WITH {ASSETS}, h AS ({hits_sql()}), k AS (SELECT * FROM h WHERE NOT ({SUPPRESSED_SQL}))"
_HASH = "left(sha256(path || ':' || rule || ':' || pos), 12) AS snippet_hash"
_PHONE = r"(rule <> 'phone_e164' OR path IN (SELECT path FROM a WHERE regexp_matches(lower(content), '\bphone|tel|mobile|msisdn')))"
_SNAKE = r"lower(regexp_replace(regexp_replace(content, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[-.]', '_', 'g'))"
_PARTS = "(list_concat(list_transform(string_split({c}, '.'), lambda x: CAST(x AS INT)), [0, 0, 0, 0, 0, 0]))[1:6]"
_MORE = """CASE doc_id % 5 WHEN 0 THEN ' u' || doc_id || '@example.com' WHEN 1 THEN ' token = "process.env.TOKEN_OF_APP"' WHEN 2 THEN ' secret: "YOUR_SECRET_STANDS_HERE"' WHEN 3 THEN ' noreply@corp.org' ELSE '' END"""
_EXAMPLES = ASSETS.replace("text AS content", f"text || {_MORE} AS content")
_LEX = sql_values(LEXICON, "category, special, term, ord")

_TEXTS = "[" + ", ".join(quoted(x) for x in MISCONFIG_TEXTS) + "]"
_FOUND = {
    "privileged_key_in_client": r"regexp_matches(content, '\b(NEXT_PUBLIC|VITE|REACT_APP|EXPO_PUBLIC|PUBLIC|GATSBY|NUXT_PUBLIC)_\w*(SERVICE_ROLE|SECRET|ADMIN|PRIVATE)') OR (regexp_matches(path, '(^|/)(app|pages|components|client|public|web)/') AND NOT regexp_matches(path, '(^|/)(api|server|actions)/') AND regexp_matches(content, '(?i:service_role|supabase_service|admin[_-]?key)|SECRET_KEY'))",
    "permissive_cors": f"regexp_matches(content, {quoted(d.setting_pattern('permissive_cors'))}) OR contains(content, 'cors({{ origin: true')",
    "public_bucket": f"regexp_matches(content, {quoted(d.setting_pattern('public_bucket'))}) OR contains(content, 'allUsers')",
    "unpinned_action": r"contains(path, '.github/workflows/') AND len(list_filter(regexp_extract_all(content, 'uses:\s*[\w.-]+/[\w./-]+@(\S+)', 1), lambda x: NOT regexp_full_match(x, '[0-9a-f]{40}'))) > 0",
    "missing_security_headers": r"regexp_matches(path, 'next[.]config|middleware[.](ts|js)|helmet|nginx[.]conf|vercel[.]json') AND NOT (contains(lower(content), 'content-security-policy') AND contains(lower(content), 'strict-transport-security'))",
    "container_runs_as_root": r"regexp_matches(path, '/Dockerfile') AND len(list_filter(regexp_extract_all(content, '(?m)^[ \t]*(USER|user)[ \t]+([^\s:]+)', 2), lambda x: lower(x) NOT IN ('root', '0'))) = 0",
    "debug_enabled": f"regexp_matches(content, {quoted(d.setting_pattern('debug_enabled'))}) AND NOT regexp_matches(path, '[.](test|spec)[.]')",
    "tls_verification_disabled": f"regexp_matches(content, {quoted(d.setting_pattern('tls_verification_disabled'))})",
}
_RULES = "list_filter([" + ", ".join(f"CASE WHEN {q} THEN '{n}' END" for n, q in _FOUND.items()) + "], lambda x: x IS NOT NULL)"

SQL = {
    "d1_scan_secrets": f"{H} SELECT path, rule, CASE WHEN severity = 'critical' THEN 'critical' ELSE 'high' END AS severity, line, {_HASH} FROM k WHERE kind = 'secret'",
    "d2_scan_pii": f"{H} SELECT path, rule, CASE WHEN severity = 'critical' THEN 'high' ELSE 'medium' END AS severity, line, {_HASH} FROM k WHERE kind = 'personal' AND {_PHONE}",
    "d3_scan_cards": f"WITH {ASSETS}, r AS (SELECT path, unnest(list_filter(regexp_extract_all(content, '[0-9]+'), lambda x: length(x) BETWEEN 13 AND 19)) AS digits FROM a) SELECT path, digits, {LUHN.format(v='digits')} AS valid FROM r",
    "d4_scan_entropy": f"""WITH {ASSETS}, t AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, {quoted(ENTROPY_SHAPE)})) AS token FROM a) GROUP BY 1),
      c AS (SELECT token, n, unnest(string_split(token, '')) AS ch FROM t), g AS (SELECT token, n, ch, count(*) AS k FROM c GROUP BY ALL),
      b AS (SELECT token, n, round(sum(-(k / length(token)) * log2(k / length(token))), 6) AS bits FROM g GROUP BY token, n) SELECT token, bits, n FROM b WHERE bits >= 3.0""",
    "d10_classify_columns": f"""WITH l AS (SELECT DISTINCT category, term FROM {_LEX} WHERE special) SELECT table_name AS "table", column_name AS "column", category FROM information_schema.columns JOIN l ON term = regexp_replace(lower(column_name), '^[a-z]_', '')
      WHERE table_name IN ('customer', 'supplier', 'part', 'orders', 'nation', 'documents') AND data_type = 'VARCHAR'""",
    "d16_schema_protection": "SELECT 'db/' || p_partkey || '.sql' AS path, CASE p_size % 3 WHEN 0 THEN 'rls_absent' ELSE 'rls_without_policy' END AS rule, CASE p_size % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS severity FROM part WHERE p_size % 3 < 2",
    "d5_suppress_hits": f"""WITH {_EXAMPLES}, h AS ({hits_sql()}) SELECT reason, count(*) AS n FROM (SELECT {REASON_SQL} AS reason FROM h) WHERE reason IS NOT NULL GROUP BY 1""",
    "d6_context_gate": f"{H} SELECT rule, count(*) AS n FROM k WHERE rule <> 'phone_e164' OR path IN (SELECT path FROM a WHERE regexp_matches(lower(content), 'the|und')) GROUP BY rule",
    "d7_locate_hits": f"{H} SELECT path, rule, pos, line, left(value, 4) || '…' AS excerpt FROM k",
    "d8_dedupe_history": f"""WITH {ASSETS}, h AS ({hits_sql(key='lang, project, doc_id')}), m AS (SELECT lang, project, max(doc_id) AS newest FROM a GROUP BY ALL)
      SELECT lang, project, rule, left(value, 4) || '…' AS excerpt, count(*) AS n, max(doc_id) < any_value(newest) AS history_only FROM h JOIN m USING (lang, project) GROUP BY 1, 2, 3, 4""",
    "d9_classify_symbols": f"""WITH {ASSETS}, w AS (SELECT path, unnest(list_distinct(regexp_extract_all({_SNAKE}, '[a-z0-9_]+'))) AS term FROM a)
      SELECT path, category, special, arg_min(term, ord) AS term, CASE WHEN special THEN 'high' ELSE 'medium' END AS severity FROM w JOIN (SELECT * FROM {_LEX}) USING (term) WHERE length(term) <= 48 GROUP BY path, category, special""",
    "d11_scan_signals": f"WITH {ASSETS} " + " UNION ALL ".join(f"SELECT path, '{n}' AS signal, instr(lower(content), regexp_extract(lower(content), '{p}')) AS pos FROM a WHERE regexp_matches(lower(content), '{p}')" for n, p in SIGNALS.items()),
    "d12_pii_in_sink": f"""{H}, p AS (SELECT path, list_sort(list(DISTINCT rule)) AS rules FROM k WHERE kind = 'personal' GROUP BY path)
      SELECT path, CASE WHEN list_has_any(rules, {SPECIAL}) THEN 'high' ELSE 'medium' END AS severity, array_to_string(rules[1:3], ',') AS rules FROM p WHERE path IN (SELECT path FROM a WHERE contains(content, 'the'))""",
    "d13_vendor_calls": f"""{H}, p AS (SELECT path, count(DISTINCT rule) AS n_rules FROM k WHERE kind = 'personal' GROUP BY path)
      SELECT path, coalesce(n_rules, 0) AS n_rules, CASE WHEN n_rules > 0 THEN 'high' ELSE 'info' END AS severity FROM a LEFT JOIN p USING (path) WHERE regexp_matches(content, 'with|mit')""",
    "d14_outbound_hosts": rf"""WITH u AS (SELECT page_id, unnest(regexp_extract_all(concat_ws(' ', url, html), 'https?://[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')) AS url FROM pages),
      h AS (SELECT DISTINCT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www\.', '') AS host FROM u)
      SELECT page_id, array_to_string(list_sort(list(host))[1:10], ',') AS hosts, count(*) AS n_hosts FROM h WHERE NOT regexp_matches(host, {quoted(IGNORED_HOSTS)}) GROUP BY page_id""",
    "d15_scan_misconfig": f"""WITH p AS (SELECT 'p' || page_id || '/' || {list(MISCONFIG_PATHS)}[page_id % 8 + 1] AS path, {_TEXTS}[page_id % 13 + 1] || chr(10) || html AS content FROM pages)
      SELECT path, rule, severity FROM (SELECT path, unnest({_RULES}) AS rule FROM p) JOIN (SELECT * FROM {sql_values(list(d.MISCONFIG.items()), 'rule, severity')}) USING (rule)""",
    "d17_injection_lines": f"""WITH {ASSETS}, l AS (SELECT path, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS line FROM (SELECT path, string_split(content, chr(10)) AS l FROM a))
      SELECT path, line, left(trim(t), 200) AS text FROM l WHERE regexp_matches(lower(t), '{INJECTION}')""",
    "d18_dependency_vulns": f"""WITH c AS (SELECT p_partkey AS component, p_brand AS ecosystem, string_split(p_type, ' ')[1] AS package, (p_size // 10) || '.' || (p_size % 10) || '.' || (p_partkey % 7) AS version FROM part)
      SELECT component, version, advisory, severity FROM c JOIN (SELECT * FROM {sql_values(ADVISORIES, 'ecosystem, package, fixed, advisory, severity')}) USING (ecosystem, package) WHERE {_PARTS.format(c='version')} < {_PARTS.format(c='fixed')}""",
    "d19_license_classes": f"""WITH {ASSETS} SELECT CASE WHEN regexp_matches(content, 'AGPL|GPL|LGPL|SSPL|OSL|EUPL|CDDL|MPL') THEN 'copyleft' WHEN regexp_matches(content, 'MIT|Apache|BSD|ISC|All rights reserved|[Ll]icen[cs]e') THEN 'permissive' ELSE 'other' END AS class, count(*) AS n FROM a GROUP BY 1""",
    "d20_artifact_presence": f"WITH {ASSETS}, x AS (" + " UNION ALL ".join(f"SELECT project, '{n}' AS artifact, bool_or(regexp_matches(path, {quoted(glob_regex(g))})) AS present, '{v}' AS severity FROM a GROUP BY project" for n, g, v in SPECS) + ") SELECT project, artifact, present, CASE WHEN NOT present THEN severity END AS severity FROM x",
    "d21_detect_stack": f"SELECT l_suppkey AS project, array_to_string(list_sort(list(DISTINCT framework)), ',') AS stack FROM lineitem JOIN part ON l_partkey = p_partkey JOIN {sql_values(SIGNATURES, 'package, framework')} ON p_brand = package GROUP BY 1",
    "d22_corpus_profile": f"WITH {ASSETS} SELECT lang, count(*) AS files, sum(len(string_split(content, chr(10)))) AS lines, sum(length(content)) AS chars FROM a GROUP BY lang",
    "d23_snapshot_fingerprint": f"WITH {ASSETS}, h AS (SELECT sha256(path || ':' || strlen(content)) AS h FROM a) SELECT sha256(concat_ws(',', count(*), " + ", ".join(f"sum(CAST('0x' || h[{8 * k + 1}:{8 * k + 8}] AS BIGINT))" for k in range(8)) + ")) AS root_hash, count(*) AS assets FROM h",
    "d24_assert_clean": f"""WITH {ASSETS}, c AS (SELECT 'path' AS "column", path AS content FROM a UNION ALL SELECT 'content', content FROM a UNION ALL SELECT 'project', project FROM a),
      h AS ({hits_sql('c', '"column"')}) SELECT "column", kind, count(*) AS n FROM h WHERE NOT ({SUPPRESSED_SQL}) GROUP BY 1, 2""",
}
