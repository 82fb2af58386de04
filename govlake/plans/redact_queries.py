"""Redaction and release operators over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlake.functions import sql as q
from govlake.functions.rules import DETECTORS, glob_regex
from govlake.operators import redact as r
from govlake.plans.tables import ASSETS, LUHN, SUPPRESSED_SQL, assets, hits_sql, quoted, table

SALT = "s1"
GLOBS = ["src3/**", "**/doc_1?.txt"]
ALLOWED = ["src1/**", "**/de/*"]
HOSTS = ["example.com", "therha.example.com", "therin.example.net", "ththth.example.net"]
STOP = ["the", "and", "for", "der", "die", "les"]


def _words(spark, sf):
    """Distinct words of four letters or more as symbols."""
    words = assets(spark, sf).select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z]{4,}"), F.lit(0)))).alias("real")).distinct()
    return words.select(F.lit("term").alias("kind"), "real")


def _names(spark, sf):
    return r.mint_pseudonyms(_words(spark, sf), SALT)


def bound_to_files(spark, sf, rows):
    """rows (conv_id, ...) with path and head of a document and url of a page, by their number modulo the tables' sizes."""
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    a = assets(spark, sf).select(F.col("doc_id").alias("d"), "path", F.col("content").alias("head"))
    p = pages.select(F.col("page_id").alias("p"), "url")
    numbered = rows.withColumns({"d": F.col("conv_id") % docs.count(), "p": F.col("conv_id") % pages.count()})
    return numbered.join(a, "d", "left").join(p, "p", "left")


def _payloads(spark, sf):
    sealed = r.seal_payloads(table(spark, sf, "conversations"))
    text = F.concat_ws("\n", "payload", "head").alias("payload")
    return bound_to_files(spark, sf, sealed).select(F.col("conv_id").alias("payload_id"), "path", "url", text)


def _joined(spark, sf):
    names = r.mint_pseudonyms(table(spark, sf, "customer").select(F.lit("cust").alias("kind"), F.col("c_custkey").cast("string").alias("real")), SALT)
    left = r.pseudonymise_column(table(spark, sf, "orders"), "o_custkey", names)
    right = r.pseudonymise_column(table(spark, sf, "customer"), "c_custkey", names)
    both = left.join(right, F.col("o_custkey") == F.col("c_custkey"))
    return both.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _verbatim(spark, sf):
    """Released texts by level. The digest adds up numbers of 48 bits: a bigint holds those of fewer than 2^15 documents, beyond that it is a decimal."""
    kind = "long" if table(spark, sf, "documents").count() < 1 << 15 else "decimal(38,0)"
    number = F.conv(F.substring(F.sha2("released", 256), 1, 12), 16, 10)
    return r.release_verbatim(assets(spark, sf), ALLOWED).groupBy("level").agg(F.count("*").alias("n"), F.sum(F.size(F.split("released", "\n"))).alias("lines"), F.sum(number.cast("decimal(28,0)")).cast(kind).alias("digest"))


def _round_trip(spark, sf):
    a, names = assets(spark, sf), _names(spark, sf)
    told = lambda df, name: df.withColumn(name, F.sha2("content", 256)).drop("content")
    back = told(r.rehydrate(r.tokenise_terms(a, names), names), "sha256").join(told(a.select("path", "content"), "was"), "path")
    return back.select("path", "sha256", "was", "n")


def _nested(spark, sf):
    """Documents as nested rows, their words of four letters or more replaced in structs, arrays, map keys and map values, and put back."""
    a = assets(spark, sf)
    lines = F.split("content", "\n")
    rows = a.select("doc_id", F.struct(F.col("content").alias("what"), F.struct(lines.alias("refs"), F.length("content").alias("n")).alias("why")).alias("fix"), F.create_map(F.concat(F.lit("f "), F.get(lines, F.lit(0))), F.array(F.struct(F.get(lines, F.lit(1)).alias("v")))).alias("per_file"))
    names = _names(spark, sf)
    # Hashes of what is released go with it as bytes, which aren't rewritten, so the texts in between are never kept.
    hashes = {"what": F.col("fix.what"), "refs": F.array_join("fix.why.refs", "\n"), "key": F.map_keys("per_file")[0], "value": F.coalesce(F.map_values("per_file")[0][0]["v"], F.lit(""))}
    told = lambda: F.struct(*[F.unhex(F.sha2(c, 256)).alias(k) for k, c in hashes.items()], F.col("fix.why.n").alias("n"))
    back = r.rehydrate_nested(r.rewrite_nested(rows, names).withColumn("released", told()), names)
    sides = F.array(F.struct(F.lit("released").alias("side"), F.col("released").alias("of")), F.struct(F.lit("back").alias("side"), told().alias("of")))
    out = back.select("doc_id", F.explode(sides).alias("x")).select("doc_id", "x.side", "x.of.*")
    return out.select("doc_id", *[F.lower(F.hex(c)).alias(c) for c in hashes], "n", "side")


def _egress(spark, sf):
    e = table(spark, sf, "events")
    return e.select("ts", (F.col("user_id") % 7).alias("run_id"), F.col("event_type").alias("destination"), F.length("props").alias("bytes"), F.sha2(F.concat_ws(":", F.col("event_id").cast("string"), "props"), 256).alias("sha256"))


def _sql_functions(spark, sf):
    q.register(spark)
    return spark.sql(f"""SELECT page_id, mask_value(url) AS masked, placeholder_of(url) AS placeholder, severity_rank(element_at(array('critical', 'high', 'medium', 'low', 'info', 'odd'), CAST(page_id % 6 + 1 AS INT))) AS rank,
      glob_like(concat('src', page_id % 5, '/de/doc_', page_id, '.txt'), element_at(array('src3/**', '**/doc_1?.txt', '*.txt', 'src1/*/doc_*.txt', 'doc_*', 'a.b'), CAST(page_id % 7 % 6 + 1 AS INT))) AS hit FROM parquet.`{sf}/pages.parquet`""")


QUERIES = {
    "r1_classify_literals": lambda s, sf: r.classify_literals(table(s, sf, "pages").select(F.col("url").alias("v")).unionAll(table(s, sf, "events").select("props")).unionAll(table(s, sf, "customer").select("c_name")).unionAll(table(s, sf, "documents").select("text")), "v"),
    "r2_bucket_numbers": lambda s, sf: r.bucket_numbers(table(s, sf, "orders").select(F.col("o_totalprice").alias("v")).unionAll(table(s, sf, "lineitem").select("l_extendedprice")), "v"),
    "r3_mint_pseudonyms": lambda s, sf: r.mint_pseudonyms(_words(s, sf), SALT).select("kind", "real", "pseudonym"),
    "r4_pseudonymise_columns": _joined,
    "r5_pseudonymise_paths": lambda s, sf: r.pseudonymise_paths(assets(s, sf), r.path_names(assets(s, sf), SALT)),
    "r6_tokenise_terms": lambda s, sf: r.tokenise_terms(assets(s, sf), _names(s, sf)).select("path", "n", F.sha2("released", 256).alias("sha256")),
    "r7_redact_text": lambda s, sf: r.redact_text(assets(s, sf)).select("path", "n_dropped", "n_placeheld", F.sha2("released", 256).alias("sha256")),
    "r8_structural_outline": lambda s, sf: r.outline_edges(table(s, sf, "pages"), "page_id", "html"),
    "r9_release_verbatim": _verbatim,
    "r1_sql_functions": _sql_functions,
    "r10_rehydrate": _round_trip,
    "r10_nested": _nested,
    "r11_residual_pseudonyms": lambda s, sf: r.residual_pseudonyms(r.tokenise_terms(assets(s, sf), _names(s, sf)), _names(s, sf).where("length(real) <= 9"), ["term"]).select("pseudonym"),
    "r12_deny_verdicts": lambda s, sf: r.deny_verdicts(assets(s, sf), GLOBS),
    "r13_gate_payloads": lambda s, sf: r.gate_payloads(_payloads(s, sf), GLOBS, HOSTS),
    "r13_quarantine": lambda s, sf: r.quarantine_payloads(_payloads(s, sf), GLOBS, HOSTS),
    "r14_pin_hosts": lambda s, sf: r.pin_hosts(table(s, sf, "pages"), HOSTS),
    "r15_release_preview": lambda s, sf: r.release_preview(assets(s, sf), GLOBS),
    "r16_seal_payloads": lambda s, sf: r.seal_payloads(table(s, sf, "conversations")).select("conv_id", "sha256", "bytes"),
    "r17_pack_batches": lambda s, sf: r.pack_batches(assets(s, sf)),
    "r18_chunk_rows": lambda s, sf: r.chunk_rows(table(s, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey"),
    "r19_egress_rollup": lambda s, sf: r.egress_rollup(table(s, sf, "events").select(F.col("event_type").alias("phase"), F.length("props").alias("bytes"), F.col("user_id").alias("destination"), (F.col("user_id") % 7).alias("run_id"))),
    "r19_egress_levels": lambda s, sf: r.egress_levels(_egress(s, sf)),
    "r19_last_requests": lambda s, sf: r.last_requests(_egress(s, sf), F.lit(3)).select("sha256", "destination", "bytes", "nth"),
    "r20_detect_terms": lambda s, sf: r.detect_terms(table(s, sf, "pages"), STOP),
}

_EMAIL = quoted(next(p for n, _, _, p in DETECTORS if n == "email"))
_PII = quoted("|".join(p for n, k, _, p in DETECTORS if k == "personal" and n not in ("email", "card_number")))
_SECRET = quoted("|".join(p for _, k, _, p in DETECTORS if k == "secret"))
_NOT = SUPPRESSED_SQL.replace("(value,", "(v,")
_DENY = "CASE " + " ".join(f"WHEN regexp_matches({{c}}, {quoted(glob_regex(g))}) THEN '{n}'" for n, gs in (("user_never_send", GLOBS), *r.DENIED) for g in gs) + " END"
_PATTERN = "CASE " + " ".join(f"WHEN regexp_matches(path, {quoted(glob_regex(g))}) THEN {quoted(g)}" for n, gs in (("user_never_send", GLOBS), *r.DENIED) for g in gs) + " END"
_HOSTS = ", ".join(f"'{h}'" for h in HOSTS)
_SEALED = "s AS (SELECT conv_id, string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS payload FROM conversations GROUP BY conv_id)"
_B36 = "left(lower(to_base(CAST('0x' || left(sha256('{salt}:{kind}:' || {v} || ':0'), 10) AS BIGINT), 36)), 8)"
_MOD, _SVC = ("'{k}_' || " + _B36).format(k="mod", salt=SALT, kind="mod", v="x"), ("'{k}_' || " + _B36).format(k="svc", salt=SALT, kind="svc", v="regexp_replace(list_last(p), '\\.[^.]*$', '')")
_WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(content, '[A-Za-z]{4,}')) AS real FROM a)"
_RUNS = "unnest(regexp_extract_all(content, '[A-Za-z0-9_$]+'))"
_N = f"n AS (SELECT path, count(*) AS n FROM (SELECT path, {_RUNS} AS t FROM a) WHERE t IN (SELECT real FROM w) GROUP BY path)"


_NAME = "'term_' || " + _B36.format(salt=SALT, kind="term", v="x")
#: {c} with its tokens of four letters or more replaced.
_PUT = f"array_to_string(list_transform(list_zip(string_split_regex({{c}}, '[A-Za-z0-9_$]+'), list_transform(regexp_extract_all({{c}}, '[A-Za-z0-9_$]+'), lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z]{{{{4,}}}}') THEN {_NAME} ELSE x END)), lambda z: z[1] || coalesce(z[2], '')), '')"


def _redacted() -> str:
    """z: path, content, text redacted rule by rule, and the two counts, from the assets a."""
    steps = ["z0 AS (SELECT path, content, content AS t, 0 AS nd, 0 AS nh FROM a)"]
    for k, (name, kind, _, pattern) in enumerate(DETECTORS):
        real = "NOT (" + SUPPRESSED_SQL.replace("(value,", "(v,") + ")" + (f" AND length(v) BETWEEN 13 AND 19 AND {LUHN.format(v='v')}" if name == "card_number" else "")
        mark = ("<dropped:secret>" if kind == "secret" else f"<str:{name}>")
        put = f"CASE WHEN {real} THEN '{mark}' || repeat(chr(10), length(v) - length(replace(v, chr(10), ''))) ELSE v END"
        found = f"SELECT *, regexp_extract_all(t, {quoted(pattern)}) AS f, string_split_regex(t, {quoted(pattern)}) AS g FROM z{k}"
        told = f"SELECT *, list_transform(f, lambda v: {put}) AS p, len(list_filter(f, lambda v: {real})) AS n FROM ({found})"
        steps.append(f"z{k + 1} AS (SELECT path, content, CASE WHEN len(f) > 0 THEN array_to_string(list_transform(range(1, len(g) + 1), lambda j: g[j] || coalesce(p[j], '')), '') ELSE t END AS t, nd + {'n' if kind == 'secret' else '0'} AS nd, nh + {'0' if kind == 'secret' else 'n'} AS nh FROM ({told}))")
    return ", ".join([*steps, f"z AS (SELECT * FROM z{len(DETECTORS)})"])


SQL = {
    "r1_classify_literals": f"""WITH x AS (SELECT url AS v FROM pages UNION ALL SELECT props FROM events UNION ALL SELECT c_name FROM customer UNION ALL SELECT text FROM documents),
      y AS (SELECT v, lower(v) AS l, trim(regexp_replace(lower(v), '[ \\t\\r\\n]+', ' ', 'g')) AS s, string_split(lower(v), '.') AS d FROM x WHERE v IS NOT NULL),
      c AS (SELECT CASE WHEN regexp_matches(v, {_SECRET}) AND NOT ({_NOT}) THEN '<dropped:secret>'
      WHEN v IN {q.PASSED} OR v = '' OR regexp_full_match(l, '({"|".join(q.MODELS)})[a-z0-9_.:-]*') OR regexp_full_match(l, '({"|".join(q.VENDORS)})/[a-z0-9_.:-]+') THEN v
      WHEN regexp_matches(v, {_EMAIL}) AND NOT ({_NOT}) THEN '<str:email>'
      WHEN regexp_matches(v, {_PII}) OR len(list_filter(regexp_extract_all(v, '[0-9]{{13,}}'), lambda x: length(x) BETWEEN 13 AND 19 AND {LUHN.format(v='x')})) > 0 THEN '<str:pii>'
      WHEN regexp_matches(l, '^https?://(localhost|127[.]0[.]0[.]1|0[.]0[.]0[.]0|\\[::1\\]|host[.]docker[.]internal)([/:?#]|$)') THEN '<str:url:internal>' WHEN regexp_matches(l, '^https?://') THEN '<str:url:external>'
      WHEN regexp_matches(l, '^({"|".join(q.STORES).replace("+", "[+]")})://') THEN '<str:connection_string>' WHEN regexp_matches(s, '^({"|".join(q.STATEMENTS)}) ') THEN '<str:sql:len:' || length(v) || '>'
      WHEN length(v) > 60 AND regexp_matches(l, '{"|".join(q.PROMPTS)}') THEN '<str:prompt:len:' || length(v) || '>'
      WHEN length(v) < 80 AND regexp_full_match(v, '/[A-Za-z0-9_/:.\\[\\]{{}}-]*') THEN '<str:path:segments:' || (len(string_split(v, '/')) - 1) || '>' WHEN starts_with(v, './') OR starts_with(v, '../') THEN '<str:relpath>'
      WHEN regexp_full_match(l, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') THEN '<str:uuid>' WHEN try_cast(left(v, 10) AS DATE) IS NOT NULL AND regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN '<str:date>'
      WHEN len(d) BETWEEN 2 AND 6 AND regexp_full_match(d[-1], '[a-z]{{2,18}}') AND len(list_filter(d, lambda x: NOT regexp_full_match(x, '[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?'))) = 0 THEN '<str:domain>' ELSE '<str:len:' || length(v) || '>' END AS placeholder FROM y)
      SELECT placeholder, placeholder = '<dropped:secret>' AS dropped, count(*) AS n FROM c GROUP BY 1, 2""",
    "r2_bucket_numbers": f"""WITH x AS (SELECT o_totalprice AS v FROM orders UNION ALL SELECT l_extendedprice FROM lineitem), d AS (SELECT v, length(CAST(CAST(trunc(abs(v)) AS BIGINT) AS VARCHAR)) AS k FROM x)
      SELECT CASE WHEN abs(v) >= 1000 AND abs(v) NOT IN {r.PLAIN_NUMBERS} THEN '<num:' || rpad('1', CAST(k AS INT), '0') || '..' || rpad('1', CAST(k AS INT), '0') || '0>' END AS bucket, count(*) AS n FROM d GROUP BY 1""",
    "r3_mint_pseudonyms": f"WITH {ASSETS}, {_WORDS} SELECT 'term' AS kind, real, {_NAME.replace("|| x ||", "|| real ||")} AS pseudonym FROM w",
    "r4_pseudonymise_columns": "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey",
    "r5_pseudonymise_paths": rf"""WITH {ASSETS}, s AS (SELECT path, string_split(path, '/') AS p FROM a)
      SELECT path, array_to_string(list_concat(list_transform(p[1:len(p) - 1], lambda x: {_MOD}), [{_SVC} || regexp_extract(list_last(p), '(\.[^.]*)$', 1)]), '/') AS released FROM s""",
    "r6_tokenise_terms": f"WITH {ASSETS}, {_WORDS}, {_N} SELECT path, coalesce(n, 0) AS n, sha256({_PUT.format(c='content')}) AS sha256 FROM a LEFT JOIN n USING (path)",
    "r7_redact_text": f"WITH {ASSETS}, {_redacted()} SELECT path, nd AS n_dropped, nh AS n_placeheld, sha256(t) AS sha256 FROM z",
    "r8_structural_outline": """WITH e AS (SELECT page_id, list_concat(list_transform(list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1)), lambda t: 'tag ' || t), list_transform(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)), lambda t: 'link ' || t)) AS l FROM pages),
      u AS (SELECT page_id, split_part(e, ' ', 1) AS edge, substr(e, instr(e, ' ') + 1) AS target FROM (SELECT page_id, unnest(l) AS e FROM e))
      SELECT page_id, edge, target FROM u QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY edge, target) <= 80""",
    "r9_release_verbatim": f"""WITH {ASSETS}, {_redacted()}, v AS (SELECT *, regexp_matches(path, {quoted('|'.join(glob_regex(g) for g in ALLOWED))}) AS o FROM z),
      w AS (SELECT CASE WHEN o THEN 2 ELSE 1 END AS level, CASE WHEN o THEN array_to_string(list_transform(string_split(content, chr(10)), lambda x: CASE WHEN regexp_matches(x, {_SECRET}) THEN '<line removed>' ELSE x END), chr(10)) ELSE t END AS r FROM v)
      SELECT level, count(*) AS n, sum(len(string_split(r, chr(10)))) AS lines, sum(CAST('0x' || left(sha256(r), 12) AS BIGINT)) AS digest FROM w GROUP BY 1""",
    "r10_rehydrate": f"WITH {ASSETS}, {_WORDS}, {_N} SELECT path, sha256(content) AS sha256, sha256(content) AS was, coalesce(n, 0) AS n FROM a LEFT JOIN n USING (path)",
    "r10_nested": f"""WITH {ASSETS}, l AS (SELECT doc_id, content, string_split(content, chr(10)) AS l FROM a), b AS (SELECT doc_id, content AS w, 'f ' || l[1] AS k, coalesce(l[2], '') AS v, length(content) AS n FROM l)
      SELECT doc_id, sha256({_PUT.format(c='w')}) AS what, sha256({_PUT.format(c='w')}) AS refs, sha256({_PUT.format(c='k')}) AS key, sha256({_PUT.format(c='v')}) AS value, n, 'released' AS side FROM b UNION ALL SELECT doc_id, sha256(w), sha256(w), sha256(k), sha256(v), n, 'back' FROM b""",
    "r1_sql_functions": """SELECT page_id, left(url, 4) || '…' AS masked, CASE WHEN regexp_matches(url, '^https?://') THEN '<str:url:external>' END AS placeholder, CASE WHEN page_id % 6 = 5 THEN 99 ELSE page_id % 6 END::INT AS rank,
      CASE page_id % 7 % 6 WHEN 0 THEN page_id % 5 = 3 WHEN 1 THEN regexp_full_match(CAST(page_id AS VARCHAR), '1.') WHEN 2 THEN true WHEN 3 THEN page_id % 5 = 1 WHEN 4 THEN true ELSE false END AS hit FROM pages""",
    "r11_residual_pseudonyms": f"WITH {ASSETS}, {_WORDS} SELECT DISTINCT {_NAME} AS pseudonym FROM (SELECT {_RUNS} AS x FROM a) WHERE x IN (SELECT real FROM w WHERE length(real) > 9)",
    "r12_deny_verdicts": f"WITH {ASSETS} SELECT path, {_DENY.format(c='path')} AS reason, {_PATTERN} AS pattern, reason IS NOT NULL AS denied FROM a",
    "r13_gate_payloads": f"""WITH {ASSETS}, {_SEALED}, q AS (SELECT conv_id AS payload_id, path, url, concat_ws(chr(10), payload, content) AS payload FROM s LEFT JOIN a ON conv_id % (SELECT count(*) FROM documents) = doc_id LEFT JOIN pages ON conv_id % (SELECT count(*) FROM pages) = page_id),
      h AS ({hits_sql('q', 'payload_id', 'payload')}), k AS (SELECT payload_id, count(*) AS n_hits FROM h WHERE NOT ({SUPPRESSED_SQL}) GROUP BY 1)
      SELECT payload_id, CASE WHEN {_DENY.format(c='path')} IS NOT NULL THEN 'denied_path' WHEN n_hits > 0 THEN 'forbidden_pattern' WHEN lower(regexp_extract(url, '^https://([^/:?#]+)', 1)) NOT IN ({_HOSTS}) THEN 'host_not_pinned' ELSE 'pass' END AS verdict,
      coalesce(n_hits, 0) AS n_hits FROM q LEFT JOIN k USING (payload_id)""",
    "r13_quarantine": f"""WITH {ASSETS}, {_SEALED}, q AS (SELECT conv_id AS payload_id, path, url, concat_ws(chr(10), payload, content) AS payload FROM s LEFT JOIN a ON conv_id % (SELECT count(*) FROM documents) = doc_id LEFT JOIN pages ON conv_id % (SELECT count(*) FROM pages) = page_id),
      h AS ({hits_sql('q', 'payload_id', 'payload')}), k AS (SELECT payload_id, rule, pos, line FROM h WHERE NOT ({SUPPRESSED_SQL})),
      v AS (SELECT payload_id, rule, pos, line, CASE WHEN {_DENY.format(c='path')} IS NOT NULL THEN 'denied_path' WHEN rule IS NOT NULL THEN 'forbidden_pattern' WHEN lower(regexp_extract(url, '^https://([^/:?#]+)', 1)) NOT IN ({_HOSTS}) THEN 'host_not_pinned' ELSE 'pass' END AS verdict FROM q LEFT JOIN k USING (payload_id))
      SELECT payload_id, verdict, rule, pos, line FROM v WHERE verdict <> 'pass'""",
    "r14_pin_hosts": f"""WITH p AS (SELECT url, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS h FROM pages)
      SELECT url, CASE WHEN h = '' THEN 'malformed' WHEN NOT starts_with(url, 'https://') THEN 'not_https' WHEN h NOT IN ({_HOSTS}) THEN 'host_not_pinned' ELSE 'ok' END AS verdict FROM p""",
    "r15_release_preview": f"""WITH {ASSETS}, {_redacted()}, s AS (SELECT CASE WHEN {_DENY.format(c='path')} IS NOT NULL THEN 'denied' WHEN content IS NULL THEN 'unreadable' ELSE 'sent' END AS status, strlen(content) AS b, strlen(t) AS e FROM z)
      SELECT status, count(*) AS n, sum(b) AS bytes_before, sum(CASE WHEN status = 'sent' THEN e ELSE 0 END) AS bytes_after FROM s GROUP BY ROLLUP (status)""",
    "r16_seal_payloads": f"WITH {_SEALED} SELECT conv_id, sha256(payload) AS sha256, strlen(payload) AS bytes FROM s",
    "r17_pack_batches": f"""WITH RECURSIVE {ASSETS}, o AS (SELECT project, path, length(content) + length(path) + 64 AS size, row_number() OVER (PARTITION BY project ORDER BY doc_id) AS i FROM a),
      p AS (SELECT project, path, i, size AS used, 0 AS batch FROM o WHERE i = 1 UNION ALL SELECT o.project, o.path, o.i, CASE WHEN p.used + o.size > 60000 THEN o.size ELSE p.used + o.size END, CASE WHEN p.used + o.size > 60000 THEN p.batch + 1 ELSE p.batch END
      FROM p JOIN o ON o.project = p.project AND o.i = p.i + 1) SELECT project, path, batch FROM p""",
    "r18_chunk_rows": "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 12 AS chunk FROM orders",
    "r19_egress_rollup": "SELECT event_type AS phase, count(*) AS requests, sum(length(props)) AS bytes, count(DISTINCT user_id) AS destinations, count(DISTINCT user_id % 7) AS runs FROM events GROUP BY 1",
    "r19_egress_levels": "SELECT user_id % 7 AS run_id, event_type AS destination, CAST(grouping_id(user_id % 7, event_type) AS INT) AS level, count(*) AS requests, sum(length(props)) AS bytes FROM events GROUP BY CUBE (user_id % 7, event_type)",
    "r19_last_requests": "SELECT sha256(event_id || ':' || props) AS sha256, event_type AS destination, length(props) AS bytes, row_number() OVER (ORDER BY ts DESC, sha256(event_id || ':' || props)) AS nth FROM events WHERE user_id % 7 = 3 QUALIFY nth <= 40",
    "r20_detect_terms": r"""WITH t AS (SELECT unnest(list_concat([string_split(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www\.', ''), '.')[1]], string_split_regex(regexp_replace(lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))), '[^a-z ]', '', 'g'), ' +'))) AS term FROM pages)
      SELECT term, count(*) AS n FROM t WHERE length(term) BETWEEN 3 AND 64 AND term NOT IN ('the', 'and', 'for', 'der', 'die', 'les') GROUP BY term""",
}
