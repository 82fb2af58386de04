"""Findings in text: secrets, personal data, signals, licences, vulnerable components. Assets have path and content."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlake.functions.rules import ENTROPY_SHAPE, detected, host_of, mask, suppression


#: What an asset must hold for its telephone numbers to count; the word border binds to the first alone. Fixed value.
PHONE_WORDS = r"\bphone|tel|mobile|msisdn"


def hits(assets: DataFrame, kinds: tuple[str, ...] = ("secret", "personal")) -> DataFrame:
    """(path, rule, kind, severity, value, pos, line): every raw hit of the rules of some kinds, one pass over each text.

    pos counts the characters before a hit, line counts from 1. Null and empty texts have no hit; rows that repeat a path are searched each.
    """
    return assets.select("path", F.explode(detected(F.col("content"), kinds)).alias("h")).select("path", "h.*")


def suppress_hits(found: DataFrame) -> DataFrame:
    """Hits without documentation addresses, environment references and placeholders."""
    return found.where(suppression(F.col("value")).isNull())


def suppressed_counts(found: DataFrame) -> DataFrame:
    """(reason, n) of the hits that suppress_hits leaves out, by the first class that matches."""
    return found.select(suppression(F.col("value")).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def snippet_hash(path: Column, rule: Column, pos: Column) -> Column:
    """Names a hit without its value."""
    return F.substring(F.sha2(F.concat_ws(":", path, rule, pos.cast("string")), 256), 1, 12)


def _findings(found: DataFrame, kind: str, severity: Column) -> DataFrame:
    rows = suppress_hits(found).where(F.col("kind") == kind)
    return rows.select("path", "rule", severity.alias("severity"), "line", snippet_hash(F.col("path"), F.col("rule"), F.col("pos")).alias("snippet_hash"))


def scan_secrets(assets: DataFrame) -> DataFrame:
    """One finding per secret: critical if its rule is, else high."""
    return _findings(hits(assets, ("secret",)), "secret", F.when(F.col("severity") == "critical", "critical").otherwise("high"))


def scan_pii(assets: DataFrame) -> DataFrame:
    """One finding per personal value: high if its rule is critical, else medium. Telephone numbers count only in assets that speak of them."""
    named = F.lower("content").rlike(PHONE_WORDS)
    found = assets.select("path", named.alias("named"), F.explode(detected(F.col("content"), ("personal",))).alias("h")).select("path", "named", "h.*")
    return _findings(found.where((F.col("rule") != "phone_e164") | F.col("named")), "personal", F.when(F.col("severity") == "critical", "high").otherwise("medium"))


def scan_cards(assets: DataFrame) -> DataFrame:
    """(path, digits, valid) of maximal digit runs of card length, with the check digit's verdict."""
    runs = F.filter(F.regexp_extract_all("content", F.lit("[0-9]+"), F.lit(0)), lambda v: F.length(v).between(13, 19))
    return assets.select("path", F.explode(runs).alias("digits")).withColumn("valid", F.call_function("luhn_check", F.col("digits")))


def scan_entropy(assets: DataFrame, min_bits: float = 3.0) -> DataFrame:
    """(token, bits, n) of long tokens whose entropy in bits per character is at least min_bits.

    Tokens are counted before their characters are, so the shuffles hold distinct tokens.
    """
    tokens = assets.select(F.explode(F.regexp_extract_all("content", F.lit(ENTROPY_SHAPE), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    chars = tokens.select("token", "n", F.explode(F.split("token", "")).alias("c")).where("c <> ''")
    share = F.col("k") / F.length("token")
    bits = chars.groupBy("token", "n", "c").agg(F.count("*").alias("k")).groupBy("token", "n").agg(F.round(F.sum(-share * F.log2(share)), 6).alias("bits"))
    return bits.where(F.col("bits") >= min_bits).select("token", "bits", "n")


def context_gate(found: DataFrame, assets: DataFrame, rule: str = "phone_e164", words: str = PHONE_WORDS) -> DataFrame:
    """Hits of a rule only where the asset mentions one of the words; other rules' hits stay."""
    named = assets.where(F.lower("content").rlike(words)).select("path")
    return found.where(F.col("rule") != rule).unionByName(found.where(F.col("rule") == rule).join(named, "path", "left_semi"))


def locate_hits(found: DataFrame) -> DataFrame:
    """(path, rule, pos, line, excerpt): where each hit itself stands, and a masked excerpt that never shows the value."""
    return found.select("path", "rule", "pos", "line", mask(F.col("value")).alias("excerpt"))


def dedupe_history(versions: DataFrame, key_cols: list, order_col: str) -> DataFrame:
    """Over all versions of an asset one row per (asset, rule, excerpt); history_only if the newest version lacks it.

    versions: key columns, order_col, content.
    """
    found = versions.select(*key_cols, order_col, F.explode(detected(F.col("content"))).alias("h")).select(*key_cols, order_col, "h.rule", mask(F.col("h.value")).alias("excerpt"))
    newest = versions.groupBy(*key_cols).agg(F.max(order_col).alias("newest"))
    seen = found.groupBy(*key_cols, "rule", "excerpt").agg(F.max(order_col).alias("last"), F.count("*").alias("n"))
    return seen.join(newest, key_cols).select(*key_cols, "rule", "excerpt", "n", (F.col("last") < F.col("newest")).alias("history_only"))


def classify_symbols(assets: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One finding per (path, category) at the first matching term of the lexicon (category, special, term, ord)."""
    snake = F.lower(F.regexp_replace(F.regexp_replace(F.col("content"), "([a-z0-9])([A-Z])", "$1_$2"), r"[-.]", "_"))
    words = assets.select("path", F.explode(F.array_distinct(F.regexp_extract_all(snake, F.lit("[a-z0-9_]+"), F.lit(0)))).alias("term")).where(F.length("term") <= 48)
    first = words.join(lexicon, "term").groupBy("path", "category", "special").agg(F.min_by("term", "ord").alias("term"))
    return first.withColumn("severity", F.when(F.col("special"), "high").otherwise("medium"))


def classify_columns(columns: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(table, column, category) of text columns whose name is a special category's term; columns: table, column, type."""
    special = lexicon.where("special").select(F.col("term").alias("name"), "category").distinct()
    text = columns.where("type = 'string'").withColumn("name", F.lower(F.regexp_replace("column", "^[a-z]_", "")))
    return text.join(special, "name").select("table", "column", "category")


def catalog_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type) of the schemas of some tables."""
    rows = [(t, c, kind) for t, df in tables.items() for c, kind in df.dtypes]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table string, column string, type string")


def scan_signals(assets: DataFrame, signals: dict[str, str]) -> DataFrame:
    """(path, signal, pos): one row per asset and signal that its text matches, at the first match."""
    found = F.array(*[F.struct(F.lit(n).alias("signal"), F.regexp_extract(F.lower("content"), f"({p})", 1).alias("hit")) for n, p in sorted(signals.items())])
    rows = assets.select("path", F.lower("content").alias("low"), F.explode(F.filter(found, lambda s: s.hit != "")).alias("s"))
    return rows.select("path", "s.signal", F.expr("instr(low, s.hit)").cast("long").alias("pos"))


def pii_in_sink(found: DataFrame, assets: DataFrame, sink: str, special: list[str]) -> DataFrame:
    """Assets with personal data and a sink call: high if a rule is special, else medium; the first 3 rules."""
    personal = found.where("kind = 'personal'").groupBy("path").agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    sinks = assets.where(F.col("content").contains(sink)).select("path")
    severity = F.when(F.arrays_overlap("rules", F.array(*map(F.lit, special))), "high").otherwise("medium")
    return personal.join(sinks, "path").select("path", severity.alias("severity"), F.array_join(F.slice("rules", 1, 3), ",").alias("rules"))


def vendor_calls(found: DataFrame, assets: DataFrame, call: str) -> DataFrame:
    """Assets that call a vendor: high if they hold personal data, else info."""
    personal = found.where("kind = 'personal'").groupBy("path").agg(F.count_distinct("rule").alias("n_rules"))
    calls = assets.where(F.col("content").rlike(call)).select("path")
    return calls.join(personal, "path", "left").select("path", F.coalesce("n_rules", F.lit(0).cast("long")).alias("n_rules"), F.when(F.col("n_rules") > 0, "high").otherwise("info").alias("severity"))


def outbound_hosts(pages: DataFrame, key: str, text: str, ignore: str) -> DataFrame:
    """(key, hosts, n_hosts): the first 10 distinct external hosts in a text, sorted."""
    links = F.regexp_extract_all(text, F.lit(r"https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    hosts = pages.select(key, F.explode(links).alias("url")).select(key, host_of(F.col("url")).alias("host")).where(~F.col("host").rlike(ignore)).distinct()
    return hosts.groupBy(key).agg(F.array_join(F.slice(F.sort_array(F.collect_set("host")), 1, 10), ",").alias("hosts"), F.count("*").alias("n_hosts"))


#: Severity of each rule. Names are fixed values.
MISCONFIG = {
    "privileged_key_in_client": "critical",
    "permissive_cors": "medium",
    "public_bucket": "high",
    "unpinned_action": "medium",
    "missing_security_headers": "low",
    "container_runs_as_root": "medium",
    "debug_enabled": "medium",
    "tls_verification_disabled": "high",
}
#: Settings that a rule looks for, as (name, value) in the spellings of the tools that know them.
SETTINGS = {
    "permissive_cors": ((r"access-control-allow-origin", r"\*"), (r"(?:allow_?)?origins?", r"\[?\s*[\"']\*[\"']")),
    "public_bucket": ((r"acl", r"[\"']?public-read(?:-write)?"), (r"(?:public_?access_?block|block_?public_?(?:acls|policy)|restrict_?public_?buckets)", r"false"), (r"[\"']public[\"']", r"true")),
    "tls_verification_disabled": ((r"(?:ssl_?)?verify", r"(?:False|ssl\.CERT_NONE)"), (r"rejectUnauthorized", r"false"), (r"NODE_TLS_REJECT_UNAUTHORIZED", r"[\"']?0\b"), (r"InsecureSkipVerify", r"true")),
    "debug_enabled": ((r"\b(?:DEBUG|debug)", r"(?:True|true|1)\b"),),
}
#: Prefixes of variables that build tools put into browser code, and what marks a variable as not for browsers.
PUBLIC_PREFIXES = ("NEXT_PUBLIC", "VITE", "REACT_APP", "EXPO_PUBLIC", "PUBLIC", "GATSBY", "NUXT_PUBLIC")
PRIVILEGED = ("SERVICE_ROLE", "SECRET", "ADMIN", "PRIVATE")
#: Folders of code that ships to browsers, and those below them that stay on the server.
CLIENT_FOLDERS = ("app", "pages", "components", "client", "public", "web")
SERVER_FOLDERS = ("api", "server", "actions")
#: Files that set the headers of a web application, and the headers they should set.
HEADER_FILES = ("next.config", "middleware.ts", "middleware.js", "helmet", "nginx.conf", "vercel.json")
HEADERS = ("Content-Security-Policy", "Strict-Transport-Security")


def setting_pattern(rule: str) -> str:
    """Finds one of a rule's settings with its value: the name, in quotes or not, then a colon, equal sign or comma among blanks, then the value."""
    loose = "(?i)" if rule in ("permissive_cors", "public_bucket") else ""
    return loose + "|".join(rf"{name}[\"']?[\s:=,]*[:=,]\s*[\"']?{value}" if value != r"\*" else rf"{name}[\"'\s:=,]+{value}" for name, value in SETTINGS[rule])


def _sets(text: Column, rule: str) -> Column:
    return text.rlike(setting_pattern(rule))


def _in_folder(path: Column, folders: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*map(F.lit, folders)))) > 0


def scan_misconfig(assets: DataFrame) -> DataFrame:
    """(path, rule, severity): settings by path, by what a text holds and by what it lacks. Null texts hold and lack nothing.

    A privileged key counts where its variable has a prefix for browsers, or where code for browsers names it; a container runs as root unless some USER names another; headers
    are missing where one of the two is; CI actions are loose unless pinned to a commit; debug settings of tests don't count.
    """
    path, text = F.col("path"), F.coalesce("content", F.lit(""))
    public = text.rlike(rf"\b(?:{'|'.join(PUBLIC_PREFIXES)})_\w*(?:{'|'.join(PRIVILEGED)})")
    named = text.rlike(r"(?i)service_role|supabase_service|admin[_-]?key") | text.contains("SECRET_KEY")
    users = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(?:USER|user)[ \t]+([^\s:]+)"), F.lit(1)), F.lower)
    refs = F.regexp_extract_all(text, F.lit(r"uses:\s*[\w.-]+/[\w./-]+@(\S+)"), F.lit(1))
    test = path.rlike(r"[.](?:test|spec)[.]")
    found = {
        "privileged_key_in_client": public | (_in_folder(path, CLIENT_FOLDERS) & ~_in_folder(path, SERVER_FOLDERS) & named),
        "permissive_cors": _sets(text, "permissive_cors") | text.rlike(r"(?i)cors\(\s*[{]\s*origin\s*:\s*true"),
        "public_bucket": _sets(text, "public_bucket") | text.contains("allUsers"),
        "unpinned_action": path.contains(".github/workflows/") & F.exists(refs, lambda r: ~r.rlike("^[0-9a-f]{40}$")),
        "missing_security_headers": reduce(lambda a, b: a | b, [path.contains(f) for f in HEADER_FILES]) & reduce(lambda a, b: a | b, [~F.contains(F.lower(text), F.lit(h.lower())) for h in HEADERS]),
        "container_runs_as_root": F.element_at(F.split(path, "/"), -1).startswith("Dockerfile") & ~F.exists(users, lambda u: ~u.isin("root", "0")),
        "debug_enabled": _sets(text, "debug_enabled") & ~test,
        "tls_verification_disabled": _sets(text, "tls_verification_disabled"),
    }
    cases = [F.when(found[rule] & F.col("content").isNotNull(), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, severity in MISCONFIG.items()]
    return assets.select("path", F.explode(F.array_compact(F.array(*cases))).alias("m")).select("path", "m.*")


def schema_protection(ddl: DataFrame) -> DataFrame:
    """DDL assets with tables but no row-level security (high), or with it but no policy (medium)."""
    low = F.lower("content")
    tables, secured, policy = low.rlike("create +table"), low.rlike("enable +row +level +security"), low.rlike("create +policy")
    rule = F.when(tables & ~secured, "rls_absent").when(tables & secured & ~policy, "rls_without_policy")
    return ddl.select("path", rule.alias("rule"), F.when(rule == "rls_absent", "high").otherwise("medium").alias("severity")).where("rule is not null")


def injection_lines(assets: DataFrame, pattern: str, key: str = "path") -> DataFrame:
    """(key, line, text) of lines that try to instruct a model: numbered from 1, trimmed, at most 200 characters. They're reported, never obeyed."""
    rows = assets.select(key, F.posexplode(F.split("content", "\n")).alias("i", "line_text"))
    return rows.where(F.lower("line_text").rlike(pattern)).select(key, (F.col("i") + 1).cast("long").alias("line"), F.left(F.trim("line_text"), F.lit(200)).alias("text"))


def version_parts(version: Column) -> Column:
    parts = F.split(F.regexp_replace(version, "[^0-9.]", ""), "\\.")
    return F.transform(parts, lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def dependency_vulns(components: DataFrame, advisories: DataFrame) -> DataFrame:
    """Components below the fixed version of an advisory (ecosystem, package, fixed, advisory, severity). Versions compare as zero-padded integer arrays; * is skipped."""
    pair = components.where("version <> '*'").join(advisories, ["ecosystem", "package"])
    most = F.greatest(F.size(version_parts(F.col("version"))), F.size(version_parts(F.col("fixed"))))
    pad = lambda c: F.concat(version_parts(F.col(c)), F.array_repeat(F.lit(0), most - F.size(version_parts(F.col(c)))))
    return pair.where(pad("version") < pad("fixed")).select("component", "version", "advisory", "severity")


def license_classes(assets: DataFrame, copyleft: str = "AGPL|GPL|LGPL|SSPL|OSL|EUPL|CDDL|MPL", permissive: str = "MIT|Apache|BSD|ISC|All rights reserved|[Ll]icen[cs]e") -> DataFrame:
    """(class, n) of assets by the licence text they hold."""
    kind = F.when(F.col("content").rlike(copyleft), "copyleft").when(F.col("content").rlike(permissive), "permissive").otherwise("other")
    return assets.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def artifact_presence(assets: DataFrame, specs: list[tuple[str, str, str]], project: str = "project") -> DataFrame:
    """(project, artifact, present, severity) for every project and spec (name, glob regex, severity if absent), present or not."""
    flags = [F.max(F.col("path").rlike(regex)).alias(name) for name, regex, _ in specs]
    wide = assets.groupBy(project).agg(*flags)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("artifact"), F.col(n).alias("present"), F.lit(s).alias("severity")) for n, _, s in specs]))
    long = wide.select(project, rows.alias("a")).select(project, "a.artifact", "a.present", "a.severity")
    return long.withColumn("severity", F.when(~F.col("present"), F.col("severity")))


def detect_stack(components: DataFrame, signatures: DataFrame, project: str = "project") -> DataFrame:
    """(project, stack): sorted frameworks of a project by its components' names; signatures: package, framework."""
    found = components.join(signatures, "package").groupBy(project)
    return found.agg(F.array_join(F.sort_array(F.collect_set("framework")), ",").alias("stack"))


def corpus_profile(assets: DataFrame, language: str = "lang") -> DataFrame:
    """(language, files, lines, chars)."""
    return assets.groupBy(language).agg(F.count("*").alias("files"), F.sum(F.size(F.split("content", "\n"))).alias("lines"), F.sum(F.length("content")).alias("chars"))


def snapshot_fingerprint(assets: DataFrame, width: int = 8) -> DataFrame:
    """(root_hash, assets): one hash of all (path, size), whatever the partitioning; a null content has size -1.

    Each line is hashed and the hashes' `width` pieces of 32 bits are summed, so partial sums meet in the map tasks and
    no list of lines is ever made. The sums, and the number of lines, are hashed once more. Repeated rows count each.
    """
    line = F.concat_ws(":", F.coalesce("path", F.lit("")), F.coalesce(F.octet_length("content"), F.lit(-1)).cast("string"))
    hashed = assets.select(F.sha2(line, 256).alias("h"))
    pieces = [F.coalesce(F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for k in range(width)]
    return hashed.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *pieces), 256).alias("root_hash"), F.count("*").alias("assets"))


def _leaves(kind: T.DataType, name: str) -> list[tuple[str, Callable[[Column], Column]]]:
    """(name, value -> array of strings) of the string leaves of a type, within structs, arrays and maps, keys included."""
    if isinstance(kind, T.StringType):
        return [(name, lambda v: F.array(v))]
    if isinstance(kind, T.StructType):
        return [(n, lambda v, f=f, get=get: get(v[f.name])) for f in kind.fields for n, get in _leaves(f.dataType, f"{name}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        return [(n, lambda v, get=get: F.flatten(F.transform(v, lambda e: get(e)))) for n, get in _leaves(kind.elementType, name)]
    if isinstance(kind, T.MapType):
        parts = ((T.ArrayType(kind.keyType), ".key", F.map_keys), (T.ArrayType(kind.valueType), ".value", F.map_values))
        return [(n, lambda v, get=get, of=of: get(of(v))) for part, suffix, of in parts for n, get in _leaves(part, name + suffix)]
    return []


def assert_clean(df: DataFrame) -> DataFrame:
    """(column, kind, n): hits in every string leaf of a table, nested ones and map keys included; no row if it's clean."""
    leaves = [(n, get(F.col(f"`{f.name}`"))) for f in df.schema.fields for n, get in _leaves(f.dataType, f.name)]
    if not leaves:
        return df.sparkSession.createDataFrame([], "column string, kind string, n long")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c.alias("texts")) for n, c in leaves])).alias("x")).select("x.column", F.explode("x.texts").alias("content"))
    found = cells.select("column", F.explode(detected(F.col("content"))).alias("h")).select("column", "h.kind", "h.value")
    return suppress_hits(found).groupBy("column", "kind").agg(F.count("*").alias("n"))
