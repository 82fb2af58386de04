"""Functions for SQL texts. Catalyst puts their bodies in place, so a plan that calls them has no function call left."""

from __future__ import annotations

from pyspark.sql import SparkSession

from govlake.functions.rules import DETECTORS, NEEDED, SEVERITIES, SUPPRESSED

#: Values of protocols, formats and roles that stay as they are. Fixed values.
PASSED = (
    "", " ", "/", "GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS",
    "utf8", "utf-8", "UTF-8", "base64", "hex", "ascii", "binary", "json",
    "application/json", "text/plain", "text/html", "multipart/form-data", "application/x-www-form-urlencoded",
    "use strict", "use client", "use server", "development", "production", "test", "staging", "local",
    "GET,POST", "*", "true", "false", "null", "none", "None", "sha256", "sha512", "md5", "aes-256-gcm", "HS256", "RS256", "bearer", "Bearer",
    "Authorization", "Content-Type", "Set-Cookie", "Cookie", "X-Request-Id", "Strict-Transport-Security", "Content-Security-Policy", "X-Frame-Options",
    "SameSite", "Lax", "Strict", "httpOnly", "secure", "asc", "desc", "ASC", "DESC", "id", "uuid", "created_at", "updated_at",
    "system", "user", "assistant", "tool", "function", "developer",
)
#: First parts of public model names, and vendors that stand before a slash in them. Fixed values.
MODELS = ("gpt", "o1", "o3", "o4", "claude", "gemini", "llama", "mistral", "mixtral", "command", "sonar", "deepseek", "qwen", "grok", "phi", "nova", "titan", "jamba")
VENDORS = ("openai", "anthropic", "google", "meta-llama", "mistralai", "perplexity", "cohere", "deepseek", "qwen", "x-ai", "amazon", "microsoft")
#: How statements of the SQL grammar begin: queries, changes of rows, definitions, rights.
STATEMENTS = ("select", r"with \w+ as", "insert into", "update", "delete from", "merge into", "truncate table", r"create (?:or replace )?(?:table|view|index|schema|function|policy|trigger)", "alter table", "drop (?:table|view|index)", "grant", "revoke")
#: What texts say that instruct a model, in our words.
PROMPTS = ("you are", "you must", "your task", "act as", "respond with", "respond in", "answer the", "do not", "must not", "instruction", "system prompt", "assistant", "the user")
#: Schemes of stores and queues in connection strings, and hosts of the own machine. Fixed values.
STORES = ("postgres", "postgresql", "mysql", "mongodb", "mongodb+srv", "redis", "amqp", "s3", "gs")
LOOPBACK = ("localhost", "127.0.0.1", "0.0.0.0", "[::1]", "host.docker.internal")
_NAME = "abcdefghijklmnopqrstuvwxyz0123456789_.:-"


def literal(text: str) -> str:
    """text as a string literal of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(values) -> str:
    return ", ".join(map(literal, values))


def _found(v: str, names: list[str]) -> str:
    """Whether a value has a hit of one of the rules; a rule is tried where one of its NEEDED strings stands."""
    tried = []
    for name, _, _, pattern in DETECTORS:
        if name in names:
            held = " OR ".join(f"contains({v}, {literal(x)})" for x in NEEDED[name])
            tried.append(f"(({held}) AND {v} RLIKE {literal(pattern)})")
    return "(" + " OR ".join(tried) + ")"


def _placeholder(v: str) -> str:
    """The CASE that gives a value's placeholder: what it is, not what it says."""
    low, n = f"lower({v})", f"length({v})"
    kept = "NOT (" + " OR ".join(f"{v} RLIKE {literal(p)}" for _, p in SUPPRESSED) + ")"
    secrets = [name for name, kind, _, _ in DETECTORS if kind == "secret"]
    personal = [name for name, kind, _, _ in DETECTORS if kind == "personal" and name not in ("email", "card_number")]
    cards = f"({v} RLIKE '[0-9]{{13}}' AND exists(regexp_extract_all({v}, '[0-9]{{13,}}', 0), x -> length(x) BETWEEN 13 AND 19 AND luhn_check(x)))"
    family = " OR ".join(f"startswith({low}, {literal(m)})" for m in MODELS)
    plain = f"translate({low}, '{_NAME}', '') = ''"
    vendor = f"split_part({low}, '/', 1) IN ({_listed(VENDORS)}) AND {low} RLIKE '^[^/]+/[^/]+$' AND translate({low}, '{_NAME}/', '') = ''"
    opens = literal(r"^\s*(?:" + "|".join(s.replace(" ", r"\s+") for s in STATEMENTS) + r")\s")
    host = f"regexp_extract({low}, {literal(r'^https?://(\[[^\]]*\]|[^/:?#]*)')}, 1)"
    scheme = f"substring_index({low}, '://', 1)"
    labels = f"split({low}, '[.]')"
    label = literal("^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$")
    cases = [
        (f"{_found(v, secrets)} AND {kept}", "'<dropped:secret>'"),
        (f"{v} IN ({_listed(PASSED)}) OR ({n} <= 128 AND (({family}) AND {plain} OR {vendor}))", v),
        (f"{_found(v, ['email'])} AND {kept}", "'<str:email>'"),
        (f"{_found(v, personal)} OR {cards}", "'<str:pii>'"),
        (f"{host} IN ({_listed(LOOPBACK)})", "'<str:url:internal>'"),
        (f"startswith({low}, 'http://') OR startswith({low}, 'https://')", "'<str:url:external>'"),
        (f"contains({v}, '://') AND {scheme} IN ({_listed(STORES)})", "'<str:connection_string>'"),
        (f"{low} RLIKE {opens}", f"concat('<str:sql:len:', {n}, '>')"),
        (f"{n} > 60 AND {low} RLIKE {literal('|'.join(PROMPTS))}", f"concat('<str:prompt:len:', {n}, '>')"),
        (f"{n} < 80 AND startswith({v}, '/') AND translate({low}, '{_NAME}/[]{{}}', '') = ''", f"concat('<str:path:segments:', size(split({v}, '/')) - 1, '>')"),
        (f"startswith({v}, './') OR startswith({v}, '../')", "'<str:relpath>'"),
        (f"{n} = 36 AND translate({low}, '0123456789abcdef', '0000000000000000') = '00000000-0000-0000-0000-000000000000'", "'<str:uuid>'"),
        (f"{v} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}' AND try_to_timestamp(left({v}, 10), 'yyyy-MM-dd') IS NOT NULL", "'<str:date>'"),
        (f"{n} <= 253 AND size({labels}) BETWEEN 2 AND 6 AND element_at({labels}, -1) RLIKE '^[a-z]{{2,18}}$' AND forall({labels}, x -> x RLIKE {label})", "'<str:domain>'"),
    ]
    return "CASE WHEN " + " WHEN ".join(f"{when} THEN {then}" for when, then in cases) + f" ELSE concat('<str:len:', {n}, '>') END"


def _glob(path: str, glob: str) -> str:
    """Whether a path is of a glob: ** for any folders, * and ? within one, and a glob without a slash also for the last part of a path."""
    quoted = f"regexp_replace({glob}, {literal('([^A-Za-z0-9_/*?-])')}, {literal(chr(92) * 2 + '$1')})"
    marked = f"replace(replace(replace(replace({quoted}, '**/', '\\u0001'), '**', '\\u0002'), '*', '[^/]*'), '?', '[^/]')"
    whole = f"replace(replace({marked}, '\\u0001', '(?:.*/)?'), '\\u0002', '.*')"
    return f"{path} RLIKE concat('^', CASE WHEN contains({glob}, '/') THEN '' ELSE '(?:.*/)?' END, {whole}, '$')"


FUNCTIONS = {
    "mask_value(value STRING) RETURNS STRING": "concat(left(value, 4), '…')",
    "severity_rank(severity STRING) RETURNS INT": "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES)) + " ELSE 99 END",
    "glob_like(path STRING, glob STRING) RETURNS BOOLEAN": _glob("path", "glob"),
    "placeholder_of(value STRING) RETURNS STRING": _placeholder("value"),
}


def register(spark: SparkSession) -> None:
    """Makes the FUNCTIONS known to the session's SQL."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
