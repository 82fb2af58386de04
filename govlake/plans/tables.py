"""Test bindings: the given tables as assets, ledgers and so on, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.functions.rules import DETECTORS, SUPPRESSED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as assets (path, content, project, lang, doc_id)."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"), F.col("source").alias("project"), "lang", "doc_id")


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def sql_values(values: list[tuple], names: str) -> str:
    text = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in values)}) AS v({names})"


ASSETS = "a AS (SELECT concat_ws('/', source, lang, 'doc_' || doc_id || '.txt') AS path, text AS content, source AS project, lang, doc_id FROM documents)"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


LUHN = "list_sum(list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN (length({v}) - i) % 2 = 1 THEN (2 * CAST(substr({v}, i, 1) AS INT)) // 10 + (2 * CAST(substr({v}, i, 1) AS INT)) % 10 ELSE CAST(substr({v}, i, 1) AS INT) END)) % 10 = 0"


def hits_sql(source: str = "a", key: str = "path", content: str = "content") -> str:
    """Raw hits of every rule over `source`."""
    parts = []
    for rule, kind, severity, pattern in DETECTORS:
        # A hit stands behind the texts between the hits before it, and those hits.
        before = "array_to_string(g[1:k], '') || array_to_string(f[1:k - 1], '')"
        own = f"WHERE length(f[k]) BETWEEN 13 AND 19 AND {LUHN.format(v='f[k]')}" if rule == "card_number" else ""
        rows = f"SELECT {key}, f, g, unnest(range(1, len(f) + 1)) AS k FROM (SELECT {key}, regexp_extract_all({content}, {quoted(pattern)}) AS f, string_split_regex({content}, {quoted(pattern)}) AS g FROM {source})"
        parts.append(f"SELECT {key}, '{rule}' AS rule, '{kind}' AS kind, '{severity}' AS severity, f[k] AS value, length({before}) AS pos, length({before}) - length(replace({before}, chr(10), '')) + 1 AS line FROM ({rows}) {own}")
    return " UNION ALL ".join(parts)


SUPPRESSED_SQL = " OR ".join(f"regexp_matches(value, {quoted(p)})" for _, p in SUPPRESSED)
REASON_SQL = "CASE " + " ".join(f"WHEN regexp_matches(value, {quoted(p)}) THEN '{n}'" for n, p in SUPPRESSED) + " END"
RANK_SQL = "CASE {c} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 99 END"
