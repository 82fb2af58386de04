"""Return on investment over all projects: counts, traced ranges, alternatives, exposure and retrofit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roi_counts(gaps: DataFrame, project: str) -> DataFrame:
    """(project, gaps, critical, high, files) per project."""
    s = F.col("severity")
    return gaps.groupBy(project).agg(F.count("*").alias("gaps"), F.count_if(s == "critical").alias("critical"), F.count_if(s == "high").alias("high"), F.count_distinct("file").alias("files"))


def traced_ranges(counts: DataFrame, bands: DataFrame, project: str) -> DataFrame:
    """(project, key, low, high, unsourced): count x band / divisor; and key `total`, the sum.

    counts: project, key, n; bands: key, low, high, divisor, source.
    """
    each = counts.join(F.broadcast(bands), "key").select(project, "key", (F.col("n") * F.col("low") / F.col("divisor")).alias("low"), (F.col("n") * F.col("high") / F.col("divisor")).alias("high"), F.col("source").isNull().alias("unsourced"))
    total = each.groupBy(project).agg(F.lit("total").alias("key"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.bool_or("unsourced").alias("unsourced"))
    both = each.unionByName(total.select(each.columns))
    return both.withColumn("low", F.round("low", 4)).withColumn("high", F.round("high", 4))


def alternatives(totals: DataFrame, rates: DataFrame, project: str) -> DataFrame:
    """(project, low, high) over the alternatives' hourly rates: lowest low to highest high; money is null for students.

    totals: project, low, high hours, profile; rates: alternative, rate_low, rate_high.
    """
    bound = rates.agg(F.min("rate_low").alias("rl"), F.max("rate_high").alias("rh"))
    student = F.col("profile") == "student"
    priced = totals.join(F.broadcast(bound))
    return priced.select(project, F.when(~student, F.round(F.col("low") * F.col("rl"), 2)).alias("money_low"), F.when(~student, F.round(F.col("high") * F.col("rh"), 2)).alias("money_high"))


def cited_exposure(gaps: DataFrame, project: str) -> DataFrame:
    """(project, cited, unquantified, violations): a maximum without an http(s) citation violates the rule."""
    cited, link = F.col("maximum").isNotNull(), F.coalesce(F.col("url").rlike("^https?://"), F.lit(False))
    return gaps.groupBy(project).agg(F.count_if(cited).alias("cited"), F.count_if(~cited).alias("unquantified"), F.count_if(cited & ~link).alias("violations"))


def retrofit(gaps: DataFrame, project: str, low: float = 2.0, high: float = 6.0) -> DataFrame:
    """(project, gaps, days_now, days_low, days_high): days after launch are days now times a band."""
    days = F.sum("days")
    return gaps.where("pre_launch").groupBy(project).agg(F.count("*").alias("gaps"), F.round(days, 2).alias("days_now"), F.round(days * low, 2).alias("days_low"), F.round(days * high, 2).alias("days_high"))


def spend_vs_value(spend: DataFrame, ranges: DataFrame) -> DataFrame:
    """(run_id, cost, minutes, reported, hours_low, hours_high): what a run cost next to the hours that it replaces."""
    cost = spend.groupBy("run_id").agg(F.round(F.sum("cost"), 4).alias("cost"), F.round((F.unix_millis(F.max(F.col("ts").cast("timestamp"))) - F.unix_millis(F.min(F.col("ts").cast("timestamp")))) / 60000, 1).alias("minutes"), F.bool_or("reported").alias("reported"))
    return cost.join(ranges, "run_id", "left")


def unsourced_assumptions(defaults: DataFrame, overrides: DataFrame, projects: DataFrame) -> DataFrame:
    """(key, projects): bands that projects rely on without a source, but for n/a; an override wins over the default."""
    every = projects.join(F.broadcast(defaults.select("key", F.col("source").alias("default_source"))))
    own = every.join(overrides.select("project", "key", F.col("source").alias("own"), F.lit(True).alias("has")), ["project", "key"], "left")
    source = F.when(F.col("has"), F.col("own")).otherwise(F.col("default_source"))
    return own.where(source.isNull() & (F.col("key") != "n/a")).groupBy("key").agg(F.count("*").alias("projects"))
