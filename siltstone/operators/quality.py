"""Gates, ratings, rollups and portfolio series: group-bys and windows over findings, analyses and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.quality import debt_ratio, failed_conditions, gate_status
from siltstone.functions.severity import rating_of_debt, rating_of_rank, severity_rank


def analysis_summary(found: DataFrame, by: list[str]) -> DataFrame:
    """Totals per analysis. Suppressed findings count in the totals, but not in debt, ratings or blockers.

    ``new_code`` narrows the blockers only. Needs severity, type, effort, suppressed, new_code.
    """
    live = ~F.col("suppressed")
    is_type = lambda *k: F.col("type").isin(*k)
    rank = severity_rank(F.col("severity"))
    count = lambda c: F.count_if(c)
    return found.groupBy(*by).agg(
        F.count("*").alias("total"),
        *(count(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO")),
        *(count(F.col("type") == k).alias(f"t_{k.lower()}") for k in ("VULNERABILITY", "BUG", "CODE_SMELL", "SECURITY_HOTSPOT")),
        count(F.col("suppressed")).alias("suppressed"),
        F.coalesce(F.sum(F.when(live & is_type("CODE_SMELL"), F.col("effort"))), F.lit(0)).cast("long").alias("debt_min"),
        count(live & (F.col("severity") == "BLOCKER") & F.col("new_code")).alias("blockers"),
        rating_of_rank(F.max(F.when(live & is_type("VULNERABILITY", "SECURITY_HOTSPOT"), rank))).alias("security"),
        rating_of_rank(F.max(F.when(live & is_type("BUG"), rank))).alias("reliability"),
    )


def with_gate(summary: DataFrame, loc: Column, coverage: Column, branch: Column, duplication: Column) -> DataFrame:
    """Adds debt ratio, maintainability rating, the failed conditions and the gate."""
    out = summary.withColumn("debt_ratio", debt_ratio(F.col("debt_min"), loc)).withColumn("maintainability", rating_of_debt(F.col("debt_ratio")))
    out = out.withColumn("failed", failed_conditions(coverage, branch, duplication, F.col("blockers"), F.col("security"), F.col("maintainability")))
    return out.withColumn("gate", gate_status(F.col("failed")))


def rollup_repos(repos: DataFrame, by: list[str]) -> DataFrame:
    """Sums, worst ratings, and a gate that passes if every repository's does."""
    return repos.groupBy(*by).agg(
        F.count("*").alias("repos"),
        F.sum("debt_min").alias("debt_min"),
        F.sum("open_issues").alias("open_issues"),
        F.max("maintainability").alias("maintainability"),
        F.max("security").alias("security"),
        F.when(F.every(F.col("gate") == "PASSED"), "PASSED").otherwise("FAILED").alias("gate"),
    )


def fp_rates(feedback: DataFrame, by: list[str]) -> DataFrame:
    """False and true positives of each group; the rate of nothing is 0."""
    g = feedback.groupBy(*by).agg(F.count_if(F.col("verdict") == "false_positive").alias("fp"), F.count_if(F.col("verdict") == "confirmed").alias("tp"))
    n = F.col("fp") + F.col("tp")
    return g.withColumn("n", n).withColumn("rate", F.when(n > 0, F.round(F.col("fp") / n, 6)).otherwise(0.0))


def suppress(found: DataFrame, rates: DataFrame, by: list[str], least: int = 5, rate: float = 0.6) -> DataFrame:
    """Flags findings whose rule is mostly wrong, by enough verdicts."""
    r = rates.select(*by, "n", "rate")
    return found.join(r, by, "left").withColumn("suppressed", F.coalesce((F.col("n") >= least) & (F.col("rate") >= rate), F.lit(False))).drop("n", "rate")


def daily_counters(events: DataFrame, unit: str) -> DataFrame:
    """Builds, failures, lines and issues per day or month."""
    return events.groupBy(F.date_format(F.date_trunc(unit, "ts"), "yyyy-MM-dd").alias("period")).agg(
        F.count("*").alias("builds"), F.count_if(~F.col("passed")).alias("failed"), F.sum("loc").alias("loc"), F.sum("issues").alias("issues")
    )


def latest(events: DataFrame, key: str, n: int = 1) -> DataFrame:
    """The last n rows of each key by time, then id."""
    w = W.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def as_of_days(events: DataFrame, key: str, values: list[str]) -> DataFrame:
    """For every key and every day of the whole span, its last snapshot up to that day (null before its first)."""
    own = events.withColumn("day", F.to_date("ts")).groupBy(key, "day").agg(F.max_by(F.struct(*values), F.struct("ts", "event_id")).alias("snap"))
    span = own.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    spine = own.select(key).distinct().crossJoin(F.broadcast(days))
    w = W.partitionBy(key).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    filled = spine.join(own, [key, "day"], "left").withColumn("snap", F.last("snap", ignorenulls=True).over(w))
    return filled.select(key, "day", *(F.col(f"snap.{v}").alias(v) for v in values))


def portfolio_days(series: DataFrame) -> DataFrame:
    """Per day: repositories seen, coverage weighted by lines (weight 1 where there are none), sums and pass share."""
    seen = series.where("loc is not null")
    weight = F.when(F.col("loc") > 0, F.col("loc")).otherwise(1)
    covered = F.when(F.col("coverage").isNotNull(), weight)
    return seen.groupBy("day").agg(
        F.count("*").alias("repos"),
        F.round(F.sum(F.col("coverage") * weight) / F.sum(covered), 4).alias("coverage"),
        F.sum("loc").alias("loc"),
        F.sum("issues").alias("issues"),
        F.max("issues").alias("most_issues"),
        F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_share"),
    )


def freshness(events: DataFrame, keys: DataFrame, key: str, stale_days: int = 7) -> DataFrame:
    """Whole days since each key's last event, counted from the newest event; never seen sorts as 9999."""
    now = events.agg(F.max("ts").alias("now"))
    last = events.groupBy(key).agg(F.max("ts").alias("last"))
    out = keys.join(last, key, "left").crossJoin(F.broadcast(now))
    days = F.floor((F.unix_timestamp("now") - F.unix_timestamp("last")) / 86400)
    return out.select(key, F.coalesce(days, F.lit(9999)).cast("long").alias("days"), (F.col("last").isNull() | (days >= stale_days)).alias("stale"))
