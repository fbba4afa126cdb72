"""Streaming forms over the events table, each equal to its batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.plans.registry import query
from siltstone.streaming import events as ev
from siltstone.streaming import ingest as ing


def stream(t):
    return ev.read_events(t.spark, t._dir)


@query("t1_ingest_once", "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def t1(t):
    e = stream(t).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return ev.run_updates(ev.first_of_each(e, ["user_id", "event_type", "day"]), ["user_id", "event_type", "day"], mode="append")


@query("t3_daily_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def t3(t):
    out = ev.run_updates(ev.windowed_counts(stream(t), ["event_type"], "1 day"), ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("t4_rate_limit_stream", "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*)::BIGINT AS n, count(*) > 2 AS over_limit FROM events GROUP BY ALL")
def t4(t):
    out = ev.run_updates(ev.windowed_counts(stream(t), ["user_id"], "1 hour"), ["start", "user_id"])
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n", (F.col("n") > 2).alias("over_limit"))


@query("t6_online_fp_rates", "SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS tp FROM events GROUP BY user_id")
def t6(t):
    return ev.run_updates(ev.online_rates(stream(t), ["user_id"], F.col("event_type") == "error", F.col("event_type") == "purchase"), ["user_id"])


@query("t11_last_state_stream", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def t11(t):
    return ev.run_updates(ev.last_state(stream(t), "user_id", ["event_id", "event_type"]), ["user_id"])


@query("t2_ingest_summaries", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def t2(t):
    kept = ev.keep_batches(stream(t), lambda b: b.groupBy("event_type").agg(F.count("*").alias("n")), ev.shared_folder(t.spark))
    return kept.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("t7_voter_state", "SELECT user_id AS voter, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::DOUBLE AS \"right\", count(*)::DOUBLE AS mass FROM events GROUP BY user_id")
def t7(t):
    """One batch, so nothing has faded yet."""
    e = stream(t).select(F.col("user_id").alias("voter"), (F.col("event_type") != "error").cast("int").alias("right"))
    return ev.carry_voters(e, ev.shared_folder(t.spark)).select("voter", F.round("right", 6).alias("right"), F.round("mass", 6).alias("mass"))


@query("t10_bucket_stream", "WITH s AS (SELECT CASE WHEN event_id % 13 < 4 THEN 'low' WHEN event_id % 13 < 9 THEN 'mid' ELSE 'high' END AS bucket FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT bucket, count(*)::BIGINT AS repos FROM s GROUP BY bucket")
def t10(t):
    issues = F.col("event_id") % 13
    e = stream(t).select("user_id", "ts", "event_id", F.when(issues < 4, "low").when(issues < 9, "mid").otherwise("high").alias("bucket"))
    kept = ev.keep_batches(ev.bucket_transitions(e, "user_id", "bucket"), lambda b: b, ev.shared_folder(t.spark))
    return kept.groupBy("bucket").agg(F.sum("delta").alias("repos"))


SEVERITIES = ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO")
#: An event is an analysis of its user's repository, with a finding for each number below event_id % 13.
INGESTED = """WITH f AS (SELECT user_id AS repo, event_id AS analysis_id, ts, 'i' || ((event_id * 7 + k * 5) % 40) AS fingerprint, 'R' || (k % 4) AS rule_id, ['BLOCKER', 'CRITICAL', 'MAJOR', 'MINOR', 'INFO'][(event_id + k) % 5 + 1] AS severity, 5 * (k + 1) AS effort FROM (SELECT *, unnest(range(event_id % 13)) AS k FROM events)),
s AS (SELECT user_id AS repo, event_id AS analysis_id, ts, 100 + event_id % 900 AS loc, (SELECT count(*) FROM f WHERE f.analysis_id = event_id) AS findings, (SELECT count(*) FROM f WHERE f.analysis_id = event_id AND severity IN ('BLOCKER', 'CRITICAL')) AS severe, (SELECT coalesce(sum(effort), 0) FROM f WHERE f.analysis_id = event_id) AS debt FROM events)"""


def analyses_stream(t):
    return stream(t).select(F.col("user_id").alias("repo"), F.col("event_id").alias("analysis_id"), "ts", (100 + F.col("event_id") % 900).alias("loc"))


def findings_of(analyses):
    i, k = F.col("analysis_id"), F.col("k")
    rows = analyses.where(i % 13 > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), i % 13 - 1)))
    severity = F.element_at(F.array(*map(F.lit, SEVERITIES)), ((i + k) % 5 + 1).cast("int"))
    return rows.select("repo", "analysis_id", "ts", F.concat(F.lit("i"), ((i * 7 + k * 5) % 40).cast("string")).alias("fingerprint"), F.concat(F.lit("R"), (k % 4).cast("string")).alias("rule_id"), severity.alias("severity"), (5 * (k + 1)).alias("effort"))


@query("t2_ingested_issues", INGESTED + " SELECT repo, fingerprint, arg_min(analysis_id, (ts, analysis_id)) AS first_analysis, arg_max(analysis_id, (ts, analysis_id)) AS last_analysis, arg_max(severity, (ts, analysis_id, rule_id, severity)) AS severity, count(DISTINCT analysis_id)::BIGINT AS seen FROM f GROUP BY repo, fingerprint")
def t2_issues(t):
    """Issues after a stream of analyses: when each was first and last seen, and what was said of it last."""
    issues = ing.ingest_analyses(analyses_stream(t), findings_of).state("issues")
    return issues.select("repo", "fingerprint", F.col("first.analysis_id").alias("first_analysis"), F.col("last.analysis_id").alias("last_analysis"), "last.severity", "seen")


@query("t2_ingested_repos", INGESTED + " SELECT repo, arg_max(analysis_id, (ts, analysis_id)) AS last_analysis, arg_max(findings, (ts, analysis_id))::BIGINT AS open_issues, arg_max(debt, (ts, analysis_id))::BIGINT AS debt, arg_max(severe = 0, (ts, analysis_id)) AS passed, count(*)::BIGINT AS analyses, count(*) FILTER (WHERE severe > 0)::BIGINT AS failed FROM s GROUP BY repo")
def t2_repos(t):
    repos = ing.ingest_analyses(analyses_stream(t), findings_of).state("repos")
    return repos.select("repo", F.col("last.analysis_id").alias("last_analysis"), F.col("last.findings").alias("open_issues"), "last.debt", "last.passed", "analyses", "failed")


@query("t2_ingested_days", INGESTED + " SELECT repo, strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS analyses, sum(findings)::BIGINT AS findings, sum(debt)::BIGINT AS debt FROM s GROUP BY ALL")
def t2_days(t):
    return ing.ingest_analyses(analyses_stream(t), findings_of).state("days")
