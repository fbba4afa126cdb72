"""Ingest of analyses as a stream: each micro-batch leaves its summaries, changes of issues and changes of rollups.

What a batch leaves are tables of its own, and a replayed batch overwrites them, so nothing counts twice. Issues and
rollups are kept as mergeable changes (least, greatest, sum, last), and the state is their merge: a batch reads nothing of
what was before. Every MERGED batches, all finished changes become one table, so reading the state never opens more than
that many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.severity import severity_rank
from siltstone.streaming.events import batches_of, ingest, shared_folder

#: Batches whose changes are merged into one table.
MERGED = 16
ISSUE_KEYS, REPO_KEYS, DAY_KEYS = ("repo", "fingerprint"), ("repo",), ("repo", "day")
SEVERE = ("BLOCKER", "CRITICAL")


def first_of(column: str, by: str) -> Column:
    return F.min_by(column, by)


def issue_changes(findings: DataFrame) -> DataFrame:
    """Of findings (repo, analysis_id, ts, fingerprint, rule_id, severity): each issue's first and last analysis, how often
    it was seen, and what the last one said of it. Analyses come in the order of ts and id."""
    at = F.struct("ts", "analysis_id")
    said = F.struct("ts", "analysis_id", "rule_id", "severity")
    return findings.groupBy(*ISSUE_KEYS).agg(F.min(at).alias("first"), F.max(said).alias("last"), F.count_distinct("analysis_id").alias("seen"))


def merged_issues(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*ISSUE_KEYS).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("seen").alias("seen"))


def summaries(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """Per analysis (repo, analysis_id, ts, loc): findings, severe ones, debt in minutes, worst rank, debt per 30 minutes a
    line, and whether the gate is passed (no severe finding)."""
    n = findings.groupBy("repo", "analysis_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity").isin(*SEVERE)).alias("severe"), F.sum("effort").alias("debt"), F.max(severity_rank(F.col("severity"))).alias("worst"))
    j = analyses.join(n, ["repo", "analysis_id"], "left").na.fill(0, ["findings", "severe", "debt", "worst"])
    ratio = F.when(F.col("loc") > 0, F.col("debt") / (F.col("loc") * 30)).otherwise(0.0)
    return j.select("repo", "analysis_id", "ts", "loc", "findings", "severe", "debt", "worst", ratio.alias("debt_ratio"), (F.col("severe") == 0).alias("passed"))


def repo_changes(summary: DataFrame) -> DataFrame:
    """Each repository's last analysis and its running counters."""
    last = F.struct("ts", "analysis_id", "loc", "findings", "severe", "debt", "passed")
    return summary.groupBy(*REPO_KEYS).agg(F.max(last).alias("last"), F.count(F.lit(1)).alias("analyses"), F.count_if(~F.col("passed")).alias("failed"))


def merged_repos(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*REPO_KEYS).agg(F.max("last").alias("last"), F.sum("analyses").alias("analyses"), F.sum("failed").alias("failed"))


def day_changes(summary: DataFrame) -> DataFrame:
    return summary.groupBy("repo", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("analyses"), F.sum("findings").alias("findings"), F.sum("debt").alias("debt"))


def merged_days(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*DAY_KEYS).agg(*(F.sum(c).alias(c) for c in ("analyses", "findings", "debt")))


MERGES = {"issues": merged_issues, "repos": merged_repos, "days": merged_days}


class Ingested:
    """What a folder holds of a stream, batch by batch."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def changes(self, name: str, upto: int | None = None) -> DataFrame | None:
        """The newest merged table and all changes after it, of batches to ``upto``."""
        known = lambda kind: [n for n in batches_of(self.spark, self.folder, kind) if upto is None or n <= upto]
        merged = known(f"{name}-merged")
        base = merged[-1] if merged else -1
        paths = [f"{self.folder}/{name}-merged-{base}"] * bool(merged) + [f"{self.folder}/{name}-{n}" for n in known(name) if n > base]
        return self.spark.read.parquet(*paths) if paths else None

    def state(self, name: str) -> DataFrame | None:
        """Issues, repos or days as they are after all finished batches; None before the first."""
        found = self.changes(name)
        return None if found is None else MERGES[name](found)

    def summaries(self) -> DataFrame | None:
        done = batches_of(self.spark, self.folder, "summary")
        return self.spark.read.parquet(*(f"{self.folder}/summary-{n}" for n in done)) if done else None

    def write(self, batch_id: int, analyses: DataFrame, findings: DataFrame) -> None:
        """The tables of one batch, each overwritten if it is there."""
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{self.folder}/{name}-{batch_id}")
        put(summaries(analyses, findings), "summary")
        summary = self.spark.read.parquet(f"{self.folder}/summary-{batch_id}")
        for name, df in (("issues", issue_changes(findings)), ("repos", repo_changes(summary)), ("days", day_changes(summary))):
            put(df, name)
            if batch_id % MERGED == MERGED - 1:
                put(MERGES[name](self.changes(name, batch_id)), f"{name}-merged")


def ingest_analyses(stream: DataFrame, findings_of, folder: str | None = None) -> Ingested:
    """Runs a stream of analyses (repo, analysis_id, ts, loc and what ``findings_of`` needs) to its end.

    ``findings_of`` makes a batch's findings (repo, analysis_id, ts, fingerprint, rule_id, severity, effort). An analysis
    that comes again in a batch is one; across batches, drop repeats first by a watermark.
    """
    spark = stream.sparkSession
    kept = Ingested(spark, folder or shared_folder(spark))

    def step(batch: DataFrame, batch_id: int) -> None:
        once = batch.dropDuplicates(["repo", "analysis_id"])
        kept.write(batch_id, once.select("repo", "analysis_id", "ts", "loc"), findings_of(once))

    ingest(stream, step, f"{kept.folder}/run")
    return kept


def run_counting_late(counts: DataFrame, folder: str, handle) -> int:
    """Runs a watermarked aggregate (update mode) and returns how many rows came behind the watermark and were left out.

    The number is the one that Spark's own progress reports for the stateful operator of every batch.
    """
    q = counts.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
