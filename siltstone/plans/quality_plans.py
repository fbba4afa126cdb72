"""Queries on analyses, gates, ratings, portfolio series and catalogue reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import quality as q
from siltstone.functions import severity as sv
from siltstone.operators import quality as o
from siltstone.plans.fixtures import ANALYSIS, FINDING, RANK, analyses, files, found
from siltstone.plans.registry import query

LONG = lambda *names: [F.col(n).cast("long").alias(n) for n in names]

RATE_OF_RANK = "CASE coalesce({}, 0) WHEN 5 THEN 'E' WHEN 4 THEN 'D' WHEN 3 THEN 'C' WHEN 2 THEN 'B' ELSE 'A' END"
RATE_OF_DEBT = "CASE WHEN {0} <= 0.05 THEN 'A' WHEN {0} <= 0.1 THEN 'B' WHEN {0} <= 0.2 THEN 'C' WHEN {0} <= 0.5 THEN 'D' ELSE 'E' END"
SUMMARY = (
    FINDING
    + f""", f AS (SELECT *, {RANK} AS rank, doc_id % 6 = 0 AS suppressed, doc_id % 2 = 0 AS new_code FROM finding),
loc AS (SELECT source, count(*) AS loc FROM line GROUP BY source),
summary AS (SELECT source, count(*) AS total, sum(CASE WHEN suppressed THEN 1 ELSE 0 END) AS suppressed, coalesce(sum(CASE WHEN NOT suppressed AND type = 'CODE_SMELL' THEN effort END), 0) AS debt_min,
 sum(CASE WHEN NOT suppressed AND severity = 'BLOCKER' AND new_code THEN 1 ELSE 0 END) AS blockers,
 {RATE_OF_RANK.format("max(CASE WHEN NOT suppressed AND type IN ('VULNERABILITY', 'SECURITY_HOTSPOT') THEN rank END)")} AS security,
 {RATE_OF_RANK.format("max(CASE WHEN NOT suppressed AND type = 'BUG' THEN rank END)")} AS reliability,
 sum(CASE WHEN severity = 'BLOCKER' THEN 1 ELSE 0 END) AS n_blocker, sum(CASE WHEN type = 'BUG' THEN 1 ELSE 0 END) AS t_bug FROM f GROUP BY source),
gated0 AS (SELECT *, debt_min / (greatest(1, loc) * 30) AS debt_ratio, CASE WHEN loc % 3 = 0 THEN NULL ELSE 70 + loc % 30 END AS coverage, CASE WHEN loc % 4 = 0 THEN NULL ELSE loc % 6 END AS duplication FROM summary JOIN loc USING (source)),
gated1 AS (SELECT *, {RATE_OF_DEBT.format("debt_ratio")} AS maintainability FROM gated0),
gated AS (SELECT *, concat_ws(',', CASE WHEN coverage < 80 THEN 'coverage' END, CASE WHEN duplication > 3 THEN 'duplication' END, CASE WHEN blockers > 0 THEN 'blockers' END, CASE WHEN security > 'A' THEN 'security' END, CASE WHEN maintainability > 'A' THEN 'maintainability' END) AS failed FROM gated1)"""
)


def gated(t):
    f = found(t).withColumn("suppressed", F.col("doc_id") % 6 == 0).withColumn("new_code", F.col("doc_id") % 2 == 0)
    loc = files(t).groupBy("source").agg(F.sum(F.size(F.split("text", r"\r?\n", -1))).alias("loc"))
    s = o.analysis_summary(f, ["source"]).join(loc, "source")
    coverage = F.when(F.col("loc") % 3 != 0, 70 + F.col("loc") % 30)
    duplication = F.when(F.col("loc") % 4 != 0, F.col("loc") % 6)
    return o.with_gate(s, F.col("loc"), coverage, F.lit(None).cast("double"), duplication)


@query("flagship_gate_by_source", f"WITH {SUMMARY} SELECT source, total::BIGINT AS total, suppressed::BIGINT AS suppressed, debt_min::BIGINT AS debt_min, blockers::BIGINT AS blockers, security, reliability, maintainability, failed, CASE WHEN failed = '' THEN 'PASSED' ELSE 'FAILED' END AS gate FROM gated")
def flagship(t):
    return gated(t).select("source", *LONG("total", "suppressed", "debt_min", "blockers"), "security", "reliability", "maintainability", F.array_join("failed", ",").alias("failed"), "gate")


@query("a1_analysis_summary", f"WITH {SUMMARY} SELECT source, total::BIGINT AS total, n_blocker::BIGINT AS n_blocker, t_bug::BIGINT AS t_bug, debt_min::BIGINT AS debt_min FROM summary")
def a1(t):
    return gated(t).select("source", *LONG("total", "n_blocker", "t_bug", "debt_min"))


@query("a14_failed_conditions", f"WITH {SUMMARY} SELECT code, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(failed, ',')) AS code FROM gated WHERE failed <> '') GROUP BY code ORDER BY n DESC, code LIMIT 10")
def a14(t):
    return gated(t).select(F.explode("failed").alias("code")).groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(10)


@query("a2_p37_worst_rating", f"WITH {FINDING} SELECT path, {RATE_OF_RANK.format('max(' + RANK + ')')} AS rating, 6 - (strpos('ABCDE', {RATE_OF_RANK.format('max(' + RANK + ')')}))::INTEGER AS score FROM finding GROUP BY path")
def a2(t):
    r = sv.rating_of_rank(F.max(sv.severity_rank(F.col("severity"))))
    return found(t).groupBy("path").agg(r.alias("rating")).withColumn("score", sv.rating_score(F.col("rating")))


@query("p14_severity_of_priority", "SELECT o_orderkey, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 5 WHEN '2' THEN 4 WHEN '3' THEN 3 WHEN '4' THEN 2 ELSE 1 END AS rank, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'error' WHEN '2' THEN 'error' WHEN '3' THEN 'warning' WHEN '4' THEN 'warning' ELSE 'note' END AS level FROM orders")
def p14(t):
    s = sv.lookup(F.substring("o_orderpriority", 1, 1), dict(zip("12345", sv.SEVERITIES, strict=True)), "INFO")
    return t.orders.select("o_orderkey", sv.severity_rank(s).alias("rank"), sv.severity_level(s).alias("level"))


@query("p15_p16_severities", "SELECT CASE WHEN s >= 9 THEN 'BLOCKER' WHEN s >= 7 THEN 'CRITICAL' WHEN s >= 4 THEN 'MAJOR' WHEN s > 0 THEN 'MINOR' ELSE 'INFO' END AS by_score, CASE l_returnflag WHEN 'A' THEN 'CRITICAL' WHEN 'N' THEN 'MAJOR' WHEN 'R' THEN 'MINOR' ELSE 'INFO' END AS by_level, count(*)::BIGINT AS n FROM (SELECT *, (l_quantity % 11)::DOUBLE AS s FROM lineitem) GROUP BY ALL")
def p15(t):
    score = (F.col("l_quantity") % 11).cast("double")
    level = sv.lookup(F.col("l_returnflag"), {"A": "error", "N": "warning", "R": "note"})
    return t.lineitem.groupBy(sv.severity_of_cvss(score).alias("by_score"), sv.severity_of_level(level).alias("by_level")).agg(F.count("*").alias("n"))


@query(
    "p19_p42_debt_by_order",
    f"""WITH d AS (SELECT l_orderkey, (sum(l_quantity)::BIGINT) * 7 AS debt, count(*) * 40 AS loc FROM lineitem GROUP BY l_orderkey), r AS (SELECT *, debt / (greatest(1, loc) * 30) AS ratio FROM d)
SELECT l_orderkey, debt::BIGINT AS debt, round(ratio, 6) AS ratio, {RATE_OF_DEBT.format("ratio")} AS rating, CASE WHEN debt <= 0 THEN '0min' ELSE concat_ws(' ', CASE WHEN debt // 480 > 0 THEN (debt // 480) || 'd' END, CASE WHEN (debt % 480) // 60 > 0 THEN ((debt % 480) // 60) || 'h' END, CASE WHEN debt % 60 > 0 THEN (debt % 60) || 'min' END) END AS shown FROM r""",
)
def p19(t):
    d = t.lineitem.groupBy("l_orderkey").agg((F.sum("l_quantity").cast("long") * 7).alias("debt"), (F.count("*") * 40).alias("loc"))
    ratio = q.debt_ratio(F.col("debt"), F.col("loc"))
    return d.select("l_orderkey", "debt", F.round(ratio, 6).alias("ratio"), sv.rating_of_debt(ratio).alias("rating"), q.format_debt(F.col("debt")).alias("shown"))


REPOS = "repo AS (SELECT c_custkey, n_name, r_name, (c_custkey * 37) % 5000 AS debt_min, c_custkey % 40 AS open_issues, substring('ABCDE', (c_custkey % 5)::INTEGER + 1, 1) AS maintainability, substring('AABCD', (c_custkey % 7 % 5)::INTEGER + 1, 1) AS security, CASE WHEN c_custkey % 9 = 0 THEN 'FAILED' ELSE 'PASSED' END AS gate FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def repos(t):
    joined = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    return joined.select(
        "c_custkey", "n_name", "r_name", (k * 37 % 5000).alias("debt_min"), (k % 40).alias("open_issues"),
        F.expr("substring('ABCDE', cast(c_custkey % 5 as int) + 1, 1)").alias("maintainability"), F.expr("substring('AABCD', cast(c_custkey % 7 % 5 as int) + 1, 1)").alias("security"),
        F.when(k % 9 == 0, "FAILED").otherwise("PASSED").alias("gate"),
    )


@query("a4_project_rollup", f"WITH {REPOS} SELECT n_name, count(*)::BIGINT AS repos, sum(debt_min)::BIGINT AS debt_min, sum(open_issues)::BIGINT AS open_issues, max(maintainability) AS maintainability, max(security) AS security, CASE WHEN bool_and(gate = 'PASSED') THEN 'PASSED' ELSE 'FAILED' END AS gate FROM repo GROUP BY n_name")
def a4(t):
    return o.rollup_repos(repos(t), ["n_name"]).select("n_name", *LONG("repos", "debt_min", "open_issues"), "maintainability", "security", "gate")


@query("a5_platform_rollup", f"WITH {REPOS} SELECT r_name, n_name, count(*)::BIGINT AS repos, sum(CASE WHEN security = 'A' THEN 1 ELSE 0 END)::BIGINT AS n_a, sum(CASE WHEN security = 'D' THEN 1 ELSE 0 END)::BIGINT AS n_d, max(security) AS worst FROM repo GROUP BY ROLLUP (r_name, n_name)")
def a5(t):
    return repos(t).rollup("r_name", "n_name").agg(F.count("*").alias("repos"), F.count_if(F.col("security") == "A").alias("n_a"), F.count_if(F.col("security") == "D").alias("n_d"), F.max("security").alias("worst"))


FEEDBACK = "feedback AS (SELECT l.doc_id, source, lang, CASE WHEN toxic = 1 THEN 'confirmed' ELSE 'false_positive' END AS verdict FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def feedback(t):
    return t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id").select("doc_id", "source", "lang", F.when(F.col("toxic") == 1, "confirmed").otherwise("false_positive").alias("verdict"))


RATES = FEEDBACK + ", rates AS (SELECT source, fp, tp, fp + tp AS n, CASE WHEN fp + tp > 0 THEN round(fp / (fp + tp), 6) ELSE 0.0 END AS rate FROM (SELECT source, sum(CASE WHEN verdict = 'false_positive' THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN verdict = 'confirmed' THEN 1 ELSE 0 END) AS tp FROM feedback GROUP BY source))"


@query("a9_fp_rates", f"WITH {RATES} SELECT source, fp::BIGINT AS fp, tp::BIGINT AS tp, n::BIGINT AS n, rate FROM rates")
def a9(t):
    return o.fp_rates(feedback(t), ["source"])


@query("j5_gate_suppression", f"WITH {FINDING}, {RATES} SELECT fid, coalesce(n >= 5 AND rate >= 0.9, false) AS suppressed FROM finding LEFT JOIN rates USING (source)")
def j5(t):
    return o.suppress(found(t), o.fp_rates(feedback(t), ["source"]), ["source"], 5, 0.9).select("fid", "suppressed")


@query("j6_catalogue_enrichment", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 25 THEN l_returnflag ELSE p_type END AS type, CASE WHEN l_quantity > 40 THEN l_quantity ELSE p_size END::DOUBLE AS effort FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def j6(t):
    l = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).alias("own_type"), F.when(F.col("l_quantity") > 40, F.col("l_quantity")).alias("own_effort"))
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
    return l.join(p, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("own_type", "p_type").alias("type"), F.coalesce("own_effort", "p_size").cast("double").alias("effort"))


@query("j7_overlay_merge", "WITH o AS (SELECT p_partkey, 'over' AS origin, p_size + 100 AS size FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey + 1000000, 'own', p_size FROM part WHERE p_partkey % 100 = 0) SELECT coalesce(o.p_partkey, p.p_partkey) AS p_partkey, coalesce(o.size, p.p_size)::BIGINT AS size, coalesce(o.origin, 'base') AS origin FROM part p FULL OUTER JOIN o ON o.p_partkey = p.p_partkey")
def j7(t):
    from siltstone.operators.joins import overlay

    over = t.part.where("p_partkey % 3 = 0").select("p_partkey", F.lit("over").alias("origin"), (F.col("p_size") + 100).alias("size"))
    more = t.part.where("p_partkey % 100 = 0").select((F.col("p_partkey") + 1000000).alias("p_partkey"), F.lit("own").alias("origin"), F.col("p_size").alias("size"))
    base = t.part.select("p_partkey", F.lit("base").alias("origin"), F.col("p_size").alias("size"))
    return overlay(base, over.unionByName(more), "p_partkey").select("p_partkey", F.col("size").cast("long").alias("size"), "origin")


@query("a7_daily_counters", f"WITH {ANALYSIS} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, count(*)::BIGINT AS builds, sum(CASE WHEN passed THEN 0 ELSE 1 END)::BIGINT AS failed, sum(loc)::BIGINT AS loc, sum(issues)::BIGINT AS issues FROM analysis GROUP BY 1")
def a7(t):
    return o.daily_counters(analyses(t), "day")


@query("a7_monthly_counters", f"WITH {ANALYSIS} SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS period, count(*)::BIGINT AS builds, sum(CASE WHEN passed THEN 0 ELSE 1 END)::BIGINT AS failed, sum(loc)::BIGINT AS loc, sum(issues)::BIGINT AS issues FROM analysis GROUP BY 1")
def a7m(t):
    return o.daily_counters(analyses(t), "month")


@query("a8_repo_last_state", f"WITH {ANALYSIS} SELECT repo, count(*)::BIGINT AS builds, sum(issues)::BIGINT AS issues, arg_max(event_id, (ts, event_id)) AS last_event, arg_max(loc, (ts, event_id))::BIGINT AS last_loc FROM analysis GROUP BY repo")
def a8(t):
    at = F.struct("ts", "event_id")
    return analyses(t).groupBy("repo").agg(F.count("*").alias("builds"), F.sum("issues").alias("issues"), F.max_by("event_id", at).alias("last_event"), F.max_by("loc", at).alias("last_loc"))


@query("w4_latest_40", f"WITH {ANALYSIS} SELECT repo, event_id FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, event_id DESC) AS k FROM analysis) WHERE k <= 40")
def w4(t):
    return o.latest(analyses(t), "repo", 40).select("repo", "event_id")


SERIES = (
    ANALYSIS
    + """, own AS (SELECT repo, ts::DATE AS day, arg_max(event_id, (ts, event_id)) AS event_id FROM analysis GROUP BY 1, 2), span AS (SELECT min(day) AS a, max(day) AS b FROM own),
days AS (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM span), spine AS (SELECT repo, day FROM (SELECT DISTINCT repo FROM own), days),
filled AS (SELECT s.repo, s.day, o.event_id FROM spine s ASOF LEFT JOIN own o ON s.repo = o.repo AND s.day >= o.day),
series AS (SELECT f.repo, f.day, a.loc, a.issues, a.coverage, a.passed FROM filled f LEFT JOIN analysis a ON f.event_id = a.event_id)"""
)


@query("j15_as_of_days", f"WITH {SERIES} SELECT repo, strftime(day, '%Y-%m-%d') AS day, loc::BIGINT AS loc, issues::BIGINT AS issues, round(coverage, 4) AS coverage FROM series")
def j15(t):
    return o.as_of_days(analyses(t), "repo", ["loc", "issues", "coverage"]).select("repo", F.date_format("day", "yyyy-MM-dd").alias("day"), *LONG("loc", "issues"), F.round("coverage", 4).alias("coverage"))


@query(
    "a13_portfolio_days",
    f"""WITH {SERIES} SELECT strftime(day, '%Y-%m-%d') AS day, count(*)::BIGINT AS repos, round(sum(coverage * loc) / sum(CASE WHEN coverage IS NOT NULL THEN loc END), 4) AS coverage, sum(loc)::BIGINT AS loc, sum(issues)::BIGINT AS issues, max(issues)::BIGINT AS most_issues, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS pass_share FROM series WHERE loc IS NOT NULL GROUP BY day""",
)
def a13(t):
    d = o.portfolio_days(o.as_of_days(analyses(t), "repo", ["loc", "issues", "coverage", "passed"]))
    return d.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("a18_freshness", "WITH e AS (SELECT o_custkey, max(o_orderdate)::TIMESTAMP AS last FROM orders GROUP BY o_custkey), n AS (SELECT max(o_orderdate)::TIMESTAMP AS now FROM orders) SELECT c_custkey, coalesce(date_diff('day', last, now), 9999)::BIGINT AS days, last IS NULL OR date_diff('day', last, now) >= 7 AS stale FROM customer LEFT JOIN e ON c_custkey = o_custkey, n")
def a18(t):
    ev = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return o.freshness(ev, t.customer.select("c_custkey"), "c_custkey")


@query("a18_freshness_counts", "WITH e AS (SELECT o_custkey, max(o_orderdate)::TIMESTAMP AS last FROM orders GROUP BY o_custkey), n AS (SELECT max(o_orderdate)::TIMESTAMP AS now FROM orders) SELECT coalesce(date_diff('day', last, now), 9999) // 100 AS bucket, count(*)::BIGINT AS repos FROM customer LEFT JOIN e ON c_custkey = o_custkey, n GROUP BY 1")
def a18b(t):
    return a18(t).groupBy(F.floor(F.col("days") / 100).alias("bucket")).agg(F.count("*").alias("repos"))


@query("w12_daily_spine", f"WITH {ANALYSIS}, n AS (SELECT ts::DATE AS day, count(*) AS builds FROM analysis WHERE NOT passed GROUP BY 1), span AS (SELECT max(ts::DATE) AS b FROM analysis), days AS (SELECT unnest(generate_series((b - 29)::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM span) SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(builds, 0)::BIGINT AS builds FROM days LEFT JOIN n USING (day)")
def w12(t):
    from siltstone.operators.joins import daily_spine

    a = analyses(t).withColumn("day", F.to_date("ts"))
    n = a.where("not passed").groupBy("day").agg(F.count("*").alias("builds"))
    return daily_spine(n, a.agg(F.max("day").alias("last")), 30, ["builds"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("s12_churn", "SELECT user_id, count(*)::BIGINT AS commits FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY user_id")
def s12(t):
    last = t.events.agg(F.max("ts").alias("last"))
    return t.events.crossJoin(F.broadcast(last)).where("ts >= last - INTERVAL 10 DAYS").groupBy("user_id").agg(F.count("*").alias("commits"))


@query("s16_verdicts", "SELECT user_id, CASE lower(event_type) WHEN 'purchase' THEN 'confirmed' WHEN 'click' THEN 'confirmed' WHEN 'error' THEN 'false_positive' END AS verdict, count(*)::BIGINT AS n FROM events WHERE lower(event_type) IN ('purchase', 'click', 'error') GROUP BY ALL")
def s16(t):
    v = F.lower("event_type")
    verdict = F.when(v.isin("purchase", "click"), "confirmed").when(v.isin("error"), "false_positive")
    return t.events.select("user_id", verdict.alias("verdict")).where("verdict is not null").groupBy("user_id", "verdict").agg(F.count("*").alias("n"))


@query("p38_period_keys", "SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H') AS hour, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def p38(t):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM").alias("month"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH").alias("hour")).agg(F.count("*").alias("n"))


@query("p41_summary_bag", "SELECT event_type, sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k, count(json_extract_string(props, '$.page'))::BIGINT AS pages, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def p41(t):
    bag = lambda k: F.get_json_object("props", f"$.{k}")
    return t.events.groupBy("event_type").agg(F.sum(F.expr("try_cast(get_json_object(props, '$.k') as double)")).alias("k"), F.count(bag("page")).alias("pages"), F.count("*").alias("n"))


@query("a6_t10_bucket_deltas", f"WITH {ANALYSIS}, s AS (SELECT repo, ts, event_id, CASE WHEN issues < 4 THEN 'low' WHEN issues < 9 THEN 'mid' ELSE 'high' END AS bucket FROM analysis), d AS (SELECT bucket, 1 AS delta FROM s UNION ALL SELECT lag(bucket) OVER (PARTITION BY repo ORDER BY ts, event_id), -1 FROM s) SELECT bucket, sum(delta)::BIGINT AS repos FROM d WHERE bucket IS NOT NULL GROUP BY bucket")
def a6(t):
    from siltstone.operators.joins import bucket_deltas

    bucket = F.when(F.col("issues") < 4, "low").when(F.col("issues") < 9, "mid").otherwise("high")
    return bucket_deltas(analyses(t).withColumn("bucket", bucket), "repo").groupBy("bucket").agg(F.sum("delta").alias("repos"))


@query("l6_recent_then_severe", "WITH r AS (SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id LIMIT 200) SELECT event_id, event_type FROM r ORDER BY CASE event_type WHEN 'error' THEN 0 ELSE 1 END, ts DESC, event_id LIMIT 15")
def l6(t):
    r = t.events.select("event_id", "event_type", "ts").orderBy(F.desc("ts"), "event_id").limit(200)
    return r.orderBy(F.when(F.col("event_type") == "error", 0).otherwise(1), F.desc("ts"), "event_id").limit(15).select("event_id", "event_type")


@query("a10_top_causes", "WITH r AS (SELECT p_partkey, p_type FROM part), f AS (SELECT l_partkey, l_returnflag, l_shipdate FROM lineitem) SELECT p_partkey, count(l_partkey)::BIGINT AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS severe, sum(CASE WHEN l_shipdate::DATE >= (SELECT max(l_shipdate::DATE) FROM lineitem) - 30 THEN 1 ELSE 0 END)::BIGINT AS fresh FROM r LEFT JOIN f ON l_partkey = p_partkey GROUP BY p_partkey ORDER BY n DESC, p_partkey LIMIT 25")
def a10(t):
    last = t.lineitem.agg(F.max(F.to_date("l_shipdate")).alias("last"))
    f = t.lineitem.crossJoin(F.broadcast(last)).groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("severe"), F.count_if(F.to_date("l_shipdate") >= F.date_sub("last", 30)).alias("fresh"))
    return t.part.select("p_partkey").join(f, F.col("p_partkey") == F.col("l_partkey"), "left").na.fill(0, ["n", "severe", "fresh"]).select("p_partkey", "n", "severe", "fresh").orderBy(F.desc("n"), "p_partkey").limit(25)


@query("a10_least_findings", "SELECT s_suppkey, count(l_suppkey)::BIGINT AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 45 GROUP BY s_suppkey ORDER BY n, s_suppkey LIMIT 15")
def a10b(t):
    f = t.lineitem.where("l_quantity > 45").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return t.supplier.select("s_suppkey").join(f, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n")).orderBy("n", "s_suppkey").limit(15)


@query("a36_coverage_report", "SELECT p_type, p_brand, count(*)::BIGINT AS n, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END)::BIGINT AS covered, round(100.0 * sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) / count(*), 1) AS share FROM part GROUP BY CUBE (p_type, p_brand)")
def a36(t):
    c = F.count_if(F.col("p_size") > 25)
    return t.part.cube("p_type", "p_brand").agg(F.count("*").alias("n"), c.alias("covered"), F.round(100.0 * c / F.count("*"), 1).alias("share"))


@query("a41_effort_split", "SELECT p_type, sum(CASE WHEN p_size <= 10 THEN 1 ELSE 0 END)::BIGINT AS quick, sum(CASE WHEN p_size > 10 AND p_size <= 30 THEN 1 ELSE 0 END)::BIGINT AS planned, sum(CASE WHEN p_size > 30 THEN 1 ELSE 0 END)::BIGINT AS debt FROM part GROUP BY p_type")
def a41(t):
    s = F.col("p_size")
    return t.part.groupBy("p_type").agg(F.count_if(s <= 10).alias("quick"), F.count_if((s > 10) & (s <= 30)).alias("planned"), F.count_if(s > 30).alias("debt"))


@query("a38_queue_audit", "WITH j AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' WHEN 2 THEN 'pending' WHEN 3 THEN 'done' ELSE 'superseded' END AS status, ts FROM events), n AS (SELECT max(ts) AS now FROM events) SELECT status, count(*)::BIGINT AS n, sum(CASE WHEN status = 'failed' OR (status = 'running' AND ts < now - INTERVAL 1 HOUR) OR (status = 'pending' AND ts < now - INTERVAL 1 DAY) THEN 1 ELSE 0 END)::BIGINT AS stuck FROM j, n GROUP BY status")
def a38(t):
    from siltstone.operators.joins import stuck_jobs

    status = sv.lookup(F.col("event_id") % 5, {0: "failed", 1: "running", 2: "pending", 3: "done"}, "superseded")
    jobs = t.events.select("event_id", status.alias("status"), "ts")
    return stuck_jobs(jobs).groupBy("status").agg(F.count("*").alias("n"), F.count_if("stuck").alias("stuck"))


REPO_SCANS = "scan AS (SELECT c_custkey AS repo, c_acctbal > 0 AS enabled, last + (c_custkey % 400)::INTEGER AS next_run, ('0x' || substring(sha256(c_custkey::VARCHAR), 1, 8))::BIGINT % 24 AS shard FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate)::DATE AS last FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"


@query("p39_t9_due_scans", f"WITH {REPO_SCANS}, n AS (SELECT max(o_orderdate)::DATE AS now FROM orders) SELECT repo, shard, row_number() OVER (PARTITION BY shard ORDER BY next_run NULLS FIRST, repo)::BIGINT AS place FROM scan, n WHERE enabled AND (next_run IS NULL OR next_run <= now) QUALIFY place <= 300")
def p39(t):
    from siltstone.operators.joins import due_scans

    last = t.orders.groupBy(F.col("o_custkey").alias("repo")).agg(F.max(F.to_date("o_orderdate")).alias("last"))
    scans = t.customer.select(F.col("c_custkey").alias("repo"), (F.col("c_acctbal") > 0).alias("enabled")).join(last, "repo", "left")
    scans = scans.withColumn("next_run", F.date_add("last", (F.col("repo") % 400).cast("int")))
    return due_scans(scans, t.orders.agg(F.max(F.to_date("o_orderdate")).alias("now"))).select("repo", "shard", F.col("place").cast("long").alias("place"))


@query("p43_ruleset_version", "SELECT p_type, substring(sha256(string_agg(p_partkey || '|' || p_name || '|' || p_size, chr(10) ORDER BY p_partkey)), 1, 24) AS version FROM part GROUP BY p_type")
def p43(t):
    from siltstone.operators.joins import version_hash

    return version_hash(t.part, ["p_type"], ["p_partkey", "p_name", "p_size"])


@query("p40_catalogue_ids", "WITH b AS (SELECT p_partkey, p_brand FROM part), ref AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 'x:' || l_partkey WHEN l_orderkey % 3 = 1 THEN l_partkey::VARCHAR ELSE 'EXT:tool:' || l_partkey END AS id FROM lineitem), r AS (SELECT ref.*, a.p_partkey AS exact, c.p_partkey AS tail FROM ref LEFT JOIN b a ON a.p_partkey::VARCHAR = id AND NOT starts_with(id, 'EXT:') LEFT JOIN b c ON 'x:' || c.p_partkey = id AND NOT starts_with(id, 'EXT:')) SELECT id, coalesce(exact::VARCHAR, tail::VARCHAR, id) AS resolved, count(*)::BIGINT AS n FROM r GROUP BY ALL")
def p40(t):
    from siltstone.operators.joins import resolve_ids

    key = F.col("l_partkey").cast("string")
    ref = t.lineitem.select(F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("x:"), key)).when(F.col("l_orderkey") % 3 == 1, key).otherwise(F.concat(F.lit("EXT:tool:"), key)).alias("id"))
    return resolve_ids(ref, t.part.select(F.col("p_partkey").cast("string").alias("rule_id")), "x:").groupBy("id", "resolved").agg(F.count("*").alias("n"))


@query("k5_drift", "WITH a AS (SELECT p_partkey, p_size, p_brand, p_type FROM part), b AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 11 = 0 THEN 'X' ELSE p_brand END AS p_brand, p_type FROM part WHERE p_partkey % 13 <> 0) SELECT a.p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.p_size <> b.p_size THEN 'p_size' ELSE 'p_brand' END AS first_difference FROM a LEFT JOIN b USING (p_partkey) WHERE b.p_partkey IS NULL OR a.p_size <> b.p_size OR a.p_brand <> b.p_brand")
def k5(t):
    from siltstone.operators.joins import drift

    a = t.part.select("p_partkey", "p_size", "p_brand", "p_type")
    b = a.where("p_partkey % 13 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), F.when(F.col("p_partkey") % 11 == 0, "X").otherwise(F.col("p_brand")).alias("p_brand"), "p_type")
    return drift(a, b, "p_partkey", ["p_size", "p_brand", "p_type"])


@query("k1_threshold_clamp", "SELECT p_partkey, greatest(0, least(100, p_size * 3 - 20))::BIGINT AS min_cov, p_size * 3 - 20 < 0 OR p_size * 3 - 20 > 100 AS out_of_range FROM part")
def k1(t):
    raw = F.col("p_size") * 3 - 20
    return t.part.select("p_partkey", q.clamp(raw, 0, 100).cast("long").alias("min_cov"), ((raw < 0) | (raw > 100)).alias("out_of_range"))


@query("k4_t8_retention", "WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_type, sum(CASE WHEN ts < now - INTERVAL 20 DAY AND event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS purged, sum(CASE WHEN ts < now - INTERVAL 20 DAY AND event_type <> 'error' THEN 0 ELSE 1 END)::BIGINT AS kept FROM events, n GROUP BY event_type")
def k4(t):
    from siltstone.operators.joins import retention

    out = retention(t.events, 20, F.col("event_type") == "error")
    return out.groupBy("event_type").agg(F.count_if("due").alias("purged"), F.count_if(~F.col("due")).alias("kept"))


@query("k2_s20_issue_upsert", f"WITH {FINDING}, old AS (SELECT fp, min(doc_id) AS first_seen, max(doc_id) AS last_seen, 'open' AS status FROM finding WHERE doc_id % 3 <> 0 GROUP BY fp), new AS (SELECT fp, max(doc_id) + 100000 AS run FROM finding WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 GROUP BY fp) SELECT coalesce(o.fp, n.fp) AS fp, coalesce(first_seen, run)::BIGINT AS first_seen, coalesce(run, last_seen)::BIGINT AS last_seen, CASE WHEN n.fp IS NULL THEN 'closed' ELSE 'open' END AS status FROM old o FULL OUTER JOIN new n ON o.fp = n.fp")
def k2(t):
    from siltstone.operators.joins import upsert_issues

    f = found(t)
    old = f.where("doc_id % 3 <> 0").groupBy("fp").agg(F.min("doc_id").alias("first_seen"), F.max("doc_id").alias("last_seen"), F.lit("open").alias("status"))
    new = f.where("doc_id % 3 = 0 or doc_id % 5 = 0").groupBy("fp").agg((F.max("doc_id") + 100000).alias("run"))
    return upsert_issues(old, new)


@query("k3_j24_patch", "WITH p AS (SELECT doc_id, greatest(0, least(1, round(quality * 1.2 - toxic * 0.5, 3)))::DOUBLE AS score FROM labels WHERE doc_id % 2 = 0) SELECT d.doc_id, coalesce(score, n_chars::DOUBLE) AS score FROM documents d LEFT JOIN p USING (doc_id)")
def k3(t):
    from siltstone.operators.joins import patch

    p = t.labels.where("doc_id % 2 = 0").select("doc_id", q.clamp(F.round(F.col("quality") * 1.2 - F.col("toxic") * 0.5, 3)).alias("score"))
    return patch(t.documents.select("doc_id", F.col("n_chars").cast("double").alias("score")), p, "doc_id")


@query("j22_anti_joins", "SELECT 'customers without orders' AS kind, count(*)::BIGINT AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'parts without lines', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'orders without customers', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def j22(t):
    lost = lambda kind, a, b, x, y: a.join(b, a[x] == b[y], "left_anti").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return lost("customers without orders", t.customer, t.orders, "c_custkey", "o_custkey").unionByName(lost("parts without lines", t.part, t.lineitem, "p_partkey", "l_partkey")).unionByName(lost("orders without customers", t.orders, t.customer, "o_custkey", "c_custkey"))


@query("u7_parity", "SELECT l_returnflag AS axis, count(*)::BIGINT AS only_a FROM (SELECT l_returnflag, l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 30 EXCEPT ALL SELECT l_returnflag, l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 29) GROUP BY 1")
def u7(t):
    a, b = (t.lineitem.where(f"l_quantity < {k}").select("l_returnflag", "l_orderkey", "l_partkey") for k in (30, 29))
    return a.exceptAll(b).groupBy(F.col("l_returnflag").alias("axis")).agg(F.count("*").alias("only_a"))


@query("s13_expected_results", "SELECT doc_id, 'case' || lpad(doc_id::VARCHAR, 8, '0') AS name, CASE quality WHEN 1 THEN 'sqli' ELSE 'xss' END AS category, toxic = 1 AS is_real FROM labels")
def s13(t):
    return t.labels.select("doc_id", F.concat(F.lit("case"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("name"), F.when(F.col("quality") == 1, "sqli").otherwise("xss").alias("category"), (F.col("toxic") == 1).alias("is_real"))


@query("s15_feedback_export", f"WITH {FEEDBACK} SELECT doc_id, verdict, row_number() OVER (ORDER BY doc_id DESC)::BIGINT AS place FROM feedback")
def s15(t):
    """Newest first; the place is given by range partitions, not by one task: ids before it, counted per range."""
    from siltstone.operators.joins import global_place

    return global_place(feedback(t).select("doc_id", "verdict"), "doc_id", descending=True)


@query("t4_rate_limit", "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*)::BIGINT AS n, count(*) > 2 AS over_limit FROM events GROUP BY ALL")
def t4(t):
    w = F.window("ts", "1 hour")
    g = t.events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "n", (F.col("n") > 2).alias("over_limit"))


@query("t5_quotas", "SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*)::BIGINT AS used, greatest(0, 60 - count(*))::BIGINT AS left_over FROM events GROUP BY ALL")
def t5(t):
    g = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("used"))
    return g.withColumn("left_over", F.greatest(F.lit(0), 60 - F.col("used")))

