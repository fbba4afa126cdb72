"""Queries on findings: matching, deduplication, echoes, noise, budgets, suppression, summaries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.severity import severity_rank
from siltstone.operators import matching as m
from siltstone.operators.joins import place_in_group
from siltstone.plans.fixtures import FILE, FINDING, LINE, RANK, RULE, files, found
from siltstone.plans.registry import query


@query("p7_lines", f"WITH {LINE} SELECT path, ln, length(txt)::BIGINT AS n FROM line")
def p7(t):
    from siltstone.functions.text import lines

    return lines(files(t)).select("path", F.col("ln").cast("long").alias("ln"), F.length("txt").cast("long").alias("n"))


@query("j1_p8_rule_match", f"WITH {FINDING} SELECT path, ln::BIGINT AS ln, rule_id, col::BIGINT AS col, end_col::BIGINT AS end_col, snippet FROM finding")
def j1(t):
    return found(t).select("path", F.col("ln").cast("long").alias("ln"), "rule_id", F.col("col").cast("long").alias("col"), F.col("end_col").cast("long").alias("end_col"), "snippet")


@query("p10_p11_fingerprints", f"WITH {FINDING} SELECT path, rule_id, fp, count(*) AS n FROM finding GROUP BY ALL")
def p11(t):
    return found(t).groupBy("path", "rule_id", "fp").agg(F.count("*").alias("n"))


ENGINE = "CASE ln % 3 WHEN 0 THEN 'taint' WHEN 1 THEN 'ast' ELSE 'pattern' END"


@query(
    "w1_engine_dedupe",
    f"""WITH {FINDING}, many AS (SELECT path, rule_id, ln // 2 AS ln, {ENGINE} AS engine, ln AS seq FROM finding)
SELECT path, rule_id, ln::BIGINT AS ln, engine, seq::BIGINT AS seq FROM (SELECT *, row_number() OVER (PARTITION BY path, rule_id, ln ORDER BY CASE engine WHEN 'taint' THEN 3 WHEN 'ast' THEN 2 ELSE 1 END DESC, seq) AS n FROM many) WHERE n = 1""",
)
def w1(t):
    many = found(t).select("path", "rule_id", F.floor(F.col("ln") / 2).cast("long").alias("ln"), F.expr(ENGINE).alias("engine"), F.col("ln").cast("long").alias("seq"))
    return m.best_engine(many)


@query(
    "w2_same_detector_collapse",
    f"""WITH {FINDING}, one AS (SELECT *, first_value(rule_id) OVER (PARTITION BY path, ln, col, regex ORDER BY {RANK} DESC, rule_id) AS top FROM finding),
a AS (SELECT path, ln, col, regex, max(CASE WHEN rule_id = top THEN rule_id END) AS rule_id, max(CASE WHEN rule_id = top THEN type END) AS type, max(CASE WHEN rule_id = top THEN severity END) AS severity, list(rule_id) AS ids FROM one GROUP BY path, ln, col, regex),
two AS (SELECT *, first_value(rule_id) OVER (PARTITION BY path, ln, col, type ORDER BY {RANK} DESC, rule_id) AS top FROM a)
SELECT path, ln::BIGINT AS ln, col::BIGINT AS col, type, max(top) AS rule_id, array_to_string(list_sort(list_filter(list_distinct(flatten(list(ids))), lambda x: x <> max(top))), ',') AS absorbed FROM two GROUP BY path, ln, col, type""",
)
def w2(t):
    out = m.collapse_same_detector(found(t).withColumn("engine", F.lit("pattern")))
    return out.select("path", F.col("ln").cast("long").alias("ln"), F.col("col").cast("long").alias("col"), "type", "rule_id", F.array_join("absorbed", ",").alias("absorbed"))


def two_tools(t):
    """Half of the packs as the native tool, the rest as an imported one."""
    f = found(t)
    native = f.where("seq % 2 = 0").select("path", "ln", "col", "rule_id", F.col("fid").alias("nat_id"))
    imported = f.where("seq % 2 = 1").select("path", "ln", "col", "rule_id", F.col("fid").alias("imp_id"), (F.col("doc_id") % 5 == 0).alias("is_dependency"))
    return native, imported


TOOLS = FINDING + ", nat AS (SELECT path, ln, col, rule_id, fid AS nat_id FROM finding WHERE seq % 2 = 0), imp AS (SELECT path, ln, col, rule_id, fid AS imp_id, doc_id % 5 = 0 AS dep FROM finding WHERE seq % 2 = 1), taken AS (SELECT * FROM (SELECT i.imp_id, i.rule_id AS echo, n.nat_id, row_number() OVER (PARTITION BY i.imp_id ORDER BY abs(i.col - n.col), n.nat_id) AS k FROM imp i JOIN nat n USING (path, ln) WHERE NOT dep) WHERE k = 1)"


@query("j4_echo_absorbed", f"WITH {TOOLS} SELECT nat_id, coalesce((SELECT string_agg(DISTINCT echo, ',' ORDER BY echo) FROM taken k WHERE k.nat_id = nat.nat_id), '') AS also FROM nat")
def j4(t):
    return m.absorb_echoes(*two_tools(t))[0].select("nat_id", F.array_join("also", ",").alias("also"))


@query("j4_echo_remaining", f"WITH {TOOLS} SELECT imp_id, rule_id FROM imp WHERE imp_id NOT IN (SELECT imp_id FROM taken)")
def j4b(t):
    return m.absorb_echoes(*two_tools(t))[1].select("imp_id", "rule_id")


@query(
    "j16_neighbour_agreement",
    f"""WITH {FINDING} SELECT a.fid, sum(CASE WHEN list_has_any(a.cwe, b.cwe) THEN 1 ELSE 0 END)::BIGINT AS sharing, sum(CASE WHEN list_has_any(a.cwe, b.cwe) THEN 0 ELSE 1 END)::BIGINT AS differing
FROM finding a JOIN finding b ON a.path = b.path AND b.ln BETWEEN a.ln - 1 AND a.ln + 1 AND a.rule_id <> b.rule_id GROUP BY a.fid""",
)
def j16(t):
    return m.neighbour_agreement(found(t)).select("fid", F.coalesce("sharing", F.lit(0)).alias("sharing"), "differing")


@query(
    "a30_noise_per_kloc",
    f"""WITH {FINDING}, loc AS (SELECT source, count(*) AS loc FROM line GROUP BY source), n AS (SELECT source, count(*) AS n, sum(CASE WHEN severity IN ('BLOCKER', 'CRITICAL') THEN 1 ELSE 0 END) AS severe FROM finding GROUP BY source)
SELECT source, loc::BIGINT AS loc, coalesce(n, 0)::BIGINT AS n, coalesce(severe, 0)::BIGINT AS severe, round(1000 * coalesce(n, 0) / loc, 3) AS per_kloc, CASE WHEN coalesce(n, 0) > 0 THEN round(severe / n, 4) ELSE 0.0 END AS severe_share FROM loc LEFT JOIN n USING (source)""",
)
def a30(t):
    return m.noise_by_source(found(t), files(t)).select("source", F.col("loc").cast("long").alias("loc"), "n", "severe", "per_kloc", "severe_share")


@query(
    "a30_suspicious_rules",
    f"""WITH {FINDING}, totals AS (SELECT lang, count(*) AS files FROM file GROUP BY lang), h AS (SELECT rule_id, lang, count(DISTINCT path) AS hit, max(severity) AS severity FROM finding GROUP BY rule_id, lang)
SELECT rule_id, lang, hit::BIGINT AS hit, files::BIGINT AS files FROM h JOIN totals USING (lang) WHERE files >= 10 AND hit >= 5 AND hit > CASE WHEN severity IN ('BLOCKER', 'CRITICAL') THEN 0.05 ELSE 0.25 END * files""",
)
def a30b(t):
    return m.suspicious_rules(found(t), files(t))


@query("a31_volume_explosions", f"WITH {FINDING}, b AS (SELECT rule_id, count(*) AS budget FROM finding WHERE doc_id % 4 = 0 GROUP BY rule_id), n AS (SELECT rule_id, count(*) AS n FROM finding GROUP BY rule_id) SELECT rule_id, n::BIGINT AS n, coalesce(budget, 0)::BIGINT AS budget FROM n LEFT JOIN b USING (rule_id) WHERE (n >= 5 AND n > 3 * coalesce(budget, 0)) OR (n >= coalesce(budget, 0) + 25 AND n >= 1.25 * coalesce(budget, 0))")
def a31(t):
    f = found(t)
    budget = f.where("doc_id % 4 = 0").groupBy("rule_id").agg(F.count("*").alias("budget"))
    return m.volume_explosions(f, budget)


@query("a32_first_example", f"WITH {FINDING} SELECT rule_id, path, ln::BIGINT AS ln FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY path, ln) AS k FROM finding WHERE NOT regexp_matches(txt, 'AKIA[A-Z0-9]{{16}}') AND NOT regexp_matches(txt, '(?i)(password|passwd|secret|token|api_key|apikey)[ ]?[=:]')) WHERE k = 1")
def a32(t):
    from siltstone.functions.text import looks_secret

    clean = found(t).where(~looks_secret(F.col("txt")))
    return clean.groupBy("rule_id").agg(F.min_by(F.struct("path", "ln"), F.struct("path", "ln")).alias("x")).select("rule_id", "x.path", F.col("x.ln").cast("long").alias("ln"))


@query("a33_detector_audit", f"WITH {FINDING}, loc AS (SELECT count(*) AS loc FROM line) SELECT regex, count(*)::BIGINT AS hits, count(DISTINCT path)::BIGINT AS files_hit, count(DISTINCT rule_id)::BIGINT AS rules, round(1000 * count(*) / max(loc), 3) AS per_kloc FROM finding, loc GROUP BY regex")
def a33(t):
    loc = files(t).agg(F.sum(F.size(F.split("text", r"\r?\n", -1))).alias("loc"))
    g = found(t).groupBy("regex").agg(F.count("*").alias("hits"), F.countDistinct("path").alias("files_hit"), F.countDistinct("rule_id").alias("rules"))
    return g.crossJoin(F.broadcast(loc)).select("regex", "hits", "files_hit", "rules", F.round(1000 * F.col("hits") / F.col("loc"), 3).alias("per_kloc"))


@query("a34_recommendation_groups", f"WITH {FINDING} SELECT rule_id, max(severity) AS severity, count(*)::BIGINT AS n, string_agg(path || ':' || ln, ',' ORDER BY path, ln) FILTER (WHERE k <= 25) AS places FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY path, ln) AS k FROM finding) GROUP BY rule_id")
def a34(t):
    return m.recommendation_groups(found(t))


PATTERN = "CASE p_size % 5 WHEN 0 THEN concat('(', p_brand, '+)+') WHEN 1 THEN concat(p_type, '.*') WHEN 2 THEN concat('([a-z]{2,9}', p_brand, ')*') WHEN 3 THEN repeat(p_type, 20) ELSE p_brand END"


@query("p9_unsafe_rules", f"WITH p AS (SELECT p_partkey, {PATTERN} AS regex FROM part) SELECT p_partkey, length(regex) > 300 OR regexp_matches(regex, '\\([^()]*[+*][^()]*\\)[+*]') OR regexp_matches(regex, '\\([^()]*\\{{[0-9]+,[0-9]*\\}}[^()]*\\)[+*]') AS unsafe FROM p")
def p9(t):
    """Patterns of a table, some of which may backtrack without end."""
    return t.part.select("p_partkey", m.unsafe_regex(F.expr(PATTERN)).alias("unsafe"))


@query("u1_u2_union_distinct", f"WITH {FINDING}, every AS (SELECT fp FROM finding WHERE seq % 2 = 0 UNION ALL SELECT fp FROM finding WHERE seq % 3 = 0) SELECT fp, count(*)::BIGINT AS n FROM every GROUP BY fp")
def u1(t):
    f = found(t)
    return f.where("seq % 2 = 0").select("fp", "rule_id").unionByName(f.where("seq % 3 = 0").select("fp"), allowMissingColumns=True).groupBy("fp").agg(F.count("*").alias("n"))


@query("u6_new_noisy_rules", f"WITH {FINDING} SELECT DISTINCT rule_id, source FROM finding WHERE doc_id % 2 = 0 EXCEPT SELECT rule_id, source FROM finding WHERE doc_id % 2 = 1")
def u6(t):
    f = found(t).select("rule_id", "source", "doc_id")
    return f.where("doc_id % 2 = 0").select("rule_id", "source").distinct().join(f.where("doc_id % 2 = 1"), ["rule_id", "source"], "left_anti")


@query("l3_issue_page", f"WITH {FINDING} SELECT fid, severity FROM finding WHERE severity IN ('MAJOR', 'CRITICAL', 'BLOCKER') AND fid > 'src1' ORDER BY fid LIMIT 50")
def l3(t):
    """A page of issues after a key: a report of its nature limited."""
    return found(t).where("severity in ('MAJOR', 'CRITICAL', 'BLOCKER') and fid > 'src1'").select("fid", "severity").orderBy("fid").limit(50)


@query("l4_worst_first", f"WITH {FINDING} SELECT fid, {RANK} AS rank, row_number() OVER (PARTITION BY source ORDER BY {RANK} DESC, path, ln, rule_id)::BIGINT AS place FROM finding")
def l4(t):
    rows = found(t).select("fid", "source", "path", "ln", "rule_id", severity_rank(F.col("severity")).alias("rank"))
    return place_in_group(rows, "source", [F.desc("rank"), F.asc("path"), F.asc("ln"), F.asc("rule_id")]).select("fid", "rank", F.col("place").cast("long").alias("place"))


@query(
    "w3_first_last_seen",
    f"WITH {FINDING}, seen AS (SELECT fp, doc_id % 10 AS run FROM finding) SELECT fp, min(run)::BIGINT AS first_seen, max(run)::BIGINT AS last_seen, min(run) = (SELECT max(run) FROM seen) AS is_new FROM seen GROUP BY fp",
)
def w3(t):
    seen = found(t).select("fp", (F.col("doc_id") % 10).alias("run"))
    last = seen.agg(F.max("run").alias("latest"))
    return seen.groupBy("fp").agg(F.min("run").alias("first_seen"), F.max("run").alias("last_seen")).crossJoin(F.broadcast(last)).select("fp", "first_seen", "last_seen", (F.col("first_seen") == F.col("latest")).alias("is_new"))


@query("w5_rule_samples", f"WITH {FINDING}, d AS (SELECT rule_id, snippet, min(path || '#' || lpad(ln::VARCHAR, 9, '0')) AS place FROM finding WHERE length(snippet) >= 12 GROUP BY rule_id, snippet) SELECT rule_id, place FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY place) AS k FROM d) WHERE k <= 3")
def w5(t):
    at = F.concat_ws("#", "path", F.lpad(F.col("ln").cast("string"), 9, "0"))
    d = found(t).where(F.length("snippet") >= 12).groupBy("rule_id", "snippet").agg(F.min(at).alias("place"))
    return d.withColumn("k", F.row_number().over(W.partitionBy("rule_id").orderBy("place"))).where("k <= 3").select("rule_id", "place")


@query("a35_catalogue_totals", f"WITH {FINDING} SELECT pack, type, count(*)::BIGINT AS n, count(DISTINCT rule_id)::BIGINT AS rules FROM finding GROUP BY GROUPING SETS ((pack, type), (pack), ())")
def a35(t):
    f = found(t)
    return f.rollup("pack", "type").agg(F.count("*").alias("n"), F.countDistinct("rule_id").alias("rules"))


@query("a42_u4_tool_mix", f"WITH {TOOLS}, n AS (SELECT path, ln FROM nat), i AS (SELECT path, ln FROM imp) SELECT 'native' AS mode, count(DISTINCT path || ':' || ln)::BIGINT AS places FROM n UNION ALL SELECT 'imported', count(DISTINCT path || ':' || ln) FROM i UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM n UNION SELECT * FROM i) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM n INTERSECT SELECT * FROM i)")
def a42(t):
    native, imported = (x.select("path", "ln").distinct() for x in two_tools(t))
    count = lambda mode, df: df.agg(F.lit(mode).alias("mode"), F.count("*").alias("places"))
    return count("native", native).unionByName(count("imported", imported)).unionByName(count("union", native.union(imported).distinct())).unionByName(count("both", native.intersect(imported)))
