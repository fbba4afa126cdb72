"""Queries on catalogues: curation, scopes, shares, proposals, remediation specs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import joins as j
from siltstone.operators import matching as m
from siltstone.plans.fixtures import FINDING, found
from siltstone.plans.learning_plans import GRID, grid
from siltstone.plans.registry import query


@query("j8_curated_merge", "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 99 END AS p_size, NULL::VARCHAR AS p_brand, false AS orphan FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey + 5000000, 1, 'own', p_partkey % 3 = 0 FROM part WHERE p_partkey % 50 = 0) SELECT p.p_partkey, coalesce(p.p_size, g.p_size)::BIGINT AS p_size, coalesce(p.p_brand, g.p_brand) AS p_brand, g.p_partkey IS NULL AND NOT orphan AS missing FROM p LEFT JOIN part g ON g.p_partkey = p.p_partkey")
def j8(t):
    k = F.col("p_partkey")
    one = t.part.where(k % 10 == 0).select(k, F.when(k % 2 == 0, 99).alias("p_size"), F.lit(None).cast("string").alias("p_brand"), F.lit(False).alias("orphan"))
    two = t.part.where(k % 50 == 0).select((k + 5000000).alias("p_partkey"), F.lit(1).alias("p_size"), F.lit("own").alias("p_brand"), (k % 3 == 0).alias("orphan"))
    out = j.curated(t.part.select("p_partkey", F.col("p_size").cast("long").alias("p_size"), "p_brand"), one.unionByName(two), "p_partkey")
    return out.withColumn("p_size", F.col("p_size").cast("long"))


@query("j11_coverage_scope", "SELECT CASE WHEN event_id % 3 = 0 THEN 'new-code' WHEN event_id % 5 <> 0 THEN 'overall' ELSE 'none' END AS scope, count(*)::BIGINT AS n FROM events GROUP BY 1")
def j11(t):
    k = F.col("event_id")
    return t.events.groupBy(j.coverage_scope(F.when(k % 3 == 0, F.col("value")), F.when(k % 5 != 0, F.col("value"))).alias("scope")).agg(F.count("*").alias("n"))


@query("a11_rule_delta_share", f"WITH {FINDING}, n AS (SELECT rule_id, count(*) AS n, sum(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END) AS fresh, max(doc_id) AS newest FROM finding GROUP BY rule_id) SELECT rule_id, n::BIGINT AS n, round(fresh / n, 4) AS share FROM n ORDER BY newest DESC, n DESC, rule_id LIMIT 10")
def a11(t):
    n = found(t).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 4 == 0).alias("fresh"), F.max("doc_id").alias("newest"))
    return n.orderBy(F.desc("newest"), F.desc("n"), "rule_id").limit(10).select("rule_id", "n", F.round(F.col("fresh") / F.col("n"), 4).alias("share"))


@query("p45_proposal_labels", f"WITH {GRID} SELECT rule_id, variant, CASE WHEN f1 >= 0.9 THEN 'strong' WHEN f1 >= 0.6 THEN 'usable' ELSE 'weak' END AS family, CASE WHEN precision >= 0.85 THEN 'promotable' ELSE 'held' END AS verdict FROM f")
def p45(t):
    f = F.col("f1")
    return grid(t).select("rule_id", "variant", F.when(f >= 0.9, "strong").when(f >= 0.6, "usable").otherwise("weak").alias("family"), F.when(F.col("precision") >= 0.85, "promotable").otherwise("held").alias("verdict"))


@query("p44_detector_lint", f"WITH {FINDING} SELECT regex, count(*)::BIGINT AS hits FROM finding GROUP BY regex")
def p44(t):
    """Patterns that hit, with their hits; the lint weight orders them."""
    g = found(t).groupBy("regex").agg(F.count("*").alias("hits"))
    return g.withColumn("lint", m.detector_lint(F.col("regex"))).orderBy(F.desc("lint"), "regex").select("regex", "hits")


@query("p36_remediation_specs", f"WITH {FINDING} SELECT fid, CASE type WHEN 'VULNERABILITY' THEN 'secure' WHEN 'BUG' THEN 'fix' WHEN 'SECURITY_HOTSPOT' THEN 'review' ELSE 'refactor' END AS intent, path || ':' || ln AS target, greatest(effort, 5)::BIGINT AS minutes FROM finding")
def p36(t):
    """Specs as JSON, read back by field."""
    from siltstone.functions.severity import lookup

    spec = F.to_json(F.struct(lookup(F.col("type"), {"VULNERABILITY": "secure", "BUG": "fix", "SECURITY_HOTSPOT": "review"}, "refactor").alias("intent"), F.concat_ws(":", "path", F.col("ln").cast("string")).alias("target"), F.greatest("effort", F.lit(5)).alias("minutes")))
    back = F.from_json(spec, "intent string, target string, minutes long")
    return found(t).select("fid", back.alias("s")).select("fid", "s.*")
