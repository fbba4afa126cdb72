"""Queries on votes about findings, on rules from mined cases, and on rules that evolve."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import evolution as ev
from siltstone.operators import induction as ind
from siltstone.operators import mining
from siltstone.operators.graph import cut, flows
from siltstone.plans.fixtures import FINDING, files, found, units
from siltstone.plans.registry import query

#: Rules of the packs that are taken to declare a flow.
TAINTED = ("PII-EMAIL", "LIC-LINE", "STYLE-PUNCT")


def candidates(t):
    """All findings; a third of the rules are those of the flow engine. Any scope, files with ``#`` comments."""
    engine = F.when(F.col("seq") % 3 == 0, "taint").otherwise("pattern")
    return found(t).select(F.col("fid").alias("candidate"), "rule_id", "path", "ln", "col", "end_col", "txt", "cwe", engine.alias("engine"), F.lit("any").alias("scope"))


def line_flows(t, c):
    """Paths along the lines of a paragraph, from its first line to findings of rules that declare a flow."""
    runs = units(t).where("start > 0")
    at = lambda ln: F.concat_ws("#", "path", ln.cast("string"))
    steps = runs.where("end > start").select("path", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("ln"))
    edges = steps.select(at(F.col("ln")).alias("src"), at(F.col("ln") + 1).alias("dst"))
    sinks = c.where(F.col("rule_id").isin(*TAINTED)).select(at(F.col("ln")).alias("node")).distinct()
    sources = runs.select(at(F.col("start")).alias("node"))
    return flows(sources, sinks, sources.limit(0), edges)


def voted(t):
    """The findings, written once, and the votes on them."""
    c, f = cut(candidates(t)), files(t).withColumn("profile", F.lit("conf"))
    tainted = t.spark.createDataFrame([(r,) for r in TAINTED], "rule_id string")
    return c, ind.stacked({
        "comment": ind.comment_votes(c, f), "agreement": ind.agreement_votes(c), "flow": ind.flow_votes(c, tainted, line_flows(t, c)),
        "density": ind.density_votes(c, f), "rarity": ind.rarity_votes(c, f),
    })


NORMAL = r"""lower(regexp_replace(regexp_replace(regexp_replace(txt, '"[^"]*"|''[^'']*''', 'S', 'g'), '[0-9]+', 'N', 'g'), '[ \t\r\n\f]+', '', 'g'))"""
VOTES = f"""{FINDING}, cand AS (SELECT fid AS candidate, rule_id, path, ln, col, end_col, txt, cwe, CASE WHEN seq % 3 = 0 THEN 'taint' ELSE 'pattern' END AS engine, strpos(txt, '#') AS h FROM finding),
near AS (SELECT a.candidate, sum(CASE WHEN list_has_any(a.cwe, b.cwe) THEN 1 ELSE 0 END) AS w, sum(CASE WHEN list_has_any(a.cwe, b.cwe) THEN 0 ELSE 1 END) AS o FROM cand a JOIN cand b ON a.path = b.path AND b.ln BETWEEN a.ln - 1 AND a.ln + 1 AND a.rule_id <> b.rule_id AND len(a.cwe) > 0 AND len(b.cwe) > 0 GROUP BY a.candidate),
filled AS (SELECT *, ln - row_number() OVER (PARTITION BY path ORDER BY ln) AS grp FROM line WHERE length(trim(txt)) > 0), runs AS (SELECT path, min(ln) AS s, max(ln) AS e FROM filled GROUP BY path, grp),
useful AS (SELECT path, count(*) AS u FROM filled GROUP BY path HAVING count(*) >= 40), per AS (SELECT path, rule_id, count(*) AS n FROM cand GROUP BY ALL),
form AS (SELECT {NORMAL} AS f, count(*) AS n FROM filled GROUP BY 1 HAVING count(*) = 1 OR count(*) >= 100),
vote AS (SELECT candidate, 'comment' AS voter, 0 AS vote FROM cand WHERE h > 0 AND (h <= col OR trim(substring(txt, col, h - col)) = '') AND trim(substring(txt, greatest(h, col), end_col - greatest(h, col))) <> ''
UNION ALL SELECT candidate, 'agreement', CASE WHEN w > 0 THEN 1 ELSE 0 END FROM near WHERE w > 0 OR o > 1
UNION ALL SELECT candidate, 'flow', CASE WHEN engine = 'taint' THEN 1 ELSE 0 END FROM cand c WHERE rule_id IN {TAINTED} AND (engine = 'pattern' OR EXISTS (SELECT 1 FROM runs r WHERE r.path = c.path AND c.ln - r.s BETWEEN 1 AND 6 AND c.ln <= r.e))
UNION ALL SELECT candidate, 'density', CASE WHEN n / u > 0.2 THEN 0 ELSE 1 END FROM cand JOIN per USING (path, rule_id) JOIN useful USING (path) WHERE n / u > 0.2 OR (n <= 2 AND u > 120)
UNION ALL SELECT candidate, 'rarity', CASE WHEN n = 1 THEN 1 ELSE 0 END FROM cand JOIN form ON {NORMAL} = f)"""


@query("m17_voters", f"WITH {VOTES} SELECT candidate, voter, vote::INTEGER AS vote FROM vote")
def m17(t):
    return voted(t)[1]


@query("m18_induced_cases")
def m18(t):
    """Cases that the voters agree on; the label model is iterated, so plain Python checks it."""
    labels, _, _ = ind.induce(*voted(t))
    return labels.where("expected is not null").select("candidate", "rule_id", "case_id", F.round("p", 6).alias("p"), "voters", "expected")


@query("m18_a39_induced_verdicts")
def m18b(t):
    return ind.induce(*voted(t))[1]


@query(
    "m23_pair_rules",
    r"""WITH c AS (SELECT lang AS family, d.doc_id, coalesce(text, '') AS code, toxic = 1 AS bad FROM documents d JOIN labels USING (doc_id)), z AS (SELECT family, count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad FROM c GROUP BY family HAVING count(*) >= 4 AND count(*) FILTER (WHERE bad) > 0),
tok AS (SELECT DISTINCT family, doc_id, bad, lower(unnest(regexp_extract_all(code, '[A-Za-z_$][A-Za-z0-9_$]{2,}'))) AS token FROM c),
ok AS (SELECT family, token, tp, row_number() OVER (PARTITION BY family ORDER BY tp DESC, token) AS place FROM (SELECT family, token, count(*) FILTER (WHERE bad) AS tp, count(*) FILTER (WHERE NOT bad) AS fp FROM tok GROUP BY ALL) JOIN z USING (family) WHERE fp = 0 AND tp > 0 AND tp >= 0.1 * n_bad),
held AS (SELECT family, doc_id, token, place FROM tok JOIN ok USING (family, token) WHERE bad AND place <= 40),
two AS (SELECT family, x.token AS a, y.token AS b, row_number() OVER (PARTITION BY family ORDER BY count(*) DESC, any_value(x.place), any_value(y.place)) AS k FROM held x JOIN held y USING (family, doc_id) JOIN z USING (family) WHERE x.place < y.place GROUP BY family, x.token, y.token, n_bad HAVING count(*) >= 0.1 * n_bad),
rule AS (SELECT family, token AS a, NULL AS b, '(?i)(^|\n|[^A-Za-z0-9_$\n])' || replace(token, '$', '\$') || '($|\n|[^A-Za-z0-9_$\n])' AS regex FROM ok UNION ALL SELECT family, a, b, '(?i)(^|\n|[^A-Za-z0-9_$\n])' || replace(a, '$', '\$') || '[^A-Za-z0-9_$\n]([^\n]*[^A-Za-z0-9_$\n])?' || replace(b, '$', '\$') || '($|\n|[^A-Za-z0-9_$\n])' FROM two WHERE k <= 40),
n AS (SELECT family, a, b, regex, count(*) FILTER (WHERE bad) AS tp, count(*) FILTER (WHERE NOT bad) AS fp FROM c JOIN rule USING (family) WHERE regexp_matches(code, regex) GROUP BY ALL),
j AS (SELECT n.*, n_bad - tp AS fn, tp / (tp + fp) AS p, tp / n_bad AS r FROM n JOIN z USING (family) WHERE tp > 0 AND tp / (tp + fp) >= 0.85)
SELECT family, a, b, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, row_number() OVER (PARTITION BY family ORDER BY round(2 * tp / (2 * tp + fp + fn), 6) DESC, p DESC, b IS NOT NULL, a, b)::INTEGER AS nth FROM j""",
)
def m23(t):
    """Rules that tell the toxic documents of a language from the others; a tenth of them must hold a token."""
    cases = t.documents.join(t.labels, "doc_id").select(F.col("lang").alias("family"), F.col("doc_id").alias("case_id"), F.col("text").alias("code"), (F.col("toxic") == 1).alias("bad"))
    return mining.synthesize(cases, support=0.1).drop("regex")


#: Rules and their mutation specs, as data.
RULES = (("R1", "the ", None), ("R2", "de", None))
SPECS = (
    ("R1", 1, "append_regex_alt", " la "), ("R1", 2, "replace_in_regex", "the =>the [a-p]"), ("R1", 3, "set_unless", "[qz]"), ("R1", 4, "append_unless_alt", "xx"),
    ("R2", 1, "set_unless", "ende"), ("R2", 2, "append_regex_alt", "[a-f]ou"), ("R2", 3, "append_unless_alt", "[0-9]"), ("R2", 4, "replace_in_regex", "de=>de[a-z]"),
)


def _grown() -> str:
    """All masks with their patterns, scores and fitness, then one step for each generation."""
    value = lambda s: "NULL" if s is None else f"'{s}'"
    sql = "r0 AS (SELECT rule_id, regex, unless, mask::INTEGER AS mask FROM (VALUES " + ", ".join(f"({', '.join(map(value, r))})" for r in RULES) + ") v(rule_id, regex, unless), range(16) m(mask)), spec AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {i}, '{k}', '{v}')" for r, i, k, v in SPECS) + ") v(rule_id, i, kind, value))"
    for i in range(1, 5):
        on = f"(mask >> {i - 1}) % 2 = 1"
        swapped = "CASE WHEN strpos(regex, split_part(value, '=>', 1)) > 0 THEN substring(regex, 1, strpos(regex, split_part(value, '=>', 1)) - 1) || split_part(value, '=>', 2) || substring(regex, strpos(regex, split_part(value, '=>', 1)) + length(split_part(value, '=>', 1))) ELSE regex END"
        sql += f", r{i} AS (SELECT rule_id, mask, CASE WHEN {on} AND kind = 'append_regex_alt' THEN regex || '|' || value WHEN {on} AND kind = 'replace_in_regex' THEN {swapped} ELSE regex END AS regex, CASE WHEN {on} AND (kind = 'set_unless' OR kind = 'append_unless_alt' AND unless IS NULL) THEN value WHEN {on} AND kind = 'append_unless_alt' THEN unless || '|' || value ELSE unless END AS unless FROM r{i - 1} JOIN (SELECT * FROM spec WHERE i = {i}) USING (rule_id))"
    sql += """, cases AS (SELECT 'R1' AS rule_id, item_id AS case_id, text AS code, item_id % 3 <> 0 AS truth FROM benchmark UNION ALL SELECT 'R2', item_id, text, item_id % 3 = 0 FROM benchmark),
ran AS (SELECT r.rule_id, mask, case_id, truth, regexp_matches(code, regex) AND (unless IS NULL OR NOT regexp_matches(code, unless)) AS hit FROM r4 r JOIN cases USING (rule_id)),
n AS (SELECT rule_id, mask, count(*) FILTER (WHERE hit AND truth) AS tp, count(*) FILTER (WHERE hit AND NOT truth) AS fp, count(*) FILTER (WHERE NOT hit AND truth) AS fn FROM ran GROUP BY ALL),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM n), f AS (SELECT rule_id, mask, tp, fp, fn, p, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM s),
fit AS (SELECT *, round(1000 * f1 + 10 * p + 1 - bit_count(mask) / 5, 6) AS fitness FROM f), seen0 AS (SELECT *, 0 AS generation FROM fit WHERE mask IN (0, 1, 2, 4, 8, 15))"""
    for g in range(1, 4):
        sql += f""", top{g} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY fitness DESC, mask) AS k FROM seen{g - 1}) WHERE k <= 4),
seen{g} AS (SELECT * FROM seen{g - 1} UNION ALL SELECT f.*, {g} FROM fit f JOIN (SELECT DISTINCT rule_id, xor(mask, (1 << b)::INTEGER) AS mask FROM top{g}, range(4) x(b)) c USING (rule_id, mask) WHERE NOT EXISTS (SELECT 1 FROM seen{g - 1} s WHERE s.rule_id = f.rule_id AND s.mask = f.mask))"""
    return sql


GROWN = _grown()


def evolved(t):
    rules = t.spark.createDataFrame(list(RULES), "rule_id string, regex string, unless string")
    specs = t.spark.createDataFrame(list(SPECS), "rule_id string, id int, kind string, value string")
    b = t.benchmark
    third = F.col("item_id") % 3 == 0
    cases = b.select(F.lit("R1").alias("rule_id"), F.col("item_id").alias("case_id"), F.col("text").alias("code"), (~third).alias("truth")).unionByName(b.select(F.lit("R2").alias("rule_id"), F.col("item_id").alias("case_id"), F.col("text").alias("code"), third.alias("truth")))
    return ev.evolve(rules, specs, cases, generations=3)


@query("m20_generations", f"WITH {GROWN} SELECT rule_id, generation::INTEGER AS generation, mask, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(f1, 6) AS f1, fitness FROM seen3")
def m20(t):
    tables, _ = evolved(t)
    out = tables[0]
    for generation in tables[1:]:
        out = out.unionByName(generation)
    return out.select("rule_id", "generation", "mask", "tp", "fp", "fn", F.round("f1", 6).alias("f1"), "fitness")


@query("m20_decisions", f"""WITH {GROWN}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY fitness DESC, mask) AS k FROM seen3) WHERE k = 1), base AS (SELECT rule_id, f1 AS base_f1 FROM fit WHERE mask = 0),
worse AS (SELECT b.rule_id, count(*) FILTER (WHERE x.hit <> x.truth AND o.hit = o.truth) AS w FROM best b JOIN ran x ON x.rule_id = b.rule_id AND x.mask = b.mask JOIN ran o ON o.rule_id = b.rule_id AND o.mask = 0 AND o.case_id = x.case_id GROUP BY b.rule_id)
SELECT rule_id, mask, round(base_f1, 6) AS base_f1, round(f1, 6) AS f1, round(p, 6) AS precision, w::BIGINT AS regressions, CASE WHEN f1 - base_f1 <= 0.000001 THEN 'no-gain' WHEN p < 0.85 THEN 'imprecise' WHEN w > 0 THEN 'regression' ELSE 'promoted' END AS decision FROM best JOIN base USING (rule_id) JOIN worse USING (rule_id)""")  # fmt: skip
def m20b(t):
    return evolved(t)[1].select("rule_id", "mask", F.round("base_f1", 6).alias("base_f1"), F.round("f1", 6).alias("f1"), F.round("precision", 6).alias("precision"), "regressions", "decision")
