"""Queries on graphs: calls between customers, and links between pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import codegraph as cg
from siltstone.operators import graph as g
from siltstone.plans.fixtures import CALL, FINDING, calls, found
from siltstone.plans.registry import query

EDGE = "edge AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS src, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS dst FROM pages)"


def links(t):
    return t.pages.select(F.regexp_extract("url", "://([^/]*)", 1).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("dst"))


def entries(t):
    return t.customer.where("c_custkey % 50 = 0").select(F.col("c_custkey").cast("long").alias("node"))


@query("g1_edges", f"WITH {EDGE} SELECT src, dst, count(*)::BIGINT AS n FROM edge GROUP BY ALL")
def g1(t):
    return links(t).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("g2_degrees", f"WITH {CALL}, b AS (SELECT dst AS node, 1 AS i, 0 AS o FROM call UNION ALL SELECT src, 0, 1 FROM call) SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM b GROUP BY node")
def g2(t):
    return g.degrees(calls(t))


@query("g3_neighbours", f"WITH {CALL} SELECT DISTINCT src AS node, dst AS callee FROM call")
def g3(t):
    """A row for each neighbour: a hub's callees are many rows, never one value."""
    return calls(t).select(F.col("src").alias("node"), F.col("dst").alias("callee")).distinct()


HOPS = CALL
REACH = f"WITH RECURSIVE {HOPS}, hop(node, hops) AS (SELECT c_custkey::BIGINT, 0 FROM customer WHERE c_custkey % 50 = 0 UNION SELECT dst, hops + 1 FROM hop JOIN call ON src = node WHERE hops < 12), best AS (SELECT node, min(hops) AS hops FROM hop GROUP BY node)"


@query("g4_hops_to_entry", f"{REACH} SELECT node, hops::INTEGER AS hops FROM best")
def g4(t):
    return g.hops_from(entries(t), calls(t))


@query("g5_finding_enrichment", f"{REACH}, d AS (SELECT dst AS node, count(*) AS fan_in FROM call GROUP BY dst) SELECT o_orderkey, coalesce(fan_in, 0)::BIGINT AS fan_in, hops::INTEGER AS hops, round(0.55 * least(1, coalesce(fan_in, 0) / 20) + 0.45 * CASE WHEN hops IS NULL THEN 0.15 ELSE greatest(0, 1 - hops / 8) END, 3) AS priority FROM orders LEFT JOIN d ON d.node = o_custkey LEFT JOIN best b ON b.node = o_custkey")
def g5(t):
    e = calls(t)
    d = g.degrees(e).select("node", "fan_in")
    o = t.orders.select("o_orderkey", F.col("o_custkey").cast("long").alias("node"))
    j = o.join(d, "node", "left").join(g.hops_from(entries(t), e), "node", "left")
    fan = F.coalesce("fan_in", F.lit(0))
    return j.select("o_orderkey", fan.alias("fan_in"), "hops", g.priority(fan, F.col("hops")).alias("priority"))


@query("g6_summary", f"WITH {EDGE} SELECT count(*)::BIGINT AS edges, count(DISTINCT src)::BIGINT AS sources, count(DISTINCT dst)::BIGINT AS targets FROM edge")
def g6(t):
    return links(t).agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("g7_cycles", f"WITH RECURSIVE {CALL}, reach(a, b) AS (SELECT src, dst FROM call UNION SELECT a, dst FROM reach JOIN call ON src = b) SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1")
def g7(t):
    return g.cycles(calls(t))


@query("g8_coupling", f"WITH {CALL}, e AS (SELECT DISTINCT src, dst FROM call), b AS (SELECT dst AS node, 1 AS a, 0 AS e FROM e UNION ALL SELECT src, 0, 1 FROM e), s AS (SELECT node, sum(a) AS ca, sum(e) AS ce FROM b GROUP BY node) SELECT node, ca::BIGINT AS ca, ce::BIGINT AS ce, round(ce / (ca + ce), 3) AS instability FROM s")
def g8(t):
    return g.coupling(calls(t))


@query("g9_distance_risk", f"WITH {CALL}, e AS (SELECT DISTINCT src, dst FROM call), b AS (SELECT dst AS node, 1 AS a, 0 AS e FROM e UNION ALL SELECT src, 0, 1 FROM e), s AS (SELECT node, sum(a) AS ca, sum(e) AS ce FROM b GROUP BY node) SELECT node, round(abs((node % 10) / 10 + ce / (ca + ce) - 1), 3) AS distance, ((node % 17) * (1 + ca))::BIGINT AS risk FROM s")
def g9(t):
    c = g.coupling(calls(t))
    return c.select("node", F.round(F.abs((F.col("node") % 10) / 10 + F.col("ce") / (F.col("ca") + F.col("ce")) - 1), 3).alias("distance"), ((F.col("node") % 17) * (1 + F.col("ca"))).alias("risk"))


@query("g10_a16_orphans", f"WITH {CALL} SELECT c_nationkey, count(*)::BIGINT AS orphans FROM customer WHERE c_custkey NOT IN (SELECT dst FROM call) AND c_custkey % 50 <> 0 GROUP BY c_nationkey")
def g10(t):
    lone = t.customer.where("c_custkey % 50 != 0").join(calls(t).select(F.col("dst").alias("c_custkey")), "c_custkey", "left_anti")
    return lone.groupBy("c_nationkey").agg(F.count("*").alias("orphans"))


#: One level of the search after another; a place that a source has reached stays with its shorter path.
FLOW = "WITH " + CALL + ", clean AS (SELECT DISTINCT src, dst FROM call WHERE dst % 11 <> 5), f0 AS (SELECT c_custkey::BIGINT AS source, c_custkey::BIGINT AS place, [c_custkey::BIGINT] AS path FROM customer WHERE c_custkey % 50 = 0), s0 AS (SELECT source, place FROM f0)"
for _i in range(1, 7):
    FLOW += f", f{_i} AS (SELECT f.source, dst AS place, min(list_append(path, dst)) AS path FROM f{_i - 1} f JOIN clean ON src = f.place WHERE NOT list_contains(path, dst) AND NOT EXISTS (SELECT 1 FROM s{_i - 1} s WHERE s.source = f.source AND s.place = dst) GROUP BY f.source, dst), s{_i} AS (SELECT * FROM s{_i - 1} UNION ALL SELECT source, place FROM f{_i})"
FLOW += " SELECT source, place AS sink, array_to_string(path, '>') AS path FROM (" + " UNION ALL ".join(f"SELECT * FROM f{_i}" for _i in range(1, 7)) + ") WHERE place % 7 = 3 AND place IN (SELECT c_custkey FROM customer)"


@query("g11_flows", FLOW)
def g11(t):
    node = lambda c: t.customer.where(c).select(F.col("c_custkey").cast("long").alias("node"))
    return g.flows(node("c_custkey % 50 = 0"), node("c_custkey % 7 = 3"), node("c_custkey % 11 = 5"), calls(t)).select("source", "sink", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("g12_trace_coverage", "WITH s AS (SELECT user_id, event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), w AS (SELECT DISTINCT state AS src, nxt AS dst FROM s WHERE nxt IS NOT NULL AND nxt <> 'error'), k AS (SELECT DISTINCT state AS src, nxt AS dst FROM s WHERE nxt IS NOT NULL) SELECT count(*)::BIGINT AS total, sum(CASE WHEN w.src IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS hit, round(sum(CASE WHEN w.src IS NOT NULL THEN 1 ELSE 0 END) / count(*), 4) AS share FROM k LEFT JOIN w USING (src, dst)")
def g12(t):
    from pyspark.sql import Window as W

    step = F.struct("ts", "event_id")
    traces = t.events.where("event_type is not null").select(F.col("user_id").alias("trace"), step.alias("step"), F.col("event_type").alias("state"))
    known = traces.withColumn("dst", F.lead("state").over(W.partitionBy("trace").orderBy("step"))).where("dst is not null").select(F.col("state").alias("src"), "dst")
    walked = known.where("dst != 'error'").withColumn("trace", F.monotonically_increasing_id())
    steps = F.explode(F.array(F.struct(F.lit(0).alias("step"), F.col("src").alias("state")), F.struct(F.lit(1).alias("step"), F.col("dst").alias("state"))))
    return g.trace_coverage(walked.select("trace", steps.alias("x")).select("trace", "x.*"), known)


@query("l1_hotspots", f"WITH {EDGE} SELECT dst AS node, count(*)::BIGINT AS fan_in FROM edge GROUP BY dst ORDER BY fan_in DESC, node LIMIT 28")
def l1(t):
    e = links(t)
    return e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in")).orderBy(F.desc("fan_in"), "node").limit(28)


@query("s22_l2_hotspot_links", f"WITH {EDGE}, h AS (SELECT dst FROM edge GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 28) SELECT src, dst, count(*)::BIGINT AS n FROM edge WHERE dst IN (SELECT dst FROM h) GROUP BY ALL ORDER BY n DESC, src, dst LIMIT 90")
def s22(t):
    e = links(t)
    hot = e.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(28).select("dst")
    return e.join(F.broadcast(hot), "dst", "left_semi").groupBy("src", "dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src", "dst").limit(90)


@query("a15_l5_top_per_source", f"WITH {EDGE}, n AS (SELECT src, dst, count(*) AS n FROM edge GROUP BY ALL) SELECT src, dst, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM n) WHERE k <= 8")
def a15(t):
    from pyspark.sql import Window as W

    n = links(t).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(W.partitionBy("src").orderBy(F.desc("n"), "dst"))).where("k <= 8").select("src", "dst", "n")


@query("j13_call_resolution", "WITH d AS (SELECT p_partkey AS id, p_brand AS file, p_type || (p_size % 9) AS name FROM part), s AS (SELECT DISTINCT l_orderkey AS site, 'Brand#' || (l_partkey % 5) AS file, p_type || (l_linenumber % 9) AS name FROM lineitem JOIN part ON p_partkey = l_partkey), h AS (SELECT file, name, min(id) AS id FROM d GROUP BY ALL HAVING count(*) = 1), a AS (SELECT name, min(id) AS id FROM d GROUP BY ALL HAVING count(*) = 1) SELECT site, coalesce(h.id::VARCHAR, a.id::VARCHAR, 'unresolved:' || s.name) AS target, count(*)::BIGINT AS n FROM s LEFT JOIN h ON h.file = s.file AND h.name = s.name LEFT JOIN a ON a.name = s.name GROUP BY ALL")
def j13(t):
    d = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("file"), F.concat("p_type", (F.col("p_size") % 9).cast("string")).alias("name"))
    l = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    s = l.select(F.col("l_orderkey").alias("site"), F.concat(F.lit("Brand#"), (F.col("l_partkey") % 5).cast("string")).alias("file"), F.concat("p_type", (F.col("l_linenumber") % 9).cast("string")).alias("name")).distinct()
    return g.resolve_calls(s, d).groupBy("site", "target").agg(F.count("*").alias("n"))


@query("j14_import_resolution", f"WITH {EDGE}, f AS (SELECT DISTINCT dst || '.ts' AS path FROM edge WHERE length(dst) % 3 = 0 UNION SELECT DISTINCT dst || '/index.ts' FROM edge WHERE length(dst) % 2 = 0), i AS (SELECT DISTINCT dst AS base FROM edge) SELECT base AS id, CASE WHEN base || '.ts' IN (SELECT path FROM f) THEN base || '.ts' WHEN base || '/index.ts' IN (SELECT path FROM f) THEN base || '/index.ts' ELSE 'module:' || base END AS target FROM i")
def j14(t):
    d = links(t).select("dst").distinct()
    paths = d.where(F.length("dst") % 3 == 0).select(F.concat("dst", F.lit(".ts")).alias("path")).union(d.where(F.length("dst") % 2 == 0).select(F.concat("dst", F.lit("/index.ts"))))
    return g.resolve_imports(d.select(F.col("dst").alias("id"), F.col("dst").alias("base")), paths, ["", ".ts", ".tsx", "/index.ts"])


@query("w2_g5_callers_list", f"WITH {FINDING}, c AS (SELECT path, rule_id, row_number() OVER (PARTITION BY path ORDER BY rule_id, ln) AS k FROM finding) SELECT path, string_agg(rule_id, ',' ORDER BY k) AS first_rules FROM c WHERE k <= 8 GROUP BY path")
def w2g(t):
    from pyspark.sql import Window as W

    c = found(t).withColumn("k", F.row_number().over(W.partitionBy("path").orderBy("rule_id", "ln"))).where("k <= 8")
    return c.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "rule_id"))), lambda x: x["rule_id"]), ",").alias("first_rules"))


#: Customers are functions in files of their nation (a repository) and segment; orders call them by name and import files.
CODE = """WITH RECURSIVE def AS (SELECT c_custkey, 'n' || c_nationkey || '/' || lower(substring(c_mktsegment, 1, 4)) AS file, 'f' || (c_custkey * 7 % 611) AS name, c_custkey * 10 + 1 AS s, c_custkey * 10 + 8 + CASE WHEN c_custkey % 7 = 0 THEN 40 ELSE 0 END AS e, c_custkey % 50 = 0 AS entry FROM customer),
fn AS (SELECT *, file || '#' || name || '@' || s AS id FROM def), o AS (SELECT o_orderkey, file, o_custkey * 10 + o_orderkey % 12 AS line, 'f' || ((7 * o_custkey + 13 * o_orderkey) % 640) AS name,
 CASE WHEN o_orderkey % 11 = 0 THEN 'lib' || (o_orderkey % 17) ELSE './' || split_part(file, '/', 1) || '/' || ['auto', 'buil', 'furn', 'mach', 'none'][o_orderkey % 5 + 1] END AS spec, CASE WHEN o_orderkey % 11 <> 0 THEN split_part(file, '/', 1) || '/' || ['auto', 'buil', 'furn', 'mach', 'none'][o_orderkey % 5 + 1] END AS base FROM orders JOIN def ON c_custkey = o_custkey),
file AS (SELECT DISTINCT file AS path FROM def), cover AS (SELECT file, line, arg_max(id, (s, -e, id)) AS owner FROM (SELECT *, unnest(range(s, e + 1)) AS line FROM fn) GROUP BY ALL),
here AS (SELECT file, name, min(id) AS id FROM fn GROUP BY ALL HAVING count(*) = 1), anywhere AS (SELECT name, min(id) AS id FROM fn GROUP BY ALL HAVING count(*) = 1),
calls0 AS (SELECT coalesce(owner, 'file:' || o.file) AS src, coalesce(h.id, a.id, 'unresolved:' || o.name) AS dst, o.line, CASE WHEN coalesce(h.id, a.id) IS NULL THEN 'unknown' ELSE 'user' END AS resolved, o.name FROM o LEFT JOIN cover c ON c.file = o.file AND c.line = o.line LEFT JOIN here h ON h.file = o.file AND h.name = o.name LEFT JOIN anywhere a ON a.name = o.name),
edge AS (SELECT src, dst, 'calls' AS kind, line, resolved, name FROM calls0 WHERE src <> dst UNION ALL SELECT 'file:' || o.file, CASE WHEN base IN (SELECT path FROM file) THEN 'file:' || base ELSE 'module:' || spec END, 'imports', line, CASE WHEN base IN (SELECT path FROM file) THEN 'user' ELSE 'unknown' END, spec FROM o),
node AS (SELECT 'file:' || path AS id, 'file' AS kind, path AS file, path AS name, NULL::BIGINT AS s, NULL::BIGINT AS e, false AS entry FROM file UNION ALL SELECT id, 'function', file, name, s, e, entry FROM fn UNION ALL SELECT DISTINCT dst, CASE kind WHEN 'calls' THEN 'function' ELSE 'file' END, '', name, NULL::BIGINT, NULL::BIGINT, false FROM edge WHERE resolved = 'unknown')"""
FANS = "fan AS (SELECT node, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM edge WHERE kind = 'calls' UNION ALL SELECT src, 0, 1 FROM edge WHERE kind = 'calls') GROUP BY node)"
NEAR = "hop(node, hops) AS (SELECT id, 0 FROM fn WHERE entry UNION SELECT dst, hops + 1 FROM hop JOIN edge ON src = node WHERE kind = 'calls' AND hops < 12), best AS (SELECT node, min(hops) AS hops FROM hop GROUP BY node)"
ENRICHED = """near1 AS (SELECT dst AS node, string_agg(src, ' ' ORDER BY src) AS callers FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM (SELECT DISTINCT src, dst FROM edge WHERE kind = 'calls')) WHERE k <= 8 GROUP BY dst),
near2 AS (SELECT src AS node, string_agg(dst, ' ' ORDER BY dst) AS callees FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM (SELECT DISTINCT src, dst FROM edge WHERE kind = 'calls')) WHERE k <= 8 GROUP BY src),
used AS (SELECT src, string_agg(DISTINCT n.name, ' ' ORDER BY n.name) AS imports FROM edge JOIN node n ON n.id = dst WHERE edge.kind = 'imports' GROUP BY src),
found AS (SELECT o_orderkey AS fid, o.file, owner AS fun, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, hops, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees, coalesce(imports, '') AS imports FROM o LEFT JOIN cover c ON c.file = o.file AND c.line = o.line LEFT JOIN fan ON fan.node = owner LEFT JOIN best ON best.node = owner LEFT JOIN near1 ON near1.node = owner LEFT JOIN near2 ON near2.node = owner LEFT JOIN used ON used.src = 'file:' || o.file)"""
METRIC = "metric AS (SELECT file, count(*) * 8 AS loc, sum(1 + c_custkey % 7) AS cyclomatic, sum(c_custkey % 11) AS cognitive, count(*) AS functions FROM def GROUP BY file)"
ARCHITECTURE = METRIC + """, inner_ AS (SELECT DISTINCT substring(src, 6) AS src, substring(dst, 6) AS dst FROM edge WHERE kind = 'imports' AND resolved = 'user' AND src <> dst), outer_ AS (SELECT DISTINCT substring(src, 6) AS file, dst FROM edge WHERE kind = 'imports' AND resolved = 'unknown'),
reach(a, b) AS (SELECT src, dst FROM inner_ UNION SELECT a, dst FROM reach JOIN inner_ ON src = b), ring AS (SELECT x.a AS file, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1),
mod_ AS (SELECT m.*, split_part(m.file, '/', 1) AS repo, (SELECT count(*) FROM inner_ WHERE dst = m.file) AS ca, (SELECT count(*) FROM inner_ WHERE src = m.file) AS ce, m.file IN (SELECT file FROM fn WHERE entry) AS entry, component FROM metric m LEFT JOIN ring ON ring.file = m.file),
total AS (SELECT repo, count(*) AS modules, sum(loc) AS loc, sum(functions) AS functions, round(sum(cyclomatic) / sum(functions), 1) AS cyclomatic_mean, round(sum(cognitive) / sum(functions), 1) AS cognitive_mean, sum(ce) AS internal_edges, count(component) AS in_cycle, count(*) FILTER (WHERE ca = 0 AND NOT entry AND loc > 0) AS orphans, (SELECT count(DISTINCT dst) FROM outer_ WHERE split_part(file, '/', 1) = repo) AS external FROM mod_ GROUP BY repo)"""
PLACED = "spot AS (SELECT *, split_part(file, '/', 1) AS repo, row_number() OVER (PARTITION BY split_part(file, '/', 1) ORDER BY fan_in DESC, name, id) AS k FROM node JOIN fan ON node = id LEFT JOIN best ON best.node = id WHERE kind = 'function' AND file <> '')"


def code_tables(t):
    c, o, repo = t.customer, t.orders, F.split("file", "/")[0]
    k = F.col("c_custkey").cast("long")
    d = c.select(k.alias("c_custkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/"), F.lower(F.substring("c_mktsegment", 1, 4))).alias("file"), F.concat(F.lit("f"), (k * 7 % 611).cast("string")).alias("name"), (k * 10 + 1).alias("start"), (k * 10 + 8 + F.when(k % 7 == 0, 40).otherwise(0)).alias("end"), (k % 50 == 0).alias("entry"))
    j, key = o.join(d.select(F.col("c_custkey").alias("o_custkey"), "file"), "o_custkey"), F.col("o_orderkey").cast("long")
    other = F.concat(repo, F.lit("/"), F.get(F.array(*map(F.lit, ("auto", "buil", "furn", "mach", "none"))), (key % 5).cast("int")))
    library = key % 11 == 0
    s = j.select(key.alias("fid"), "file", (F.col("o_custkey").cast("long") * 10 + key % 12).alias("line"), F.concat(F.lit("f"), ((7 * F.col("o_custkey").cast("long") + 13 * key) % 640).cast("string")).alias("name"), F.when(library, F.concat(F.lit("lib"), (key % 17).cast("string"))).otherwise(F.concat(F.lit("./"), other)).alias("spec"), F.when(~library, other).alias("base"))
    return d, s


def code_graph(t):
    d, s = code_tables(t)
    nodes, edges = cg.build(d.select(F.col("file").alias("path")).distinct(), d, s, s)
    return d, s, nodes, edges


def code_architecture(t):
    d, _, nodes, edges = code_graph(t)
    k = F.col("c_custkey")
    metrics = d.groupBy("file").agg((F.count("*") * 8).alias("loc"), F.sum(1 + k % 7).alias("cyclomatic"), F.sum(k % 11).alias("cognitive"), F.count("*").alias("functions"))
    return cg.architecture(nodes, edges, metrics, F.split("file", "/")[0])


@query("g1_nodes", f'{CODE} SELECT id, kind, file, name, s AS start, e AS "end", entry FROM node')
def g1_nodes(t):
    return code_graph(t)[2].select("id", "kind", "file", "name", "start", "end", "entry")


@query("g1_graph_edges", f"{CODE} SELECT src, dst, kind, line::BIGINT AS line, resolved FROM edge")
def g1_graph_edges(t):
    return code_graph(t)[3].select("src", "dst", "kind", "line", "resolved")


@query("g5_call_graph_evidence", f"{CODE}, {FANS}, {NEAR}, {ENRICHED} SELECT fid, fun AS function, fan_in::BIGINT AS fan_in, fan_out::BIGINT AS fan_out, hops::INTEGER AS hops, callers, callees, imports, round(0.55 * least(1, fan_in / 20) + 0.45 * CASE WHEN hops IS NULL THEN 0.15 ELSE greatest(0, 1 - hops / 8) END, 3) AS priority FROM found")
def g5_evidence(t):
    _, s, nodes, edges = code_graph(t)
    out = cg.enrich(s.select("fid", "file", "line"), nodes, edges)
    return out.select("fid", "function", "fan_in", "fan_out", "hops", *(F.array_join(c, " ").alias(c) for c in ("callers", "callees", "imports")), "priority")


@query("l2_drawn_hotspots", f"{CODE}, {FANS}, {NEAR}, {ENRICHED}, every AS (SELECT fun AS id, fan_in, fan_out, hops FROM found WHERE fun IS NOT NULL UNION ALL SELECT unnest(string_split(callers, ' ')), 0, 0, NULL FROM found WHERE fun IS NOT NULL AND callers <> '' UNION ALL SELECT unnest(string_split(callees, ' ')), 0, 0, NULL FROM found WHERE fun IS NOT NULL AND callees <> ''), m AS (SELECT id, max(fan_in) AS fan_in, max(fan_out) AS fan_out, min(hops) AS hops FROM every GROUP BY id) SELECT m.id, name, file, fan_in::BIGINT AS fan_in, fan_out::BIGINT AS fan_out, hops::INTEGER AS hops FROM m JOIN node ON node.id = m.id ORDER BY fan_in DESC, name, m.id LIMIT 28")
def l2_hotspots(t):
    _, s, nodes, edges = code_graph(t)
    return cg.drawing(cg.enrich(s.select("fid", "file", "line"), nodes, edges), nodes)[0].select("id", "name", "file", "fan_in", "fan_out", "hops")


@query("l2_drawn_links", f"{CODE}, {FANS}, {NEAR}, {ENRICHED}, every AS (SELECT fun AS id, fan_in FROM found WHERE fun IS NOT NULL UNION ALL SELECT unnest(string_split(callers || ' ' || callees, ' ')), 0 FROM found WHERE fun IS NOT NULL), hot AS (SELECT id FROM (SELECT id, max(fan_in) AS fan_in FROM every WHERE id <> '' GROUP BY id) JOIN node USING (id) ORDER BY fan_in DESC, name, id LIMIT 28), l AS (SELECT DISTINCT src, dst FROM (SELECT unnest(string_split(callers, ' ')) AS src, fun AS dst FROM found WHERE fun IS NOT NULL UNION ALL SELECT fun, unnest(string_split(callees, ' ')) FROM found WHERE fun IS NOT NULL) WHERE src <> '' AND dst <> '') SELECT src, dst FROM l WHERE src IN (SELECT id FROM hot) OR dst IN (SELECT id FROM hot) ORDER BY src, dst LIMIT 90")
def l2_links(t):
    _, s, nodes, edges = code_graph(t)
    return cg.drawing(cg.enrich(s.select("fid", "file", "line"), nodes, edges), nodes)[1]


REPOS = "n_ AS (SELECT split_part(CASE WHEN file = '' THEN '?' ELSE file END, '/', 1) AS repo, count(*) AS nodes, count(*) FILTER (WHERE kind = 'function') AS functions, count(*) FILTER (WHERE entry) AS entries FROM node GROUP BY 1), e_ AS (SELECT split_part(replace(src, 'file:', ''), '/', 1) AS repo, count(*) AS edges, count(*) FILTER (WHERE kind = 'calls') AS calls, count(*) FILTER (WHERE kind = 'imports') AS imports FROM edge GROUP BY 1), tot AS (SELECT n_.*, coalesce(edges, 0) AS edges, coalesce(calls, 0) AS calls, coalesce(imports, 0) AS imports FROM n_ LEFT JOIN e_ USING (repo))"


def code_portfolio(t):
    _, _, nodes, edges = code_graph(t)
    repo = F.split(F.when(F.col("file") == "", "?").otherwise(F.col("file")), "/")[0]
    return cg.graph_totals(nodes, edges, repo, F.split(F.replace("src", F.lit("file:"), F.lit("")), "/")[0]), cg.hotspots_of(nodes, edges, repo)


@query("a15_portfolio_graph", f"{CODE}, {FANS}, {NEAR}, {PLACED}, {REPOS}, b AS (SELECT count(*) FILTER (WHERE hops = 0) AS entry, count(*) FILTER (WHERE hops = 1) AS hop1, count(*) FILTER (WHERE hops = 2) AS hop2, count(*) FILTER (WHERE hops >= 3) AS hop3plus, count(*) FILTER (WHERE hops IS NULL) AS unknown FROM spot WHERE k <= 28) SELECT count(*)::BIGINT AS repos, sum(functions)::BIGINT AS functions, sum(calls)::BIGINT AS calls, sum(imports)::BIGINT AS imports, sum(entries)::BIGINT AS entries, sum(nodes)::BIGINT AS nodes, sum(edges)::BIGINT AS edges, any_value(entry)::BIGINT AS entry, any_value(hop1)::BIGINT AS hop1, any_value(hop2)::BIGINT AS hop2, any_value(hop3plus)::BIGINT AS hop3plus, any_value(unknown)::BIGINT AS unknown FROM tot, b")
def a15_portfolio(t):
    return cg.portfolio_graph(*code_portfolio(t))


@query("a15_top_repositories", f"{CODE}, {FANS}, {NEAR}, {PLACED}, {REPOS} SELECT tot.repo, functions::BIGINT AS functions, calls::BIGINT AS calls, imports::BIGINT AS imports, coalesce((SELECT max(fan_in) FROM spot WHERE spot.repo = tot.repo AND k <= 28), 0)::BIGINT AS max_fan_in FROM tot ORDER BY functions DESC, tot.repo LIMIT 10")
def a15_repositories(t):
    return cg.top_repositories(*code_portfolio(t)).select("repo", "functions", "calls", "imports", "max_fan_in")


@query("g10_architecture_totals", f"{CODE}, {ARCHITECTURE} SELECT repo, modules::BIGINT AS modules, loc::BIGINT AS loc, functions::BIGINT AS functions, cyclomatic_mean, cognitive_mean, internal_edges::BIGINT AS internal_edges, in_cycle::BIGINT AS in_cycle, orphans::BIGINT AS orphans, external::BIGINT AS external FROM total")
def g10_totals(t):
    return code_architecture(t)[0]


@query("g10_modules", f"{CODE}, {ARCHITECTURE} SELECT file, ca::BIGINT AS ca, ce::BIGINT AS ce, (SELECT count(*) FROM outer_ WHERE outer_.file = mod_.file)::BIGINT AS external, CASE WHEN ca + ce > 0 THEN round(ce / (ca + ce), 3) END AS instability, (cognitive * (1 + ca))::BIGINT AS risk, entry, component FROM mod_")
def g10_modules(t):
    return code_architecture(t)[1].select("file", "ca", "ce", "external", "instability", "risk", "entry", "component")


@query("a16_portfolio_architecture", f"{CODE}, {ARCHITECTURE} SELECT count(*)::BIGINT AS repos, sum(modules)::BIGINT AS modules, sum(functions)::BIGINT AS functions, sum(loc)::BIGINT AS loc, sum(internal_edges)::BIGINT AS internal_edges, sum(external)::BIGINT AS external, sum(in_cycle)::BIGINT AS in_cycle, sum(orphans)::BIGINT AS orphans, round(sum(cognitive_mean * functions) / sum(functions), 1) AS cognitive_mean, round(sum(cyclomatic_mean * functions) / sum(functions), 1) AS cyclomatic_mean FROM total")
def a16_portfolio(t):
    return cg.portfolio_architecture(code_architecture(t)[0])


@query("a16_top_risk", f"{CODE}, {ARCHITECTURE} SELECT repo, file, ca::BIGINT AS ca, ce::BIGINT AS ce, cognitive::BIGINT AS cognitive, (cognitive * (1 + ca))::BIGINT AS risk, component FROM mod_ ORDER BY risk DESC, repo, file LIMIT 15")
def a16_risk(t):
    return cg.top_risk(code_architecture(t)[1])


@query("a16_top_cycles", f"{CODE}, {ARCHITECTURE} SELECT split_part(file, '/', 1) AS repo, component, count(*)::BIGINT AS size FROM ring GROUP BY ALL ORDER BY repo, component LIMIT 8")
def a16_cycles(t):
    return cg.top_cycles(code_architecture(t)[2])
