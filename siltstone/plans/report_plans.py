"""Queries of the report readers and writers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import graph as g
from siltstone.plans.fixtures import FINDING, LINE, UNIT, files, found, units
from siltstone.plans.registry import query
from siltstone.sources import reports as r
from siltstone.sources import table_functions as tf


ORIGINS = """every AS (SELECT 'native' AS origin, rule_id FROM finding WHERE seq % 2 = 0 UNION ALL SELECT 'imported', rule_id FROM finding WHERE seq % 2 = 1
 UNION ALL SELECT 'structural', 'UNIT-BRANCHES' FROM unit WHERE cyclomatic > 5 UNION ALL SELECT 'metric', 'METRIC-LINES' FROM (SELECT path FROM line GROUP BY path HAVING count(*) > 12) UNION ALL SELECT 'metric', 'METRIC-LONGEST' FROM (SELECT path FROM line GROUP BY path HAVING max(length(txt)) > 400))"""


def every_origin(t):
    """Findings of the packs (half of them as another tool's), of units, and of metrics over their limits."""
    from siltstone.functions.text import lines
    from siltstone.operators.metrics import over_threshold

    f = found(t).select("path", F.col("ln").cast("int").alias("ln"), "col", "rule_id", "severity", "snippet", "seq")
    structural = units(t).where("cyclomatic > 5").select("path", F.col("start").cast("int").alias("ln"), F.lit(1).alias("col"), F.lit("UNIT-BRANCHES").alias("rule_id"), F.lit("MAJOR").alias("severity"), F.col("unit").alias("snippet"))
    g = lines(files(t)).groupBy("path").agg(F.count("*").alias("lines"), F.max(F.length("txt")).alias("longest"))
    metric = over_threshold(g, {"lines": 12, "longest": 400}, "path").withColumn("ln", F.lit(1))
    return r.all_findings(f.where("seq % 2 = 0"), structural, metric, f.where("seq % 2 = 1"))


@query("s18_sarif_logs", f"WITH {FINDING}, {UNIT.replace(LINE + ',', '').lstrip(', ')}, {ORIGINS} SELECT origin, count(*)::BIGINT AS results, count(DISTINCT rule_id)::BIGINT AS rules FROM every GROUP BY origin")
def s18(t):
    """Logs of each origin, read back: results and rules."""
    logs = r.sarif_rows(every_origin(t), ["origin"], "siltstone")
    run = F.from_json("value", r.SARIF)["runs"][0]
    back = logs.select("origin", run.alias("run")).select("origin", F.size("run.results").alias("n"), F.posexplode("run.tool.driver.rules").alias("i", "rule"))
    return back.groupBy("origin").agg(F.sum(F.when(F.col("i") == 0, F.col("n")).otherwise(0)).alias("results"), F.countDistinct("rule.id").alias("rules"))


@query("s5_lint_findings", f"WITH {FINDING} SELECT path, rule_id, CASE WHEN severity IN ('BLOCKER', 'CRITICAL') THEN 'CRITICAL' ELSE 'MAJOR' END AS severity, count(*)::BIGINT AS n FROM finding WHERE rule_id <> 'STYLE-CAPS' GROUP BY ALL")
def s5(t):
    """Findings as a linter's files, some messages without a rule, read back."""
    level = F.when(F.col("severity").isin("BLOCKER", "CRITICAL"), 2).otherwise(1)
    message = F.struct(F.when(F.col("rule_id") != "STYLE-CAPS", F.col("rule_id")).alias("ruleId"), level.alias("severity"), F.col("snippet").alias("message"), F.col("ln").alias("line"), F.col("col").alias("column"))
    rows = found(t).groupBy("path").agg(F.collect_list(message).alias("messages")).select(F.to_json(F.struct(F.concat(F.lit("./"), "path").alias("filePath"), "messages")).alias("value"))
    return r.read_lint(t.spark, _written(t, rows, "lint"), lines=True).groupBy("path", "rule_id", "severity").agg(F.count("*").alias("n"))


def _xml_written(t, rows, name):
    """Files of about 500 rows each, every one a whole document."""
    from siltstone.streaming.events import shared_folder

    path = f"{shared_folder(t.spark)}/{name}"
    whole = rows.groupBy("chunk").agg(F.concat(F.lit("<report>"), F.array_join(F.collect_list("value"), "\n"), F.lit("</report>")).alias("value"))
    whole.repartition("chunk").write.partitionBy("chunk").text(path)
    return f"{path}/chunk=*"


def _class_reports(t):
    """A class of each document in the three XML forms."""
    d = t.documents.select(F.floor(F.col("doc_id") / 500).alias("chunk"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 3).cast("string").alias("hits"), (F.col("doc_id") % 4).cast("string").alias("b"), (1 + F.col("doc_id") % 5).cast("string").alias("last"))
    text = lambda *parts: F.concat(*(F.lit(p) if i % 2 == 0 else F.col(p) for i, p in enumerate(parts)))
    cobertura = text('<class filename="', "path", '"><lines><line number="1" hits="', "hits", '" branch="true" condition-coverage="50% (', "b", '/4)"/><line number="2" hits="0"/></lines></class>')
    jacoco = text('<package name="p.q"><sourcefile name="', "path", '"><line nr="1" mi="1" ci="', "hits", '" mb="1" cb="', "b", '"/></sourcefile></package>')
    jcov = text('<class name="x" source="', "path", '"><method><bl s="1" e="', "last", '" c="', "hits", '"/></method><bl s="1" e="1" c="1"/></class>')
    return {k: _xml_written(t, d.select("chunk", v.alias("value")), k) for k, v in (("cobertura", cobertura), ("jacoco", jacoco), ("jcov", jcov))}


@query("s7_xml_coverage", "WITH d AS (SELECT source || '/' || doc_id AS path, doc_id FROM documents) SELECT 'cobertura' AS kind, path, 2::BIGINT AS lines, (doc_id % 3 > 0)::BIGINT AS hit FROM d UNION ALL SELECT 'jacoco', 'p/q/' || path, 1, (doc_id % 3 > 0)::BIGINT FROM d UNION ALL SELECT 'jcov', path, 1 + doc_id % 5, CASE WHEN doc_id % 3 > 0 THEN 1 + doc_id % 5 ELSE 1 END FROM d")
def s7(t):
    readers = {"cobertura": r.read_cobertura, "jacoco": r.read_jacoco, "jcov": r.read_jcov}
    out = None
    for kind, path in _class_reports(t).items():
        one = readers[kind](t.spark, path).groupBy("path").agg(F.count("*").alias("lines"), F.count_if("hit").alias("hit")).select(F.lit(kind).alias("kind"), "path", "lines", "hit")
        out = one if out is None else out.unionByName(one)
    return out


@query("s7_branch_counters", "WITH d AS (SELECT source || '/' || doc_id AS path, doc_id FROM documents) SELECT 'cobertura' AS kind, path, doc_id % 4 AS covered, 4::BIGINT AS total FROM d UNION ALL SELECT 'jacoco', 'p/q/' || path, doc_id % 4, 1 + doc_id % 4 FROM d")
def s7b(t):
    paths = _class_reports(t)
    one = lambda kind: r.read_branches(t.spark, paths[kind], kind).select(F.lit(kind).alias("kind"), "path", "covered", "total")
    return one("cobertura").unionByName(one("jacoco"))


@query("s11_diff_hunks", "SELECT source || '/' || doc_id AS path, (5 + doc_id % 11)::BIGINT AS start, (5 + doc_id % 11 + greatest(1, doc_id % 7) - 1)::BIGINT AS \"end\" FROM documents")
def s11(t):
    d = t.documents.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("p"), (5 + F.col("doc_id") % 11).cast("string").alias("at"), (F.col("doc_id") % 7).cast("string").alias("k"))
    rows = d.select(F.concat(F.lit("--- a/x\n+++ b/"), "p", F.lit("\n@@ -1,2 +"), "at", F.when(F.col("k") != "1", F.concat(F.lit(","), "k")).otherwise(""), F.lit(" @@")).alias("value"))
    return r.read_diff(t.spark, _written(t, rows, "hunks"), ranges=True).select("path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    "s17_watch_list",
    """WITH a AS (SELECT 'GHSA-' || doc_id % 97 AS ghsa_id, 'CVE-' || doc_id AS cve_id, upper(CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE lang END) AS severity, source AS ecosystem, substring(coalesce(text, ''), 1, 300) AS summary, TIMESTAMP '2024-01-01' + to_hours(doc_id % 3000) AS published_at FROM documents),
n AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY ghsa_id ORDER BY published_at DESC, cve_id DESC) = 1),
w AS (SELECT DISTINCT 'GHSA-' || doc_id % 130 AS ghsa_id, 'old' AS cve_id, 'HIGH' AS severity, 'x' AS ecosystem, '' AS summary, TIMESTAMP '2024-01-01' + to_days((doc_id % 130)::INTEGER) AS published_at FROM labels),
u AS (SELECT * FROM n UNION ALL SELECT w.* FROM w ANTI JOIN n USING (ghsa_id)) SELECT ghsa_id, cve_id, severity, ecosystem, summary FROM u WHERE published_at >= DATE '2024-04-25' - 90""",
)
def s17(t):
    """A feed from the documents, read, reduced to the newest of each id and merged into a watch list."""
    at = lambda unit, n: F.expr(f"TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, {n if unit == 'days' else 0}, {n if unit == 'hours' else 0}, 0, 0)")
    d = t.documents.select(
        F.concat(F.lit("GHSA-"), (F.col("doc_id") % 97).cast("string")).alias("ghsa_id"), F.concat(F.lit("CVE-"), F.col("doc_id").cast("string")).alias("cve_id"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).otherwise("").alias("severity"),
        F.col("source").alias("ecosystem"), F.col("text").alias("summary"), F.array(F.struct(F.lit("CWE-79").alias("cwe_id"))).alias("cwes"), at("hours", "int(doc_id % 3000)").alias("published_at"),
    )
    fetched = r.read_advisories(t.spark, _written(t, d.select(F.to_json(F.struct(*d.columns)).alias("value")), "feed"))
    k = F.col("doc_id") % 130
    watched = t.labels.select(
        F.concat(F.lit("GHSA-"), k.cast("string")).alias("ghsa_id"), at("days", "int(doc_id % 130)").alias("published_at"), F.lit("old").alias("cve_id"), F.lit("HIGH").alias("severity"), F.lit("x").alias("ecosystem"), F.lit("").alias("summary"),
        F.array().cast("array<string>").alias("cwe_ids"),
    ).distinct()
    return r.upsert_advisories(watched, fetched, F.lit("2024-04-25").cast("date")).drop("published_at", "cwe_ids")


@query("s19_work_list", f"WITH {FINDING} SELECT '- [ ] **' || severity || '** `' || rule_id || '` ' || path || ':' || ln AS value FROM finding")
def s19(t):
    return r.work_list(found(t)).select("value")


@query("p34_document_structure", "SELECT 'front-matter-missing' AS \"check\", count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'name-missing', count(*) FROM documents UNION ALL SELECT 'description-missing', count(*) FROM documents UNION ALL SELECT 'no-heading', count(*) FROM documents WHERE NOT regexp_matches(text, '(?m)^#+ ') UNION ALL SELECT 'body-too-long', count(*) FROM documents WHERE len(string_split(text, chr(10))) > 500 HAVING count(*) > 0 UNION ALL SELECT 'body-empty', count(*) FROM documents WHERE trim(text) = '' HAVING count(*) > 0")
def p34(t):
    return r.front_matter_checks(files(t)).groupBy("check").agg(F.count("*").alias("n"))


@query("s14_golden_cases", "SELECT item_id, text FROM benchmark UNION SELECT doc_id + 1000000, text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def s14(t):
    extra = t.documents.join(t.labels.where("toxic = 1"), "doc_id").select((F.col("doc_id") + 1000000).alias("item_id"), "text")
    return t.benchmark.select("item_id", "text").unionByName(extra).distinct()


@query("s9_coverage_formats", "SELECT doc_id % 4 AS kind, CASE doc_id % 4 WHEN 0 THEN 'gocover' WHEN 1 THEN 'lcov' WHEN 2 THEN 'cobertura' END AS format, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def s9(t):
    head = F.when(F.col("doc_id") % 4 == 0, "mode: set\n").when(F.col("doc_id") % 4 == 1, "SF:a\n").when(F.col("doc_id") % 4 == 2, "<coverage>").otherwise("")
    d = t.documents.select((F.col("doc_id") % 4).alias("kind"), r.coverage_format(F.concat(head, F.regexp_replace("text", "<", ""))).alias("format"))
    return d.groupBy("kind", "format").agg(F.count("*").alias("n"))


def _written(t, rows, name):
    """A folder of text files that Spark writes from the tables, for the readers of text formats."""
    from siltstone.streaming.events import shared_folder

    path = f"{shared_folder(t.spark)}/{name}"
    rows.select("value").write.text(path)
    return path


@query("s10_diff_lines", "SELECT source || '/' || doc_id AS path, count(*)::BIGINT AS n FROM (SELECT source, doc_id, unnest(range(1, 1 + doc_id % 7)) AS k FROM documents) GROUP BY 1")
def s10(t):
    d = t.documents.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("p"), (F.col("doc_id") % 7).alias("k"))
    path = _written(t, d.select(F.concat(F.lit("--- a/x\n+++ b/"), "p", F.lit("\n@@ -1,2 +5,"), F.col("k").cast("string"), F.lit(" @@")).alias("value")), "diffs")
    return r.read_diff(t.spark, path).groupBy("path").agg(F.count("*").alias("n"))


@query("s6_lcov_lines", "SELECT source || '/' || doc_id AS path, (doc_id % 3 > 0) AS hit FROM documents")
def s6(t):
    d = t.documents.select(F.concat(F.lit("SF:"), F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.lit("\nDA:1,"), (F.col("doc_id") % 3).cast("string"), F.lit("\nend_of_record")).alias("value"))
    return r.read_lcov(t.spark, _written(t, d, "lcov")).select("path", "hit")


@query("s8_go_cover_lines", "SELECT source || '/' || doc_id AS path, (1 + doc_id % 5)::BIGINT AS n FROM documents")
def s8(t):
    d = t.documents.select(F.format_string("%s/%d:2.1,%d.9 1 1", "source", "doc_id", (2 + F.col("doc_id") % 5).cast("int")).alias("value"))
    return r.read_go_cover(t.spark, _written(t, d, "go")).groupBy("path").agg(F.count("*").alias("n"))


@query("s3_s4_sarif_import", f"WITH {FINDING} SELECT tool, count(*)::BIGINT AS n FROM (SELECT DISTINCT 'siltstone' AS tool, rule_id, path, ln FROM finding) GROUP BY tool")
def s3(t):
    path = _written(t, r.sarif_rows(found(t), ["source"], "siltstone"), "sarif")
    return r.import_reports(r.read_sarif_lines(t.spark, path))[1]


@query("m22_patch_cases", "WITH l AS (SELECT doc_id AS id, string_split_regex('-' || replace(coalesce(text, ''), chr(10), chr(10) || '+'), '\\r?\\n') AS l FROM documents), s AS (SELECT id, 'before' AS side, list_transform(list_filter(l, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')), lambda x: substring(x, 2)) AS p FROM l UNION ALL SELECT id, 'after', list_transform(list_filter(l, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), lambda x: substring(x, 2)) FROM l) SELECT id, side, length(array_to_string(p, chr(10)))::INTEGER AS n FROM s WHERE length(array_to_string(p, chr(10))) >= 20")
def m22(t):
    d = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("--- a\n+++ b\n-"), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n+")).alias("diff"))
    return r.patch_cases(d).select("id", "side", F.length("text").alias("n"))


@query(
    "s23_include_expansion",
    f"""WITH RECURSIVE {LINE}, l AS (SELECT path, doc_id, source, ln, CASE WHEN ln = 2 THEN source || '/' || (doc_id + 1) END AS include FROM line),
x AS (SELECT path AS file, path AS origin, include, [path] AS stack, 0 AS depth FROM l UNION ALL SELECT x.file, l.path, l.include, list_append(x.stack, l.path), depth + 1 FROM x JOIN l ON l.path = x.include WHERE depth < 10 AND NOT list_contains(x.stack, x.include))
SELECT file, count(*)::BIGINT AS rows, count(DISTINCT origin)::BIGINT AS files, count(include)::BIGINT AS open FROM x WHERE depth >= 10 OR include IS NULL OR list_contains(stack, include) OR include NOT IN (SELECT path FROM l) GROUP BY file""",
)
def s23(t):
    """Documents include the next one of their source in their second line."""
    from siltstone.functions.text import lines

    rows = lines(files(t)).select(F.col("path").alias("file"), "ln", F.col("txt").alias("text"), F.when(F.col("ln") == 2, F.concat_ws("/", "source", (F.col("doc_id") + 1).cast("string"))).alias("include"), F.lit("the").alias("replace_from"), F.lit("THE").alias("replace_to"))
    return g.expand_includes(rows).groupBy("file").agg(F.count("*").alias("rows"), F.countDistinct("origin").alias("files"), F.count("include").alias("open"))


@query("s21_archive_days", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 20 DAY GROUP BY 1")
def s21(t):
    from siltstone.operators.joins import retention
    from siltstone.streaming.events import shared_folder

    path = f"{shared_folder(t.spark)}/archive"
    r.archive(retention(t.events, 20, F.lit(False)).where("due").drop("due"), path)
    return t.spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("x8_lcov_table_function", "SELECT source || '/' || doc_id AS path, (doc_id % 3 > 0) AS hit FROM documents")
def x8_lcov(t):
    d = t.documents.select(F.concat(F.lit("SF:"), F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.lit("\nDA:1,"), (F.col("doc_id") % 3).cast("string"), F.lit("\nend_of_record")).alias("value"))
    return tf.lcov_lines(t.spark, _written(t, d, "lcov")).select("path", "hit")


@query("x8_diff_table_function", "SELECT source || '/' || doc_id AS path, count(*)::BIGINT AS n FROM (SELECT source, doc_id, unnest(range(1, 1 + doc_id % 7)) AS k FROM documents) GROUP BY 1")
def x8_diff(t):
    d = t.documents.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("p"), (F.col("doc_id") % 7).alias("k"))
    path = _written(t, d.select(F.concat(F.lit("--- a/x\n+++ b/"), "p", F.lit("\n@@ -1,2 +5,"), F.col("k").cast("string"), F.lit(" @@")).alias("value")), "diffs")
    return tf.diff_lines(t.spark, path).groupBy("path").agg(F.count("*").alias("n"))
