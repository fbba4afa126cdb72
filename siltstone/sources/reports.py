"""Readers and writers of scan, lint, coverage and diff reports.

Reports are text in files, so each reader is ``spark.read`` with a fixed schema and explodes. Formats whose meaning
depends on the order of lines (LCOV, diffs) read one file as one row and fill forward inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.severity import severity_level, severity_of_cvss, severity_of_level
from siltstone.functions.text import imported_fingerprint, normal_path

SARIF = """runs array<struct<
 tool:struct<driver:struct<name:string,rules:array<struct<id:string,helpUri:string,properties:struct<tags:array<string>,`security-severity`:string>>>>>,
 results:array<struct<ruleId:string,ruleIndex:int,level:string,message:struct<text:string>,
  locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>>>>>"""


def read_sarif(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Imported findings of SARIF files (or lines): rules by id, else by index; results without a place are dropped."""
    logs = spark.read.schema(SARIF + ", _corrupt_record string").option("multiLine", str(not lines).lower()).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())
    runs = logs.select("file", F.explode("runs").alias("run"))
    rows = runs.select("file", F.col("run.tool.driver.name").alias("tool"), F.col("run.tool.driver.rules").alias("rules"), F.posexplode("run.results").alias("seq", "r")).where(F.size("r.locations") > 0)
    by_id = F.filter("rules", lambda x: x["id"] == F.col("r.ruleId"))
    rule = F.when(F.size(by_id) > 0, by_id[0]).otherwise(F.get("rules", F.col("r.ruleIndex")))
    rows = rows.withColumn("rule", rule).withColumn("place", F.col("r.locations")[0]["physicalLocation"])
    score = F.expr("try_cast(rule.properties.`security-severity` as double)")
    out = rows.select(
        "file", "tool", "seq", F.coalesce("r.ruleId", "rule.id").alias("rule_id"), F.when(score.isNotNull(), severity_of_cvss(score)).otherwise(severity_of_level(F.col("r.level"))).alias("severity"),
        normal_path(F.col("place.artifactLocation.uri")).alias("path"), F.coalesce("place.region.startLine", F.lit(1)).alias("ln"), F.coalesce("place.region.startColumn", F.lit(1)).alias("col"),
        F.array_distinct(F.filter(F.transform(F.coalesce("rule.properties.tags", F.array().cast("array<string>")), lambda t: F.upper(F.regexp_extract(t, "(?i)(cwe-[0-9]+)", 1))), lambda t: t != "")).alias("cwe"),
        F.col("rule.helpUri").alias("help"),
    ).where("path is not null")
    return out.withColumn("fp", imported_fingerprint(F.col("tool"), F.col("rule_id"), F.col("path"), F.col("ln")))


def read_sarif_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with one log per line."""
    return read_sarif(spark, path, lines=True)


def import_reports(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings once per fingerprint, and the number per tool."""
    once = found.dropDuplicates(["fp"])
    return once, once.groupBy("tool").agg(F.count("*").alias("n"))


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold no report."""
    logs = spark.read.schema(SARIF + ", _corrupt_record string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("file", F.input_file_name())
    return logs.where(F.col("_corrupt_record").isNotNull() | F.col("runs").isNull()).select("file").distinct()


def read_lint(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Findings of linter JSON (file, messages), whole files or one file of the linter's a line; messages without a rule
    are dropped; severity 2 is an error."""
    rows = spark.read.schema("filePath string, messages array<struct<ruleId:string,severity:int,message:string,line:int,column:int>>").option("multiLine", str(not lines).lower()).json(path)
    m = rows.select(normal_path(F.col("filePath")).alias("path"), F.explode("messages").alias("m")).where("m.ruleId is not null")
    return m.select("path", F.col("m.ruleId").alias("rule_id"), severity_of_level(F.when(F.col("m.severity") == 2, "error").otherwise("warning")).alias("severity"), F.col("m.line").alias("ln"), F.col("m.column").alias("col"))


def _report_lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return raw.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("i", "txt"))


def read_lcov(spark: SparkSession, path: str) -> DataFrame:
    """(path, ln, hit) of LCOV files; a line hit once anywhere is hit."""
    w = W.partitionBy("file").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = _report_lines(spark, path).withColumn("path", F.last(F.when(F.col("txt").startswith("SF:"), F.substring("txt", F.lit(4), F.length("txt"))), ignorenulls=True).over(w))
    da = rows.where(F.col("txt").rlike("^DA:[0-9]+,[0-9]+"))
    return da.select(normal_path(F.col("path")).alias("path"), F.regexp_extract("txt", "^DA:([0-9]+),", 1).cast("int").alias("ln"), (F.regexp_extract("txt", "^DA:[0-9]+,([0-9]+)", 1).cast("long") > 0).alias("hit")).groupBy("path", "ln").agg(F.bool_or("hit").alias("hit"))


def _line_hits(lines: DataFrame) -> DataFrame:
    """(path, ln, hit) from (path, ln, hit) with repeats; a line hit once is hit."""
    return lines.where("ln is not null").groupBy(normal_path(F.col("path")).alias("path"), "ln").agg(F.bool_or("hit").alias("hit"))


def _cobertura(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "class").schema("_filename string, lines struct<line:array<struct<_number:int,_hits:long,`_condition-coverage`:string>>>").load(path)
    return rows.select(F.col("_filename").alias("path"), F.explode("lines.line").alias("l"))


def read_cobertura(spark: SparkSession, path: str) -> DataFrame:
    return _line_hits(_cobertura(spark, path).select("path", F.col("l._number").alias("ln"), (F.coalesce("l._hits", F.lit(0)) > 0).alias("hit")))


def _jacoco(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "package").schema("_name string, sourcefile array<struct<_name:string,line:array<struct<_nr:int,_mi:long,_ci:long,_mb:long,_cb:long>>>>").load(path)
    files = rows.select(F.translate("_name", ".", "/").alias("_name"), F.explode("sourcefile").alias("s"))
    return files.select(F.concat_ws("/", F.nullif("_name", F.lit("")), "s._name").alias("path"), F.explode("s.line").alias("l"))


def read_jacoco(spark: SparkSession, path: str) -> DataFrame:
    """Line hits of JaCoCo reports: a line with covered instructions is hit."""
    return _line_hits(_jacoco(spark, path).select("path", F.col("l._nr").alias("ln"), (F.coalesce("l._ci", F.lit(0)) > 0).alias("hit")))


def read_jcov(spark: SparkSession, path: str) -> DataFrame:
    """Line hits of JCov reports: the lines of each block, in a method or right in the class; a hit wins.

    The path is the class's source, else its name with slashes and the ending of a Java file.
    """
    block = "struct<_s:int,_e:int,_c:long>"
    methods = f"struct<bl:array<{block}>,block:array<{block}>>"
    rows = spark.read.format("xml").option("rowTag", "class").schema(f"_source string, _name string, bl array<{block}>, block array<{block}>, method array<{methods}>, meth array<{methods}>").load(path)
    file = F.coalesce(F.translate("_source", "\\", "/"), F.concat(F.translate("_name", ".", "/"), F.lit(".java")))
    none = F.array().cast(f"array<{block}>")
    inner = lambda c: F.flatten(F.transform(F.coalesce(F.col(c), F.array().cast(f"array<{methods}>")), lambda m: F.concat(F.coalesce(m["bl"], none), F.coalesce(m["block"], none))))
    blocks = rows.where(file.isNotNull()).select(file.alias("path"), F.explode(F.concat(F.coalesce("bl", none), F.coalesce("block", none), inner("method"), inner("meth"))).alias("b")).where("b._s is not null and coalesce(b._e, b._s) >= b._s")
    return _line_hits(blocks.select("path", F.explode(F.sequence("b._s", F.coalesce("b._e", "b._s"))).alias("ln"), (F.coalesce("b._c", F.lit(0)) > 0).alias("hit")))


def read_branches(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, covered, total) branches of each file of LCOV, Cobertura or JaCoCo reports that count any."""
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    if kind == "lcov":
        w = W.partitionBy("file").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
        rows = _report_lines(spark, path).withColumn("path", F.last(F.when(F.col("txt").startswith("SF:"), F.substring("txt", F.lit(4), F.length("txt"))), ignorenulls=True).over(w))
        of = lambda mark: F.when(F.col("txt").startswith(mark), number(F.substring("txt", F.lit(len(mark) + 1), F.length("txt")))).otherwise(0)
        rows = rows.where(F.col("txt").rlike("^BR[FH]:")).select("path", of("BRH:").alias("covered"), of("BRF:").alias("total"))
    elif kind == "cobertura":
        part = lambda i: number(F.regexp_extract("l.`_condition-coverage`", r"\(([0-9]+)/([0-9]+)\)", i))
        rows = _cobertura(spark, path).select("path", part(1).alias("covered"), part(2).alias("total"))
    elif kind == "jacoco":
        covered, missed = F.coalesce("l._cb", F.lit(0)), F.coalesce("l._mb", F.lit(0))
        rows = _jacoco(spark, path).select("path", covered.alias("covered"), (covered + missed).alias("total"))
    else:
        raise ValueError(f"no branches in {kind}")
    return rows.groupBy(normal_path(F.col("path")).alias("path")).agg(F.sum("covered").alias("covered"), F.sum("total").alias("total")).where("total > 0")


def read_go_cover(spark: SparkSession, path: str) -> DataFrame:
    """Line hits of Go cover profiles: blocks become lines, a hit wins."""
    p = r"^(.+):([0-9]+)\.[0-9]+,([0-9]+)\.[0-9]+ [0-9]+ ([0-9]+)$"
    rows = spark.read.text(path).where(F.col("value").rlike(p))
    g = lambda i: F.regexp_extract("value", p, i)
    return rows.select(g(1).alias("path"), F.explode(F.sequence(g(2).cast("int"), g(3).cast("int"))).alias("ln"), (g(4).cast("long") > 0).alias("hit")).groupBy("path", "ln").agg(F.bool_or("hit").alias("hit"))


def coverage_format(text: Column) -> Column:
    """Which coverage report the first 4096 characters show."""
    head = F.substring(text, 1, 4096)
    return (
        F.when(head.rlike("(?m)^mode: (set|count|atomic)"), "gocover")
        .when(head.rlike("(?m)^(TN:|SF:)"), "lcov")
        .when(head.contains("<report") & head.contains("jacoco"), "jacoco")
        .when(head.contains("<coverage"), "cobertura")
    )


def read_diff(spark: SparkSession, path: str, ranges: bool = False) -> DataFrame:
    """Changed lines of unified diffs (path, ln), or their hunks (path, start, end; an empty hunk counts one line)."""
    w = W.partitionBy("file").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = _report_lines(spark, path).withColumn("path", F.last(F.when(F.col("txt").startswith("+++ "), F.regexp_replace("txt", r"^\+\+\+ (b/)?", "")), ignorenulls=True).over(w))
    p = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"
    h = rows.where(F.col("txt").rlike(p)).select(normal_path(F.col("path")).alias("path"), F.regexp_extract("txt", p, 1).cast("int").alias("start"), F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(txt, r'{p}', 2), '') as int)"), F.lit(1)).alias("n"))
    h = h.where("path != '/dev/null'")
    if ranges:
        return h.select("path", "start", (F.col("start") + F.greatest("n", F.lit(1)) - 1).alias("end"))
    return h.where("n > 0").select("path", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("ln")).distinct()


def patch_cases(diffs: DataFrame, least: int = 20) -> DataFrame:
    """Before and after text of diffs (id, diff): removed and added lines joined, short ones dropped."""
    lines = F.split("diff", r"\r?\n")
    side = lambda sign: F.array_join(F.transform(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)), lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")
    both = F.explode(F.array(F.struct(F.lit("before").alias("side"), side("-").alias("text")), F.struct(F.lit("after").alias("side"), side("+").alias("text"))))
    return diffs.select("id", both.alias("x")).select("id", "x.*").where(F.length("text") >= least)


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Watch-list rows of an advisory feed, one per id, the newest (ties: the greatest row)."""
    rows = spark.read.schema("ghsa_id string, cve_id string, severity string, ecosystem string, summary string, cwes array<struct<cwe_id:string>>, published_at timestamp").json(path)
    row = F.struct(
        F.col("published_at").alias("published_at"), "cve_id", F.upper(F.coalesce(F.nullif("severity", F.lit("")), F.lit("unknown"))).alias("severity"), "ecosystem",
        F.substring(F.coalesce("summary", F.lit("")), 1, 300).alias("summary"), F.transform(F.coalesce("cwes", F.array().cast("array<struct<cwe_id:string>>")), lambda c: c["cwe_id"]).alias("cwe_ids"),
    )
    return rows.where("ghsa_id is not null").groupBy("ghsa_id").agg(F.max(row).alias("r")).select("ghsa_id", "r.*")


def upsert_advisories(watched: DataFrame, fetched: DataFrame, now: Column, keep_days: int = 90) -> DataFrame:
    """The watch list after a fetch: fetched rows replace those of their id, and rows published too long ago leave it."""
    kept = watched.join(fetched.select("ghsa_id"), "ghsa_id", "left_anti")
    return fetched.select(watched.columns).unionByName(kept).where(F.col("published_at") >= F.date_sub(now, keep_days).cast("timestamp"))


def all_findings(native: DataFrame, structural: DataFrame, metric: DataFrame, imported: DataFrame) -> DataFrame:
    """Findings of all origins with the columns a log needs; a metric finding says what was measured and the limit."""
    columns = ["path", "ln", "col", "rule_id", "severity", "snippet"]
    said = F.concat_ws(" ", "metric", F.round("measured", 2).cast("string"), F.lit(">"), F.round("limit", 2).cast("string"))
    measured = metric.select("path", F.col("ln").cast("int").alias("ln"), F.lit(1).alias("col"), F.concat(F.lit("METRIC-"), F.upper("metric")).alias("rule_id"), F.lit("MINOR").alias("severity"), said.alias("snippet"))
    parts = [df.select(*columns, F.lit(k).alias("origin")) for k, df in (("native", native), ("structural", structural), ("metric", measured), ("imported", imported))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Parts of a group by the path's hash, and most results of a log.
LOG_PARTS, MOST_RESULTS = 256, 5_000


def sarif_rows(found: DataFrame, by: list[str], tool: str, most: int = MOST_RESULTS) -> DataFrame:
    """SARIF logs of each group, with at most ``most`` results each: results in order, and one rule per distinct rule id.

    A group is dealt out by the path's hash, and each part is cut into logs by the place in it, so neither a task nor a
    log grows with the group. No result is left out.
    """
    result = F.struct(
        F.col("rule_id").alias("ruleId"), severity_level(F.col("severity")).alias("level"), F.struct(F.col("snippet").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("ln").alias("startLine"), F.col("col").alias("startColumn")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    w = W.partitionBy(*by, "_part").orderBy("path", "ln", "col", "rule_id")
    dealt = found.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(LOG_PARTS))).withColumn("_log", F.floor((F.row_number().over(w) - 1) / most))
    g = dealt.groupBy(*by, "_part", "_log").agg(F.array_sort(F.collect_list(F.struct("path", "ln", "col", "rule_id", result.alias("r")))).alias("rs"), F.array_sort(F.collect_set("rule_id")).alias("ids"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.transform("ids", lambda i: F.struct(i.alias("id"))).alias("rules")).alias("driver")).alias("tool"), F.transform("rs", lambda x: x["r"]).alias("results"))
    return g.select(*by, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value"))


def work_list(found: DataFrame) -> DataFrame:
    """Markdown lines of a work list with the keys of their order."""
    return found.select("path", "ln", "rule_id", "severity", F.format_string("- [ ] **%s** `%s` %s:%d", "severity", "rule_id", "path", F.col("ln").cast("int")).alias("value"))


def archive(rows: DataFrame, path: str, time: str = "ts") -> None:
    """Appends rows under their day."""
    rows.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def front_matter_checks(docs: DataFrame) -> DataFrame:
    """(path, check) of the structure checks that a document's front matter fails."""
    block = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    pairs = F.transform(F.filter(F.split(block, r"\r?\n"), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    value = lambda k: F.get(F.filter("fm", lambda p: p["k"] == k), F.lit(0))["v"]
    d = docs.withColumn("block", block).withColumn("fm", pairs).withColumn("name", value("name")).withColumn("description", value("description")).withColumn("body", F.regexp_replace("text", r"(?s)\A---\r?\n.*?\r?\n---", ""))
    checks = F.array(
        F.when(F.col("block") == "", "front-matter-missing"),
        F.when(F.coalesce("name", F.lit("")) == "", "name-missing"),
        F.when(F.length("name") > 64, "name-too-long"),
        F.when((F.col("name") != "") & ~F.col("name").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "name-invalid"),
        F.when(F.coalesce("description", F.lit("")) == "", "description-missing"),
        F.when(F.length("description") > 1024, "description-too-long"),
        F.when((F.col("description") != "") & (F.length("description") < 20), "description-too-short"),
        F.when(F.col("description").rlike("[<>]"), "description-has-markup"),
        F.when(F.trim("body") == "", "body-empty"),
        F.when(F.size(F.split("body", "\n")) > 500, "body-too-long"),
        F.when(~F.col("body").rlike("(?m)^#+ "), "no-heading"),
        F.when(F.size(F.array_distinct(F.transform("fm", lambda p: p["k"]))) < F.size("fm"), "repeated-key"),
    )
    return d.select("path", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("check"))
