"""Tables derived from the given ones, in Spark and as SQL fragments: files, lines, findings, units, analyses, calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import lines
from siltstone.operators.matching import PACK, findings
from siltstone.plans.registry import Tables


def files(t: Tables) -> DataFrame:
    """documents as source files."""
    return t.documents.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "lang", "source", "n_chars", F.coalesce("text", F.lit("")).alias("text"))


def found(t: Tables) -> DataFrame:
    """Findings of the built-in packs, with an id for each (file, line, rule)."""
    out = findings(files(t), PACK)
    return out.withColumn("fid", F.concat_ws("#", "path", F.col("ln").cast("string"), "rule_id"))


def units(t: Tables) -> DataFrame:
    """Runs of non-empty lines of a document, and the whole document, as nested function units."""
    rows = lines(files(t)).withColumn("full", F.length(F.trim("txt")) > 0)
    w = W.partitionBy("path").orderBy("ln")
    runs = rows.withColumn("grp", F.col("ln") - F.sum(F.col("full").cast("int")).over(w)).where("full")
    runs = runs.groupBy("path", "grp").agg(F.min("ln").alias("start"), F.max("ln").alias("end")).select("path", "start", "end")
    whole = rows.groupBy("path").agg(F.max("ln").alias("end")).select("path", F.lit(0).alias("start"), (F.col("end") + 1).alias("end"))
    return runs.unionByName(whole).withColumn("unit", F.concat_ws("@", "path", F.col("start").cast("string"))).withColumn("cyclomatic", 1 + (F.col("end") - F.col("start")) % 7)


def analyses(t: Tables) -> DataFrame:
    """events as analyses of repositories (the users)."""
    return t.events.select(
        "event_id", F.col("user_id").alias("repo"), "ts", "event_type", (F.col("event_type") != "error").alias("passed"), F.least(F.lit(100.0), "value").alias("coverage"),
        (100 + F.col("event_id") % 900).alias("loc"), (F.col("event_id") % 13).alias("issues"),
    )


def calls(t: Tables) -> DataFrame:
    """A cyclic call graph from all orders; customers are the nodes."""
    n = t.customer.select(F.count("*").alias("n"))
    e = t.orders.crossJoin(F.broadcast(n)).select(F.col("o_custkey").cast("long").alias("src"), ((7 * F.col("o_custkey") + 13 * F.col("o_orderkey")) % F.col("n")).cast("long").alias("dst"))
    return e.where("src != dst")


def _values() -> str:
    text = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    array = lambda a: "[" + ", ".join(map(text, a)) + "]::VARCHAR[]"
    return ", ".join(f"({text(r[0])}, {text(r[1])}, {text(r[2])}, {text(r[3])}, {text(r[4])}, {r[5]}, {text(r[6])}, {array(r[7])}, {array(r[8])}, {i})" for i, r in enumerate(PACK))


FILE = "file AS (SELECT doc_id, source || '/' || doc_id AS path, lang, source, n_chars, coalesce(text, '') AS text FROM documents)"
LINE = FILE + r", line AS (SELECT doc_id, path, lang, source, n_chars, unnest(p) AS txt, unnest(range(1, len(p) + 1)) AS ln FROM (SELECT *, string_split_regex(text, '\r?\n') AS p FROM file))"
RULE = f"rule AS (SELECT * FROM (VALUES {_values()}) r(rule_id, regex, unless, severity, type, effort, pack, languages, cwe, seq))"
FINDING = (
    LINE
    + ", "
    + RULE
    + """, hit AS (SELECT *, strpos(txt, regexp_extract(txt, regex)) AS col, length(regexp_extract(txt, regex)) AS len
  FROM line JOIN rule ON regex <> '' AND (list_contains(languages, 'any') OR list_contains(languages, lang)) AND regexp_matches(txt, regex)
  WHERE length(txt) <= 8000 AND (unless IS NULL OR NOT regexp_matches(txt, unless)))
, numbered AS (SELECT *, row_number() OVER (PARTITION BY path, rule_id ORDER BY ln) AS nth FROM hit)
, finding AS (SELECT *, col + len AS end_col, trim(txt) AS snippet, path || '#' || ln || '#' || rule_id AS fid,
  substring(sha256(rule_id || '::' || path || '::' || lower(regexp_replace(regexp_replace(regexp_replace(txt, '"[^"]*"|''[^'']*''', 'S', 'g'), '[0-9]+', 'N', 'g'), '[ \\t\\r\\n\\f]+', '', 'g'))), 1, 16) AS fp
  FROM numbered WHERE nth <= 500)""".replace("\\\\", "\\")
)
UNIT = (
    LINE
    + """, marked AS (SELECT *, length(trim(txt)) > 0 AS is_full FROM line), runs AS (SELECT *, ln - sum(CASE WHEN is_full THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ln) AS grp FROM marked),
unit0 AS (SELECT path, min(ln) AS s, max(ln) AS e FROM runs WHERE is_full GROUP BY path, grp UNION ALL SELECT path, 0 AS s, max(ln) + 1 AS e FROM line GROUP BY path),
unit AS (SELECT path, s, e, path || '@' || s AS unit, 1 + (e - s) % 7 AS cyclomatic FROM unit0)"""
)
ANALYSIS = "analysis AS (SELECT event_id, user_id AS repo, ts, event_type, event_type <> 'error' AS passed, least(100.0, value) AS coverage, 100 + event_id % 900 AS loc, event_id % 13 AS issues FROM events)"
CALL = "call AS (SELECT * FROM (SELECT o_custkey::BIGINT AS src, ((7 * o_custkey + 13 * o_orderkey) % (SELECT count(*) FROM customer))::BIGINT AS dst FROM orders) WHERE src <> dst)"
RANK = "CASE severity WHEN 'BLOCKER' THEN 5 WHEN 'CRITICAL' THEN 4 WHEN 'MAJOR' THEN 3 WHEN 'MINOR' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END"
