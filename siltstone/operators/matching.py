"""Rules over lines: the regex theta join, its deduplications, cross-tool echoes, and reports on findings.

A rule pack that is at hand as data is compiled into the query: each pattern is a literal, so it is compiled once for a
task, and a line gives the rows of the rules that match it, without a join. A rule table of any size is joined instead:
it is broadcast up to ``MOST_RULES`` rows, and a larger one is joined as Spark sees fit, with every rule. Where every match
of a pattern holds some fixed text, a line is looked through for that first. Matches, not lines, are shuffled to limit
what a rule reports of a file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.severity import severity_rank
from siltstone.functions.text import fingerprint, lines, normal_snippet

LONGEST_LINE, MOST_MATCHES, MOST_RULES = 8_000, 500, 20_000
#: Rules that are compiled into one query at most; a larger pack goes through the join.
MOST_COMPILED = 64
RULE_SCHEMA = "rule_id string, regex string, unless string, severity string, type string, effort int, pack string, languages array<string>, cwe array<string>, seq int"

#: The built-in packs, in the regex subset that Java and RE2 share.
PACK = (
    ("PII-EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", r"noreply@", "MAJOR", "VULNERABILITY", 15, "privacy", ("any",), ("CWE-359",)),
    ("PII-IP", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", None, "MINOR", "SECURITY_HOTSPOT", 10, "privacy", ("any",), ("CWE-359", "CWE-200")),
    ("SEC-ASSIGN", r"(password|token|secret|api_key)[ ]?=", None, "BLOCKER", "VULNERABILITY", 30, "secrets", ("any",), ("CWE-798",)),
    ("SEC-ASSIGN-2", r"(password|token|secret|api_key)[ ]?=", None, "CRITICAL", "VULNERABILITY", 25, "secrets", ("any",), ("CWE-798",)),
    ("NUM-LONG", r"[0-9]{12,}", None, "CRITICAL", "BUG", 20, "privacy", ("en", "de"), ("CWE-359",)),
    ("LIC-LINE", r"([Ll]icen[sc]ed?|[Cc]opyright)", None, "INFO", "CODE_SMELL", 5, "license", ("any",), ()),
    ("STYLE-PUNCT", r"[!?#*%$&]{2,}", None, "MINOR", "CODE_SMELL", 2, "style", ("any",), ()),
    ("STYLE-CAPS", r"[A-Z]{6,}", None, "INFO", "CODE_SMELL", 1, "style", ("en",), ()),
    ("TOX-WORD", r"(idiot|stupid|moron|loser)", None, "MAJOR", "BUG", 8, "agents", ("any",), ("CWE-20",)),
    ("STUB", "", None, "INFO", "CODE_SMELL", 0, "style", ("any",), ()),
)


def rule_table(spark: SparkSession, rules=PACK) -> DataFrame:
    return spark.createDataFrame([(*r[:6], r[6], list(r[7]), list(r[8]), i) for i, r in enumerate(rules)], RULE_SCHEMA)


def unsafe_regex(regex: Column) -> Column:
    """Patterns that may backtrack without end: very long ones, or a quantified group with a quantifier inside."""
    return (F.length(regex) > 300) | regex.rlike(r"\([^()]*[+*][^()]*\)[+*]") | regex.rlike(r"\([^()]*\{[0-9]+,[0-9]*\}[^()]*\)[+*]")


def required_literal(regex: str) -> str:
    """The longest text that every match of a pattern holds, as far as its outermost sequence tells; '' if none is sure.

    A line without it can't match, and looking for a fixed text is many times cheaper than trying the pattern at every
    place of the line.
    """
    try:
        parsed = re._parser.parse(regex)
    except (re.error, RecursionError, OverflowError):
        return ""
    if parsed.state.flags & re.IGNORECASE:
        return ""
    best = run = ""

    def walk(items) -> None:
        nonlocal best, run
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(value)
            elif name == "IN" and len(value) == 1 and str(value[0][0]) == "LITERAL":
                run += chr(value[0][1])
            elif name == "SUBPATTERN" and not value[1] & re.IGNORECASE:
                walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                run = ""  # how often it comes isn't sure, that it comes is
                walk(value[2])
                best, run = max(best, run, key=len), ""
            elif name != "AT":
                run = ""
            best = max(best, run, key=len)

    walk(parsed)
    return best


def _compiled(rows: DataFrame, rules) -> DataFrame:
    """Each line with its matches by the rules of a pack; one literal pattern each."""
    text, lang = F.col("txt"), F.col("lang")

    def hit(i: int, rule) -> Column:
        _, regex, unless, *_, languages, _ = rule
        literal = required_literal(regex)
        holds = text.contains(literal) & text.rlike(regex) if literal else text.rlike(regex)
        if unless is not None:
            holds = holds & ~text.rlike(unless)
        if "any" not in languages:
            holds = lang.isin(*languages) & holds
        return F.when(holds, F.struct(F.lit(i).alias("seq"), F.regexp_instr(text, F.lit(regex)).alias("col"), F.length(F.regexp_extract(text, regex, 0)).alias("len")))

    some = F.array(*(hit(i, r) for i, r in enumerate(rules) if r[1]))
    out = rows.withColumn("_hit", F.explode(some)).where("_hit is not null")
    return out.select("*", "_hit.seq", "_hit.col", (F.col("_hit.col") + F.col("_hit.len")).alias("end_col")).drop("_hit").join(F.broadcast(rule_table(rows.sparkSession, rules)), "seq")


def _joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by a rule table."""
    rules = rules.where("regex != ''")
    few = rules.limit(MOST_RULES + 1).count() <= MOST_RULES
    matched = rows.join(F.broadcast(rules) if few else rules, F.expr("(array_contains(languages, 'any') OR array_contains(languages, lang)) AND txt RLIKE regex"))
    matched = matched.where("unless IS NULL OR NOT txt RLIKE unless")
    return matched.withColumn("col", F.expr("regexp_instr(txt, regex)")).withColumn("end_col", F.col("col") + F.length(F.expr("regexp_extract(txt, regex, 0)")))


def findings(files: DataFrame, rules) -> DataFrame:
    """First match of every rule on every line of files (path, lang, text and more).

    ``rules`` is a pack (tuples like those of PACK) or a table of RULE_SCHEMA. Rules without a regex are stubs. Lines over
    LONGEST_LINE are skipped, ``unless`` is tested on the same line, and a rule reports at most MOST_MATCHES lines of a
    file. Columns are code points, from 1.
    """
    if not isinstance(rules, DataFrame) and len(rules) > MOST_COMPILED:
        rules = rule_table(files.sparkSession, rules)
    match = _joined if isinstance(rules, DataFrame) else _compiled
    # Files are read and split once. Only matches are shuffled, and of a file and rule no task sends more than the limit.
    hits = match(lines(files).where(F.length("txt") <= LONGEST_LINE), rules)
    nth = F.row_number().over(W.partitionBy("path", "rule_id").orderBy("ln"))
    out = hits.withColumn("_nth", nth).where(F.col("_nth") <= MOST_MATCHES).drop("_nth").withColumn("snippet", F.trim("txt"))
    return out.withColumn("fp", fingerprint(F.col("rule_id"), F.col("path"), normal_snippet(F.col("txt"))))


def best_engine(found: DataFrame) -> DataFrame:
    """One finding per file, rule and line: taint over ast over pattern, then the first."""
    rank = F.when(F.col("engine") == "taint", 3).when(F.col("engine") == "ast", 2).otherwise(1)
    w = W.partitionBy("path", "rule_id", "ln").orderBy(rank.desc(), "seq")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def collapse(found: DataFrame, by: list[str]) -> DataFrame:
    """One finding per group: the most severe, then the least rule id; the others' ids are kept in ``absorbed``."""
    w = W.partitionBy(*by).orderBy(severity_rank(F.col("severity")).desc(), "rule_id")
    ids = F.collect_list(F.struct("rule_id", "absorbed")).over(W.partitionBy(*by))
    out = found.withColumn("_n", F.row_number().over(w)).withColumn("_ids", ids).where("_n = 1")
    every = F.array_distinct(F.flatten(F.transform("_ids", lambda x: F.concat(F.array(x["rule_id"]), x["absorbed"]))))
    return out.withColumn("absorbed", F.array_sort(F.filter(every, lambda x: x != F.col("rule_id")))).drop("_n", "_ids")


def collapse_same_detector(found: DataFrame) -> DataFrame:
    """First findings of one regex at one place, then those of one type there."""
    start = found.withColumn("absorbed", F.array().cast("array<string>"))
    return collapse(collapse(start, ["path", "ln", "col", "engine", "regex"]), ["path", "ln", "col", "engine", "type"])


def absorb_echoes(native: DataFrame, imported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imported findings on a native one's line become its echoes: (native with ``also``, imported that remain).

    The nearest native column takes the echo, the first on ties; findings about dependencies stay.
    """
    pairs = imported.where(~F.col("is_dependency")).alias("i").join(native.alias("n"), ["path", "ln"]).select("path", "ln", F.col("i.imp_id"), F.col("i.rule_id").alias("echo"), F.col("n.nat_id"), F.abs(F.col("i.col") - F.col("n.col")).alias("d"))
    w = W.partitionBy("imp_id").orderBy("d", "nat_id")
    taken = pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    also = taken.groupBy("nat_id").agg(F.array_sort(F.collect_set("echo")).alias("also"))
    kept = native.join(also, "nat_id", "left").withColumn("also", F.coalesce("also", F.array().cast("array<string>")))
    return kept, imported.join(taken.select("imp_id"), "imp_id", "left_anti")


def neighbour_agreement(found: DataFrame, id_col: str = "fid") -> DataFrame:
    """Findings of other rules within one line that share, or do not share, a weakness."""
    keyed = found.select("path", F.explode(F.array(F.col("ln") - 1, F.col("ln"), F.col("ln") + 1)).alias("ln"), F.col("rule_id").alias("r2"), F.col("cwe").alias("c2"))
    pairs = found.join(keyed, ["path", "ln"]).where(F.col("rule_id") != F.col("r2"))
    shares = F.arrays_overlap("cwe", "c2")
    return pairs.groupBy(id_col).agg(F.count_if(shares).alias("sharing"), F.count_if(~shares).alias("differing"))


def noise_by_source(found: DataFrame, files: DataFrame) -> DataFrame:
    """Findings per 1000 lines of each source, and the share of severe ones."""
    loc = files.groupBy("source").agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1))).alias("loc"))
    n = found.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("BLOCKER", "CRITICAL")).alias("severe"))
    out = loc.join(n, "source", "left").na.fill(0, ["n", "severe"])
    return out.withColumn("per_kloc", F.round(1000 * F.col("n") / F.col("loc"), 3)).withColumn("severe_share", F.when(F.col("n") > 0, F.round(F.col("severe") / F.col("n"), 4)).otherwise(0.0))


def suspicious_rules(found: DataFrame, files: DataFrame) -> DataFrame:
    """Rules that hit many files of a language: five at least, and over a quarter (severe: a twentieth) of its files."""
    totals = files.groupBy("lang").agg(F.count("*").alias("files"))
    hit = found.groupBy("rule_id", "lang").agg(F.countDistinct("path").alias("hit"), F.max("severity").alias("severity"))
    limit = F.when(F.col("severity").isin("BLOCKER", "CRITICAL"), 0.05).otherwise(0.25)
    return hit.join(F.broadcast(totals), "lang").where((F.col("files") >= 10) & (F.col("hit") >= 5) & (F.col("hit") > limit * F.col("files"))).select("rule_id", "lang", "hit", "files")


def volume_explosions(found: DataFrame, budget: DataFrame) -> DataFrame:
    """Rules whose count outgrew their budget (rule_id, budget)."""
    now = found.groupBy("rule_id").agg(F.count("*").alias("n"))
    return now.join(budget, "rule_id", "left").na.fill(0, ["budget"]).where(((F.col("n") >= 5) & (F.col("n") > 3 * F.col("budget"))) | ((F.col("n") >= F.col("budget") + 25) & (F.col("n") >= 1.25 * F.col("budget"))))


def recommendation_groups(found: DataFrame, most: int = 25) -> DataFrame:
    """Per rule: severity, count and the first places; the list is bounded by ``most`` before it is gathered."""
    w = W.partitionBy("rule_id").orderBy("path", "ln")
    first = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    places = first.groupBy("rule_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat_ws(":", "path", "ln").alias("at")))), lambda x: x["at"]), ",").alias("places"))
    return found.groupBy("rule_id").agg(F.first("severity").alias("severity"), F.count("*").alias("n")).join(places, "rule_id")


def detector_lint(regex: Column) -> Column:
    """Risk weight of a pattern read on its own: short alternatives without a boundary, no anchor, greedy gaps, little text."""
    plain = F.length(F.regexp_replace(regex, r"\\[a-zA-Z]|[\[\](){}|^$.*+?\\]", ""))
    bounded = regex.contains("\\b") | regex.rlike(r"\(\^\||\|\$\)")
    short = regex.rlike(r"(^|[(|])[A-Za-z]{1,4}([)|]|$)") & ~bounded
    return (
        F.when(short, 3).otherwise(0)
        + F.when(~regex.rlike(r"^\^|\$$") & ~bounded, 1).otherwise(0)
        + F.when(regex.rlike(r"\.\*[^?]|\.\*$"), 2).otherwise(0)
        + F.when(plain <= 6, 2).otherwise(0)
    )
