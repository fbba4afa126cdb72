"""Text metrics per file and unit: tokens, nesting, clones, budgets, tables of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that stand for branches in a text, and characters for operators.
BRANCH_WORDS = ("if", "for", "while", "case", "and", "or", "und", "oder", "que", "ou")
OPERATORS = r"[-+*/=<>!&|%^~?:;,.(){}\[\]]"


def tokens(files: DataFrame) -> DataFrame:
    """(path, lang, kind, token): operators are single signs, operands are words."""
    found = files.select("path", "lang", F.explode(F.regexp_extract_all("text", F.lit(OPERATORS + r"|[^-+*/=<>!&|%^~?:;,.(){}\[\] \t\r\n\f\x0B]+"), F.lit(0))).alias("token"))
    return found.withColumn("kind", F.when(F.col("token").rlike(f"^{OPERATORS}$"), "operator").otherwise("operand"))


def halstead(files: DataFrame) -> DataFrame:
    """Distinct and total operators and operands, and the volume N log2 n. Tokens are counted before they meet."""
    counted = tokens(files).groupBy("path", "kind", "token").agg(F.count("*").alias("n"))
    kind = lambda k: F.col("kind") == k
    g = counted.groupBy("path").agg(
        F.count_if(kind("operator")).alias("operators"), F.coalesce(F.sum(F.when(kind("operator"), F.col("n"))), F.lit(0)).alias("all_operators"),
        F.count_if(kind("operand")).alias("operands"), F.coalesce(F.sum(F.when(kind("operand"), F.col("n"))), F.lit(0)).alias("all_operands"),
    )
    size, words = F.col("all_operators") + F.col("all_operands"), F.col("operators") + F.col("operands")
    return g.withColumn("volume", F.round(size * F.log2(F.greatest(words, F.lit(2)).cast("double")), 4))


def branch_counts(rows: DataFrame) -> DataFrame:
    """Per path: branch words, and the same weighted by the bracket depth at the start of their line."""
    words = F.regexp_count(F.concat(F.lit(" "), F.lower("txt"), F.lit(" ")), F.lit(r"[^a-z](?=(?:" + "|".join(BRANCH_WORDS) + r")[^a-z])"))
    step = F.regexp_count("txt", F.lit(r"[(\[{]")) - F.regexp_count("txt", F.lit(r"[)\]}]"))
    w = W.partitionBy("path").orderBy("ln").rowsBetween(W.unboundedPreceding, -1)
    d = rows.select("path", "ln", words.alias("words"), step.alias("step")).withColumn("depth", F.greatest(F.lit(0), F.coalesce(F.sum("step").over(w), F.lit(0))))
    return d.groupBy("path").agg((1 + F.sum("words")).alias("cyclomatic"), F.sum(F.col("words") * (1 + F.col("depth"))).alias("cognitive"), F.max("depth").alias("nesting"))


def over_threshold(metrics: DataFrame, limits: dict[str, float], key: str) -> DataFrame:
    """(key, metric, measured, limit) where a metric is above its limit."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("measured"), F.lit(float(v)).alias("limit")) for m, v in limits.items())))
    return metrics.select(key, pairs.alias("x")).select(key, "x.*").where("measured > limit")


def line_windows(rows: DataFrame, k: int) -> DataFrame:
    """Hash of every k consecutive lines of a file, blank lines and inner white space left out."""
    clean = rows.withColumn("norm", F.lower(F.regexp_replace("txt", r"[ \t\r\n\f]+", ""))).where("norm != ''")
    w = W.partitionBy("path").orderBy("ln").rowsBetween(0, k - 1)
    d = clean.select("path", "ln", F.collect_list("norm").over(w).alias("part"), F.last("ln").over(w).alias("last"))
    return d.where(F.size("part") == k).select("path", F.col("ln").alias("start"), F.col("last").alias("end"), F.sha1(F.concat_ws("\n", "part")).alias("hash"))


def clone_blocks(rows: DataFrame, k: int) -> DataFrame:
    """Windows that are found twice or more; the count meets in one row per hash, so no window is paired with another."""
    windows = line_windows(rows, k)
    many = windows.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1")
    return windows.join(many, "hash")


def duplicated_lines(blocks: DataFrame) -> DataFrame:
    """Distinct lines inside blocks per path, by merging overlapping spans."""
    w = W.partitionBy("path").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    d = blocks.select("path", "start", "end").distinct().withColumn("to", F.coalesce(F.max("end").over(w), F.lit(0)))
    return d.groupBy("path").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("to"), F.col("start") - 1))).alias("lines"))


def contained_groups(blocks: DataFrame) -> DataFrame:
    """Groups of which every block lies strictly inside a block of another group, dropped: (group, path, start, end)."""
    outer = blocks.select(F.col("group").alias("_g"), F.col("path").alias("_p"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    inside = (F.col("path") == F.col("_p")) & (F.col("group") != F.col("_g")) & (F.col("_s") <= F.col("start")) & (F.col("_e") >= F.col("end")) & (F.col("_e") - F.col("_s") > F.col("end") - F.col("start"))
    loose = blocks.join(outer, inside, "left_anti").select("group").distinct()
    return blocks.join(loose, "group", "left_semi")


def read_budget(candidates: DataFrame, cost: str, budget: int, most: int, by: list[str]) -> DataFrame:
    """Cheapest first while the running cost stays within the budget and the number within ``most``.

    No more than the ``most`` cheapest of a group can stay, and every task keeps only those before anything is shuffled.
    """
    w = W.partitionBy(*by).orderBy(cost, "unit")
    few = candidates.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return few.withColumn("running", F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("running") <= budget)


def identifier_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), F.lower)))
