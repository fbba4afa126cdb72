"""Rules from mined cases: identifiers and pairs of them that stand in what was mended and not in the mended form.

Tokens are mined first, and only tokens that pass are joined into pairs (a pair can't be more frequent than its tokens),
so no case is ever joined with itself over all of its tokens. Every count is a plain aggregate by family, so a family
with most of the cases is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: what an identifier of a case is; identifiers are told apart in lower case.
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]{2,}"
#: Pairs of a family that are tried, precision that a rule needs, and cases that a family needs.
MOST_PAIRS, LEAST_PRECISION, LEAST_CASES = 40, 0.85, 4
#: Exclusive tokens of a family that are paired at most, the most frequent ones; single tokens are all tried.
PAIRED = 40


def identifiers(cases: DataFrame) -> DataFrame:
    """(family, case_id, bad, token): the distinct identifiers of each case."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("code", F.lit("")), F.lit(IDENTIFIER), F.lit(0)), F.lower))
    return cases.select("family", "case_id", "bad", F.explode(found).alias("token"))


def exclusive_tokens(tokens: DataFrame, sizes: DataFrame, support: float) -> DataFrame:
    """(family, token, tp, place): tokens of at least a share of the bad cases and of no good one; place by frequency."""
    n = tokens.groupBy("family", "token").agg(F.count_if("bad").alias("tp"), F.count_if(~F.col("bad")).alias("fp")).where("fp = 0 AND tp > 0")
    some = n.join(F.broadcast(sizes), "family").where(F.col("tp") >= support * F.col("n_bad"))
    place = F.row_number().over(W.partitionBy("family").orderBy(F.desc("tp"), "token"))
    return some.select("family", "token", "tp").withColumn("place", place)


def frequent_pairs(tokens: DataFrame, passed: DataFrame, sizes: DataFrame, support: float) -> DataFrame:
    """(family, a, b, together): pairs of tokens that passed and stand together in a share of the bad cases.

    A case holds at most PAIRED such tokens, so its pairs are bounded; of a family the MOST_PAIRS most frequent stay.
    """
    few = passed.where(F.col("place") <= PAIRED).select("family", "token", "place")
    held = tokens.where("bad").join(F.broadcast(few), ["family", "token"]).groupBy("family", "case_id").agg(F.array_sort(F.collect_set(F.struct("place", "token"))).alias("held"))
    later = F.transform("held", lambda x, i: F.transform(F.slice("held", i + 2, PAIRED), lambda y: F.struct(x["token"].alias("a"), y["token"].alias("b"), x["place"].alias("pa"), y["place"].alias("pb"))))
    pairs = held.select("family", F.explode(F.flatten(later)).alias("p")).groupBy("family", "p.a", "p.b", "p.pa", "p.pb").agg(F.count(F.lit(1)).alias("together"))
    pairs = pairs.join(F.broadcast(sizes), "family").where(F.col("together") >= support * F.col("n_bad"))
    best = F.row_number().over(W.partitionBy("family").orderBy(F.desc("together"), "pa", "pb"))
    return pairs.withColumn("_n", best).where(F.col("_n") <= MOST_PAIRS).select("family", "a", "b", "together")


#: Fixed value: what can't stand beside an identifier, in its line.
BESIDE = r"[^A-Za-z0-9_$\n]"


def pattern(first: Column, second: Column | None = None) -> Column:
    """The rule of one identifier, or of two in one line in that order; letters of any case."""
    plain = lambda t: F.replace(t, F.lit("$"), F.lit(r"\$"))
    rest = [] if second is None else [F.lit(rf"{BESIDE}([^\n]*{BESIDE})?"), plain(second)]
    return F.concat(F.lit(r"(?i)(^|\n|" + BESIDE + ")"), plain(first), *rest, F.lit(r"($|\n|" + BESIDE + ")"))


def synthesize(cases: DataFrame, support: float = 1.0) -> DataFrame:
    """The candidate rules of cases (family, case_id, code, bad), judged on all cases of their family.

    (family, a, b, regex, tp, fp, fn, precision, recall, f1, nth); b is null for single tokens. ``support`` is the share
    of bad cases that must hold a token or pair; 1 asks for all of them. Only rules that are precise enough are kept, and
    nth = 1 is the best: by f1, then precision, then single tokens, then the tokens. Families with fewer than LEAST_CASES
    cases, or without bad ones, have no rules; null codes are empty.
    """
    sizes = cases.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad")).where((F.col("n") >= LEAST_CASES) & (F.col("n_bad") > 0))
    tokens = identifiers(cases)
    passed = exclusive_tokens(tokens, sizes, support)
    one = passed.select("family", F.col("token").alias("a"), F.lit(None).cast("string").alias("b"), pattern(F.col("token")).alias("regex"))
    two = frequent_pairs(tokens, passed, sizes, support)
    every = one.unionByName(two.select("family", "a", "b", pattern(F.col("a"), F.col("b")).alias("regex")))
    # Rules are judged as they will be used, as patterns over all cases of the family.
    hit = cases.join(F.broadcast(every), "family").where(F.rlike(F.coalesce("code", F.lit("")), F.col("regex")))
    n = hit.groupBy("family", "a", "b", "regex").agg(F.count_if("bad").alias("tp"), F.count_if(~F.col("bad")).alias("fp"))
    n = n.join(F.broadcast(sizes), "family").withColumn("fn", F.col("n_bad") - F.col("tp"))
    judged = n.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("recall", F.col("tp") / F.col("n_bad"))
    judged = judged.where((F.col("precision") >= LEAST_PRECISION) & (F.col("tp") > 0)).withColumn("f1", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))
    nth = F.row_number().over(W.partitionBy("family").orderBy(F.desc("f1"), F.desc("precision"), F.col("b").isNotNull(), "a", "b"))
    return judged.withColumn("nth", nth).select("family", "a", "b", "regex", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "f1", "nth")
