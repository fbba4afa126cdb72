"""Which rule of one catalogue means what a rule of another means: the best match of each side.

A pair scores by common weaknesses (CWE), by tokens that both texts have, by phrases that stand for a weakness, and by
whether their types fit. Only pairs that share something are scored. Tokens that many rules have are not an entrance at
first: a pair that shares nothing else can have no more hits than the rule has such tokens, and only rules whose best
match so far does not beat that bound are matched by them as well. So the result is that of all pairs, ties included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.graph import cut

#: Least length of a token that counts, of one that counts as a strong hit, and what a phrase adds.
LEAST_TOKEN, LONG_TOKEN, PHRASE_HITS = 3, 6, 2
#: Rules of a side that may share a token for it to be an entrance from the start.
MOST_SHARING = 200


def compatible(left: Column, right: Column) -> Column:
    """Whether a finding of one type may stand for a rule of the other; an unknown right type fits all."""
    near = ((left == "VULNERABILITY") & (right == "SECURITY_HOTSPOT")) | ((left == "CODE_SMELL") & (right == "BUG")) | ((left == "BUG") & (right == "CODE_SMELL"))
    return right.isNull() | (left == right) | near


def level(cwe_hit: Column, hits: Column, multi: Column, fits: Column) -> Column:
    """2 for a strong match, 1 for a partial one, else null."""
    return F.when(cwe_hit & fits, 2).when(cwe_hit, 1).when((multi >= 2) & fits, 2).when((hits >= 3) & fits, 1).when((multi >= 1) & (hits >= 2), 1)


def _scored(pairs: DataFrame, left: DataFrame, right: DataFrame, said: DataFrame) -> DataFrame:
    """Pairs (l, r) with level and hits, those without a level left out."""
    a = left.select(F.col("id").alias("l"), F.col("type").alias("_lt"), F.col("languages").alias("_langs"), F.col("cwe").alias("_lc"), F.col("tokens").alias("_l"))
    b = right.select(F.col("id").alias("r"), F.col("type").alias("_rt"), F.col("lang").alias("_lang"), F.col("cwe").alias("_rc"), F.col("tokens").alias("_r"))
    j = pairs.join(a, "l").join(b, "r").where(F.array_contains("_langs", "any") | F.coalesce(F.array_contains("_langs", F.col("_lang")), F.lit(False)))
    phrases = j.select("l", "r", F.explode("_lc").alias("cwe")).join(said, ["r", "cwe"]).groupBy("l", "r").agg(F.sum("phrases").alias("_p"))
    j = j.join(phrases, ["l", "r"], "left").withColumn("_p", PHRASE_HITS * F.coalesce("_p", F.lit(0)))
    both = F.array_intersect("_l", "_r")
    j = j.withColumn("hits", F.size(both) + F.col("_p")).withColumn("multi", F.size(F.filter(both, lambda t: F.length(t) >= LONG_TOKEN)) + F.col("_p"))
    rank = level(F.arrays_overlap("_lc", "_rc"), F.col("hits"), F.col("multi"), compatible(F.col("_lt"), F.col("_rt")))
    return j.select("l", "r", rank.alias("level"), F.col("hits").cast("long").alias("hits")).where("level is not null")


def _prepared(rules: DataFrame) -> DataFrame:
    some = F.array_distinct(F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: (F.length(t) >= LEAST_TOKEN) | t.rlike("^[0-9]+$")))
    return rules.withColumn("tokens", some).withColumn("cwe", F.coalesce("cwe", F.array().cast("array<string>")))


def matches(left: DataFrame, right: DataFrame, phrases: DataFrame) -> DataFrame:
    """All scored pairs that can be the best of either side: (l, r, level, hits).

    ``left`` is (id, type, languages, cwe, tokens), ``right`` (id, type, lang, cwe, tokens, text), ``phrases`` (cwe, phrase)
    in lower case, a parameter of some hundred rows. Null arrays are empty. Languages ``any`` fit every language.
    """
    left, right = cut(_prepared(left)), cut(_prepared(right))
    said = cut(right.select(F.col("id").alias("r"), F.lower("text").alias("_t")).join(F.broadcast(phrases), F.col("_t").contains(F.col("phrase"))).groupBy("r", "cwe").agg(F.count(F.lit(1)).alias("phrases")))
    words = lambda side, name: side.select(F.col("id").alias(name), F.explode("tokens").alias("token"))
    lw, rw = words(left, "l"), words(right, "r")
    n = lw.groupBy("token").agg(F.count(F.lit(1)).alias("nl")).join(rw.groupBy("token").agg(F.count(F.lit(1)).alias("nr")), "token")
    n = cut(n.withColumn("hot", (F.col("nl") > MOST_SHARING) | (F.col("nr") > MOST_SHARING)).select("token", "hot"))
    rare = n.where("not hot").select("token")
    lc = left.select(F.col("id").alias("l"), F.explode("cwe").alias("cwe"))
    pairs = lw.join(rare, "token").join(rw, "token").select("l", "r").unionByName(lc.join(right.select(F.col("id").alias("r"), F.explode("cwe").alias("cwe")), "cwe").select("l", "r")).unionByName(lc.join(said, "cwe").select("l", "r")).distinct()
    found = cut(_scored(pairs, left, right, said))
    hot = n.where("hot").select("token")
    if hot.isEmpty():
        return found
    # By hot tokens alone a pair has that many hits and no more: who has a strong match with more hits needs no others.
    more = []
    for side, key in ((lw, "l"), (rw, "r")):
        bound = side.join(F.broadcast(hot), "token").groupBy(key).agg(F.count(F.lit(1)).alias("bound"))
        best = found.groupBy(key).agg(F.max(F.struct("level", "hits")).alias("best"))
        open_ = bound.join(best, key, "left").where("best is null or best.level < 2 or best.hits <= bound").select(key)
        other = rw if key == "l" else lw
        more.append(side.join(F.broadcast(hot), "token").join(open_, key, "left_semi").join(other, "token").select("l", "r"))
    rest = more[0].unionByName(more[1]).distinct().join(found.select("l", "r"), ["l", "r"], "left_anti")
    return found.unionByName(_scored(rest, left, right, said))


def best_of(scored: DataFrame, side: str) -> DataFrame:
    """The best match of each rule of a side (``l`` or ``r``): by level, then hits, then the other's id."""
    other = "r" if side == "l" else "l"
    nth = F.row_number().over(W.partitionBy(side).orderBy(F.desc("level"), F.desc("hits"), other))
    return scored.withColumn("_n", nth).where("_n = 1").select(side, other, "level", "hits")


def coverage(rules: DataFrame, best: DataFrame, side: str) -> DataFrame:
    """Every rule of a side with its match and status: covered, partial or uncovered."""
    other = "r" if side == "l" else "l"
    j = rules.select(F.col("id").alias(side)).join(best, side, "left")
    status = F.when(F.col("level") == 2, "covered").when(F.col("level") == 1, "partial").otherwise("uncovered")
    return j.select(F.col(side).alias("rule"), F.col(other).alias("match"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), status.alias("status"))
