"""Rules that improve over generations: mutants of survivors, judged on cases, with a table for each generation.

A rule's mutations are at most MOST_MUTATIONS specs; an individual is the set of those that are applied, as bits of a
mask. Every generation scores only masks that no earlier one had, on all cases of the rule, and its rows are written to
the shared folder, so a lost executor costs a part of one generation and the next plan starts from a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.graph import cut
from siltstone.operators.learning import compiles

#: Mutations of a rule, individuals of a generation, gain of F1 and precision that a promotion needs.
MOST_MUTATIONS, POPULATION, LEAST_GAIN, LEAST_PRECISION = 12, 8, 1e-6, 0.85


def mutated(rule: Column, spec: Column) -> Column:
    """One mutation spec (kind, value) applied to a rule struct (regex, unless)."""
    value, regex, unless = spec["value"], rule["regex"], rule["unless"]
    alt = lambda c: F.when(F.coalesce(c, F.lit("")) == "", value).otherwise(F.concat(c, F.lit("|"), value))
    before, after = F.substring_index(value, "=>", 1), F.substring(value, F.instr(value, "=>") + 2, F.length(value))
    place = F.call_function("locate", before, regex)
    swapped = F.when((F.instr(value, "=>") > 1) & (place > 0), F.concat(F.substring(regex, F.lit(1), place - 1), after, F.substring(regex, place + F.length(before), F.length(regex)))).otherwise(regex)
    new_regex = F.when(spec["kind"] == "append_regex_alt", alt(regex)).when(spec["kind"] == "replace_in_regex", swapped).otherwise(regex)
    new_unless = F.when(spec["kind"] == "set_unless", value).when(spec["kind"] == "append_unless_alt", alt(unless)).otherwise(unless)
    return F.struct(new_regex.alias("regex"), new_unless.alias("unless"))


def bit(i: Column) -> Column:
    return F.pow(F.lit(2.0), i).cast("int")


def pools(rules: DataFrame, specs: DataFrame) -> DataFrame:
    """(rule_id, regex, unless, pool): each rule with its first MOST_MUTATIONS specs (rule_id, id, kind, value) by id."""
    nth = F.row_number().over(W.partitionBy("rule_id").orderBy("id"))
    few = specs.withColumn("_n", nth).where(F.col("_n") <= MOST_MUTATIONS)
    pool = few.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "id", "kind", "value"))), lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("kind"), x["value"].alias("value"))).alias("pool"))
    return rules.select("rule_id", "regex", "unless").join(pool, "rule_id")


def individuals(masks: DataFrame, pool: DataFrame) -> DataFrame:
    """(rule_id, mask, regex, unless): masks with their mutations applied in the order of the pool."""
    chosen = F.filter("pool", lambda s, i: F.floor(F.col("mask") / F.pow(F.lit(2.0), i)) % 2 == 1)
    start = F.struct(F.col("regex").alias("regex"), F.col("unless").alias("unless"))
    made = masks.join(pool, "rule_id").select("rule_id", "mask", F.aggregate(chosen, start, mutated).alias("r"))
    return made.select("rule_id", "mask", "r.regex", "r.unless")


def judged(some: DataFrame, cases: DataFrame, pool: DataFrame) -> DataFrame:
    """Individuals with tp, fp, fn, precision, recall, f1 and fitness on the cases (rule_id, case_id, code, truth) of
    their rule. Patterns that don't compile are out. Empty ratios are 1, as in the optimistic confusion."""
    spark = some.sparkSession
    patterns = [r.p for r in some.select(F.explode(F.array("regex", "unless")).alias("p")).where("p is not null").distinct().collect()]
    broken = [p for p in patterns if not compiles(spark, p)]  # at most POPULATION * MOST_MUTATIONS for each rule
    fine = lambda c: F.col(c).isNull() | ~F.col(c).isin(broken) if broken else F.lit(True)
    j = cases.join(F.broadcast(some.where(fine("regex") & fine("unless"))), "rule_id")
    hit = F.expr("code rlike regex") & (F.col("unless").isNull() | ~F.expr("code rlike unless"))
    j = j.select("rule_id", "mask", "regex", "unless", "truth", F.coalesce(hit, F.lit(False)).alias("hit"))
    n = j.groupBy("rule_id", "mask", "regex", "unless").agg(F.count_if(F.col("hit") & F.col("truth")).alias("tp"), F.count_if(F.col("hit") & ~F.col("truth")).alias("fp"), F.count_if(~F.col("hit") & F.col("truth")).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    n = n.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    n = n.join(F.broadcast(pool.select("rule_id", F.size("pool").alias("_size"))), "rule_id")
    simple = 1 - F.bit_count("mask") / (F.col("_size") + 1)
    return n.withColumn("fitness", F.round(1000 * F.col("f1") + 10 * F.col("precision") + simple, 6)).drop("_size")


def best_first(*by: str) -> W:
    return W.partitionBy(*by).orderBy(F.desc("fitness"), "mask")


def evolve(rules: DataFrame, specs: DataFrame, cases: DataFrame, generations: int = 5) -> tuple[list[DataFrame], DataFrame]:
    """Generations of the rules' mutants, and the decision on each rule's best.

    Generation 0 holds the rule itself, each mutation alone and all together. The best POPULATION / 2 individuals that
    were ever scored survive; the next generation is every mask that differs from a survivor in one mutation and is new.
    That search takes all neighbours where a random one would draw some, so reruns agree. Each table has (rule_id,
    generation, mask, regex, unless, tp, fp, fn, precision, recall, f1, fitness). Generations end early when no mask is
    new. Rules without specs or without cases don't evolve.
    """
    pool = cut(pools(rules, specs).join(cases.select("rule_id").distinct(), "rule_id", "left_semi"))
    size = F.size("pool")
    first = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(0), size - 1), lambda i: bit(i)), F.array((F.pow(F.lit(2.0), size) - 1).cast("int"))))
    masks, tables, seen = pool.select("rule_id", F.explode(first).alias("mask")), [], None
    for generation in range(generations + 1):
        scored = cut(judged(individuals(masks, pool), cases, pool).withColumn("generation", F.lit(generation)))
        tables.append(scored)
        seen = scored if seen is None else seen.unionByName(scored)
        if generation == generations:
            break
        survivors = seen.withColumn("_n", F.row_number().over(best_first("rule_id"))).where(F.col("_n") <= POPULATION // 2).select("rule_id", "mask")
        flips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.col("mask").bitwiseXOR(bit(i)))
        children = survivors.join(pool, "rule_id").select("rule_id", F.explode(flips).alias("mask")).distinct()
        masks = cut(children.join(seen.select("rule_id", "mask"), ["rule_id", "mask"], "left_anti"))
        if masks.isEmpty():
            break
    return tables, decisions(seen, cases)


def failures(some: DataFrame, cases: DataFrame) -> DataFrame:
    """(rule_id, case_id) of the cases that an individual gets wrong."""
    hit = F.expr("code rlike regex") & (F.col("unless").isNull() | ~F.expr("code rlike unless"))
    j = cases.join(F.broadcast(some.select("rule_id", "regex", "unless")), "rule_id")
    return j.where(F.coalesce(hit, F.lit(False)) != F.col("truth")).select("rule_id", "case_id")


def decisions(seen: DataFrame, cases: DataFrame) -> DataFrame:
    """The best individual of each rule, and whether it takes the rule's place: more F1, precise, and no case wrong that
    the rule gets right. (rule_id, mask, regex, base_f1, f1, precision, regressions, decision)"""
    ranked = seen.withColumn("_n", F.row_number().over(best_first("rule_id")))
    best, base = ranked.where("_n = 1"), seen.where("mask = 0")
    worse = failures(best, cases).join(failures(base, cases), ["rule_id", "case_id"], "left_anti").groupBy("rule_id").agg(F.count(F.lit(1)).alias("regressions"))
    j = best.join(base.select("rule_id", F.col("f1").alias("base_f1")), "rule_id").join(worse, "rule_id", "left").withColumn("regressions", F.coalesce("regressions", F.lit(0)))
    decision = F.when(F.col("f1") - F.col("base_f1") <= LEAST_GAIN, "no-gain").when(F.col("precision") < LEAST_PRECISION, "imprecise").when(F.col("regressions") > 0, "regression").otherwise("promoted")
    return j.select("rule_id", "mask", "regex", "base_f1", "f1", "precision", "regressions", decision.alias("decision"))
