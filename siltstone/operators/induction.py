"""Votes on findings and what follows from them: labelling functions, agreement of voters, cases and verdicts.

Candidates are findings (candidate, rule_id, path, ln, col, end_col, txt, engine, cwe, scope). Each labelling function
is one aggregate or one equi join that gives (candidate, vote): 1 for a defect, 0 for none; a candidate that it says
nothing of has no row. Their votes are stacked and handed to the label model, which alone decides how far to trust each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import lexical_masks, normal_snippet
from siltstone.operators.graph import cut
from siltstone.operators.learning import dawid_skene, voter_report

#: Lines below which a file has no density, share of lines above which a rule describes its style, and the few findings in
#: a file of so many lines that look like defects.
SHORT_FILE, STYLE_SHARE, FEW, LONG_FILE = 40, 0.2, 2, 120
#: Copies of a line's form from which it is the way the team writes.
IDIOM = 100
#: Voters that a case needs, the probabilities from which it is one, and candidates that a verdict needs.
LEAST_VOTERS, SURE, UNSURE, LEAST_CANDIDATES = 2, 0.9, 0.1, 5


def comment_votes(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Against matches that lie in comments alone; rules whose scope isn't ``any`` say nothing. ``files`` has
    (path, text, profile). Only lines with candidates leave the files' masks."""
    asked = candidates.where("scope = 'any'").select("candidate", "path", "ln", "col", "end_col")
    wanted = asked.groupBy("path").agg(F.array_sort(F.collect_set("ln")).alias("lns"))
    masked = files.join(wanted, "path").select("path", "lns", lexical_masks(F.coalesce("text", F.lit("")), F.col("profile")).alias("m"))
    of = lambda mask: F.split(F.col(f"m.{mask}"), r"\r?\n", -1)
    rows = masked.select("path", F.col("lns"), of("code").alias("code"), of("comments").alias("comments"))
    at = lambda lines, ln: F.get(lines, ln - 1)
    rows = rows.select("path", F.inline(F.transform("lns", lambda ln: F.struct(ln.alias("ln"), at(F.col("code"), ln).alias("code"), at(F.col("comments"), ln).alias("comment")))))
    seen = lambda c: F.trim(F.substring(F.col(c), F.col("col"), F.greatest(F.lit(1), F.col("end_col") - F.col("col")))) != ""
    return asked.join(rows, ["path", "ln"]).where(seen("comment") & ~seen("code")).select("candidate", F.lit(0).alias("vote"))


def agreement_votes(candidates: DataFrame) -> DataFrame:
    """For findings that another rule with a common weakness makes within a line; against those where two or more other
    rules' findings name only other weaknesses. Rules without weaknesses neither vote nor count."""
    named = candidates.where(F.size("cwe") > 0)
    near = named.select("path", F.explode(F.array(F.col("ln") - 1, F.col("ln"), F.col("ln") + 1)).alias("ln"), F.col("rule_id").alias("_rule"), F.col("cwe").alias("_cwe"))
    # Findings of one rule at a place are one row with their number, so that a crowded line isn't all pairs.
    near = near.groupBy("path", "ln", "_rule", "_cwe").agg(F.count(F.lit(1)).alias("_n"))
    pairs = named.select("candidate", "path", "ln", "rule_id", "cwe").join(near, ["path", "ln"]).where("rule_id != _rule")
    shares = F.arrays_overlap("cwe", "_cwe")
    n = pairs.groupBy("candidate").agg(F.sum(F.when(shares, F.col("_n")).otherwise(0)).alias("with"), F.sum(F.when(shares, 0).otherwise(F.col("_n"))).alias("against"))
    vote = F.when(F.col("with") > 0, 1).when(F.col("against") > 1, 0)
    return n.select("candidate", vote.alias("vote")).where("vote is not null")


def flow_votes(candidates: DataFrame, tainted: DataFrame, paths: DataFrame) -> DataFrame:
    """Of rules that declare a flow (``tainted``: rule_id): for a finding of the flow engine at the end of a path (sink,
    a node ``path#ln``), against one that only the pattern engine made."""
    asked = candidates.join(F.broadcast(tainted.select("rule_id").distinct()), "rule_id", "left_semi")
    ends = paths.select(F.col("sink").alias("_sink")).distinct().withColumn("_ends", F.lit(True))
    j = asked.withColumn("_at", F.concat_ws("#", "path", F.col("ln").cast("string"))).join(ends, F.col("_at") == F.col("_sink"), "left")
    vote = F.when((F.col("engine") == "taint") & F.col("_ends"), 1).when(F.col("engine") == "pattern", 0)
    return j.select("candidate", vote.alias("vote")).where("vote is not null")


def density_votes(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Against a rule that points at over a fifth of a file's useful lines, for one that makes few findings in a long file."""
    useful = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1), lambda x: F.trim(x) != ""))
    size = files.select("path", useful.alias("_useful")).where(F.col("_useful") >= SHORT_FILE)
    n = candidates.groupBy("path", "rule_id").agg(F.count(F.lit(1)).alias("_n")).join(size, "path")
    vote = F.when(F.col("_n") / F.col("_useful") > STYLE_SHARE, 0).when((F.col("_n") <= FEW) & (F.col("_useful") > LONG_FILE), 1)
    said = n.select("path", "rule_id", vote.alias("vote")).where("vote is not null")
    return candidates.select("candidate", "path", "rule_id").join(said, ["path", "rule_id"]).select("candidate", "vote")


def rarity_votes(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Against lines whose form (no literals, numbers and spaces) stands IDIOM times or more in all files, for those that
    stand once. Forms are counted before anything is joined; only rare and frequent forms of candidates remain."""
    lines = files.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)).alias("txt")).where(F.trim("txt") != "")
    key = lambda form: (F.xxhash64(form).alias("_h"), F.xxhash64(F.concat(F.lit("\1"), form)).alias("_h2"))
    forms = lines.select(*key(normal_snippet(F.col("txt")))).groupBy("_h", "_h2").agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= IDIOM) | (F.col("_n") == 1))
    asked = candidates.select("candidate", *key(normal_snippet(F.col("txt"))))
    # Many candidates may stand on one form: forms of candidates are made distinct first, then handed back.
    known = asked.select("_h", "_h2").distinct().join(forms, ["_h", "_h2"])
    return asked.join(known, ["_h", "_h2"]).select("candidate", F.when(F.col("_n") == 1, 1).otherwise(0).alias("vote"))


def stacked(votes: dict[str, DataFrame]) -> DataFrame:
    """(candidate, voter, vote) of all voters."""
    out = None
    for name, said in votes.items():
        one = said.select("candidate", F.lit(name).alias("voter"), F.col("vote").cast("int").alias("vote"))
        out = one if out is None else out.unionByName(one)
    return out


def case_id(candidate: Column) -> Column:
    return F.concat(F.lit("ind-"), F.substring(F.sha2(candidate.cast("string"), 256), 1, 12))


def induce(candidates: DataFrame, votes: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels of candidates (candidate, rule_id, txt, ...) by the agreement of their voters, without a known truth.

    Returns (labels, verdicts, voters). labels: candidate, rule_id, case_id, code, p, voters, expected; a case with at
    least LEAST_VOTERS opinions is a ``match`` from p = SURE, a ``no_match`` to p = UNSURE, and null in between or with
    fewer opinions. verdicts: per rule its candidates, confirmed, refuted, uncertain, precision (of the decided, null
    without any) and verdict. voters: how often each is right, by the label model.
    """
    votes = cut(votes)
    p, confusion_ = dawid_skene(votes, state=state)
    opinions = votes.where("vote is not null").groupBy("candidate").agg(F.count(F.lit(1)).alias("voters"))
    labels = candidates.select("candidate", "rule_id", F.trim("txt").alias("code")).join(p, "candidate", "left").join(opinions, "candidate", "left").withColumn("voters", F.coalesce("voters", F.lit(0)))
    enough = F.col("voters") >= LEAST_VOTERS
    expected = F.when(enough & (F.col("p") >= SURE), "match").when(enough & (F.col("p") <= UNSURE), "no_match")
    labels = labels.select("candidate", "rule_id", case_id(F.col("candidate")).alias("case_id"), "code", "p", "voters", expected.alias("expected"))
    return labels, induced_verdicts(labels), voter_report(confusion_)


def induced_verdicts(labels: DataFrame) -> DataFrame:
    """Per rule what its labels (rule_id, expected) say of it."""
    n = labels.groupBy("rule_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("expected") == "match").alias("confirmed"), F.count_if(F.col("expected") == "no_match").alias("refuted"))
    decided = F.col("confirmed") + F.col("refuted")
    precision = F.when(decided > 0, F.col("confirmed") / decided)
    verdict = F.when((F.col("candidates") < LEAST_CANDIDATES) | (decided == 0), "no-evidence").when(precision >= 0.85, "approve").when(precision >= 0.5, "review").otherwise("quarantine")
    return n.select("rule_id", "candidates", "confirmed", "refuted", (F.col("candidates") - decided).alias("uncertain"), F.round(precision, 6).alias("precision"), verdict.alias("verdict"))
