"""Facts that the operators must keep, on small tables."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone.functions import quality as q
from siltstone.functions import severity as sv
from siltstone.functions import text as tx
from siltstone.operators import graph, joins, learning, matching
from siltstone.operators import quality as oq
from siltstone.sources import files, reports
from siltstone.streaming import events as ev


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_debt_bands(spark):
    rating = lambda debt, loc: one(spark, sv.rating_of_debt(q.debt_ratio(F.lit(debt), F.lit(loc))))
    assert rating(1500, 1000) == "A" and rating(1501, 1000) == "B"
    assert one(spark, q.format_debt(F.lit(135))) == "2h 15min" and one(spark, q.format_debt(F.lit(0))) == "0min"


def test_gate_skips_what_is_not_measured(spark):
    null = F.lit(None).cast("double")
    failed = q.failed_conditions(null, null, null, F.lit(0), F.lit("A"), F.lit("A"))
    assert one(spark, failed) == [] and one(spark, q.gate_status(failed)) == "PASSED"
    assert one(spark, q.failed_conditions(F.lit(79.9), null, F.lit(3.1), F.lit(1), F.lit("B"), F.lit("A"))) == ["coverage", "duplication", "blockers", "security"]


def test_suppression_needs_enough_verdicts(spark):
    fb = spark.createDataFrame([("r1", "false_positive")] * 3 + [("r2", "false_positive")] * 5, "rule string, verdict string")
    found = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "rule string")
    got = {r.rule: r.suppressed for r in oq.suppress(found, oq.fp_rates(fb, ["rule"]), ["rule"]).collect()}
    assert got == {"r1": False, "r2": True, "r3": False}


def test_summary_scopes(spark):
    rows = [("a", "BLOCKER", "VULNERABILITY", 0, False, False), ("a", "MAJOR", "CODE_SMELL", 3000, False, False), ("a", "BLOCKER", "CODE_SMELL", 500, True, True)]
    s = oq.analysis_summary(spark.createDataFrame(rows, "id string, severity string, type string, effort int, suppressed boolean, new_code boolean"), ["id"]).first()
    assert (s.total, s.blockers, s.debt_min, s.suppressed, s.security) == (3, 0, 3000, 1, "E")


def test_collapse_keeps_the_most_severe(spark):
    base = dict(path="f", ln=1, col=1, engine="pattern", regex="x")
    rows = [(*base.values(), "R1", "MAJOR", "BUG"), (*base.values(), "R2", "BLOCKER", "BUG"), (*base.values(), "R3", "MINOR", "BUG"), ("f", 1, 1, "pattern", "y", "R4", "MINOR", "CODE_SMELL")]
    got = {r.rule_id: r.absorbed for r in matching.collapse_same_detector(spark.createDataFrame(rows, "path string, ln int, col int, engine string, regex string, rule_id string, severity string, type string")).collect()}
    assert got == {"R2": ["R1", "R3"], "R4": []}


@pytest.mark.parametrize(
    "profile,source,code,comments,strings",
    [
        ("clike", 'a = "x//y"; // c\nb /* d */ e', "a =       ;     \nb         e", "            // c\n  /* d */  ", '    "x//y"      \n           '),
        ("sql", "select 'it''s' -- c", "select             ", None, "       'it''s'     "),
        ("cobol", "000100* remark\n000200 MOVE", None, "000100* remark\n           ", None),
        ("python", "x = 1 # c\n'''d'''", "x = 1    \n       ", "      # c\n       ", "         \n'''d'''"),
    ],
)
def test_masks_keep_length(profile, source, code, comments, strings):
    got = tx.mask_text(source, profile)
    assert all(len(m) == len(source) for m in got)
    for mine, want in zip(got, (code, comments, strings), strict=True):
        assert want is None or mine == want


def test_fnv1a(spark):
    def plain(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h

    for s in ("", "a", "foobar"):
        assert one(spark, tx.fnv1a(F.lit(s))) == plain(s)


def test_graph_facts(spark):
    e = spark.createDataFrame([(1, 0), (2, 0), (0, 3), (10, 11), (11, 12), (12, 10), (13, 10)], "src long, dst long")
    c = {r.node: (r.ca, r.ce, r.instability) for r in graph.coupling(e).collect()}
    assert c[0] == (2, 1, 0.333) and c[1] == (0, 1, 1.0) and c[3] == (1, 0, 0.0)
    assert {(r.node, r.component) for r in graph.cycles(e).collect()} == {(10, 10), (11, 10), (12, 10)}
    hops = {r.node: r.hops for r in graph.hops_from(spark.createDataFrame([(1,)], "node long"), e).collect()}
    assert hops == {1: 0, 0: 1, 3: 2}


def test_flow_paths_avoid_sanitizers(spark):
    n = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 1), (3, 5)], "src long, dst long")
    got = {(r.source, r.sink): r.path for r in graph.flows(n(1), n(3, 5), n(2), e).collect()}
    assert got == {(1, 3): [1, 4, 3], (1, 5): [1, 4, 3, 5]}


def test_includes_stop_at_themselves(spark):
    rows = [("a", 1, "x", None, None, None), ("a", 2, "copy", "b", "one", "two"), ("b", 1, "one", None, None, None), ("b", 2, "again", "a", None, None), ("c", 1, "lost", "zz", None, None)]
    out = graph.expand_includes(spark.createDataFrame(rows, "file string, ln int, text string, include string, replace_from string, replace_to string")).collect()
    a = [r.text for r in sorted((r for r in out if r.file == "a"), key=lambda r: r.place)]
    assert a == ["x", "two", "again"] and [r.include for r in out if r.file == "c"] == ["zz"]


def test_label_quality(spark):
    rows = [(i, 1, 0.9) for i in range(4)] + [(i + 4, 0, 0.1) for i in range(4)] + [(8, 0, 0.96)]
    got = learning.confident_learning(spark.createDataFrame(rows, "id int, label int, prob double")).collect()
    assert [r.id for r in got if r.suspect] == [8]
    clean = learning.confident_learning(spark.createDataFrame(rows[:8], "id int, label int, prob double"))
    assert clean.where("suspect").count() == 0


def test_label_model_beats_majority(spark):
    rng = random.Random(5)
    truth = {i: int(rng.random() < 0.4) for i in range(300)}
    accuracy = {"a": 0.92, "b": 0.9, "c": 0.55, "d": 0.55, "e": 0.5}
    votes = [(i, v, y if rng.random() < p else 1 - y) for i, y in truth.items() for v, p in accuracy.items() if rng.random() < 0.9]
    p, c = learning.dawid_skene(spark.createDataFrame(votes, "candidate int, voter string, vote int"), rounds=12)
    mine = sum((r.p >= 0.5) == bool(truth[r.candidate]) for r in p.collect())
    count = {}
    for i, _, v in votes:
        count[i] = count.get(i, 0) + (1 if v else -1)
    assert mine > sum((n > 0) == bool(truth[i]) for i, n in count.items())
    report = {r.voter: r.accuracy for r in learning.voter_report(c).collect()}
    assert min(report["a"], report["b"]) > max(report["c"], report["d"], report["e"])


def test_stumps_are_stable_and_separate(spark):
    rng = random.Random(1)
    rows = [(float(i % 10), rng.random(), int(i % 10 > 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, noise double, label int")
    a, b = (learning.train_stumps(df, ["x", "noise"], rounds=5) for _ in range(2))
    assert a == b and a["stumps"][0][:2] == ("x", 5.5)
    good = df.withColumn("s", q.sigmoid(q.stump_score({"x": F.col("x"), "noise": F.col("noise")}, a["stumps"], a["base"], 1.0))).where((F.col("s") >= 0.5) == (F.col("label") == 1)).count()
    assert good > 190


def test_lloyd_is_repeatable(spark):
    pts = [(i, [float(i % 2) * 10 + (i % 5) / 10, 1.0]) for i in range(16)]
    df = spark.createDataFrame(pts, "id int, vec array<double>")
    a, b = ({r.id: r.cluster for r in learning.lloyd(df, 2)[0].collect()} for _ in range(2))
    assert a == b and len({a[i] for i in range(0, 16, 2)}) == 1 and a[0] != a[1]


def test_changed_coverage(spark):
    ch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "path string, ln int")
    cov = spark.createDataFrame([("a", 1, True), ("a", 9, False)], "path string, ln int, hit boolean")
    assert {r.path: (r.executable, r.covered, r.pct) for r in joins.changed_coverage(ch, cov).collect()} == {"a": (1, 1, 100.0), "b": (1, 0, 0.0)}


def test_readers(spark, tmp_path):
    (tmp_path / "x.info").write_text("TN:\nSF:src/a.py\nDA:1,0\nDA:2,3\nend_of_record\nSF:b.py\nDA:1,1\nDA:1,0\nend_of_record\n")
    assert {(r.path, r.ln, r.hit) for r in reports.read_lcov(spark, str(tmp_path / "x.info")).collect()} == {("src/a.py", 1, False), ("src/a.py", 2, True), ("b.py", 1, True)}
    (tmp_path / "c.xml").write_text('<coverage><packages><package><classes><class filename="a.py"><lines><line number="1" hits="0"/><line number="2" hits="4"/></lines></class></classes></package></packages></coverage>')
    assert {(r.path, r.ln, r.hit) for r in reports.read_cobertura(spark, str(tmp_path / "c.xml")).collect()} == {("a.py", 1, False), ("a.py", 2, True)}
    (tmp_path / "j.xml").write_text('<report name="jacoco"><package name="p/q"><sourcefile name="A.java"><line nr="3" mi="1" ci="0"/><line nr="4" mi="0" ci="2"/></sourcefile></package></report>')
    assert {(r.path, r.ln, r.hit) for r in reports.read_jacoco(spark, str(tmp_path / "j.xml")).collect()} == {("p/q/A.java", 3, False), ("p/q/A.java", 4, True)}
    (tmp_path / "g.out").write_text("mode: set\nm/a.go:1.2,3.4 2 0\nm/a.go:3.1,4.2 1 1\n")
    assert {(r.ln, r.hit) for r in reports.read_go_cover(spark, str(tmp_path / "g.out")).collect()} == {(1, False), (2, False), (3, True), (4, True)}
    (tmp_path / "d.diff").write_text("--- a/x.py\n+++ b/x.py\n@@ -1,2 +5,2 @@\n+a\n+b\n@@ -9 +12 @@\n+c\n@@ -20,2 +30,0 @@\n")
    assert {(r.path, r.ln) for r in reports.read_diff(spark, str(tmp_path / "d.diff")).collect()} == {("x.py", 5), ("x.py", 6), ("x.py", 12)}
    assert {(r.start, r.end) for r in reports.read_diff(spark, str(tmp_path / "d.diff"), ranges=True).collect()} == {(5, 6), (12, 12), (30, 30)}
    (tmp_path / "l.json").write_text('[{"filePath":"./a.js","messages":[{"ruleId":"r","severity":2,"message":"m","line":3,"column":4},{"ruleId":null,"severity":1}]}]')
    assert [tuple(r) for r in reports.read_lint(spark, str(tmp_path / "l.json")).collect()] == [("a.js", "r", "CRITICAL", 3, 4)]
    (tmp_path / "s.json").write_text(
        '{"runs":[{"tool":{"driver":{"name":"T","rules":[{"id":"R","properties":{"tags":["external/cwe/cwe-79"],"security-severity":"9.1"}}]}},"results":[{"ruleIndex":0,"message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"file:///a.js"},"region":{"startLine":2}}}]},{"ruleId":"R","message":{"text":"x"},"locations":[]}]}]}'
    )
    r = reports.read_sarif(spark, str(tmp_path / "s.json")).first()
    assert (r.rule_id, r.severity, r.path, r.ln, r.col, r.cwe) == ("R", "BLOCKER", "a.js", 2, 1, ["CWE-79"])
    (tmp_path / "bad.json").write_text("{nope")
    assert [x.file.endswith("bad.json") for x in reports.unreadable(spark, str(tmp_path / "bad.json")).collect()] == [True]


def test_ignore_globs():
    import re

    p = re.compile(files.ignore_pattern(["*.min.js", "/dist/", "docs/**/x", "# c"]))
    hit = ["a/b.min.js", "dist/a", "docs/x", "docs/a/b/x"]
    assert all(p.match(h) for h in hit) and not any(p.match(h) for h in ["a/dist/b", "x.js", "docs/y"])


def test_streams_resume(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 00:00:00", i % 4, "error" if i % 5 == 0 else "click") for i in range(60)], "event_id int, t string, user_id int, event_type string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    out = ev.run_updates(ev.windowed_counts(ev.read_events(spark, str(tmp_path), files_per_batch=1), [], "1 day", "10 days"), ["start"])
    assert {(str(r.start)[:10], r.n) for r in out.collect()} == {(f"2024-01-0{k}", 20) for k in (1, 2, 3)}
    carried = ev.carry_voters(ev.read_events(spark, str(tmp_path), files_per_batch=1).select(F.col("user_id").alias("voter"), F.lit(1).alias("right")), str(tmp_path / "state"))
    assert all(r.right < 15.1 and math.isclose(r.right, r.mass) for r in carried.collect())


def test_unsafe_regexes(spark):
    for p, bad in (("(a+)+", True), ("(a{2,})*", True), ("a+b*", False), ("x" * 301, True)):
        assert one(spark, matching.unsafe_regex(F.lit(p))) is bad


def test_agent_paths(spark):
    for p, y in (("x/AGENTS.md", True), ("README.md", False), (".claude/docs/a.md", False), ("a/.cursor/rules/b", True), ("x.mdc", True)):
        assert one(spark, tx.is_agent_path(F.lit(p))) is y


def test_detector_lint(spark):
    weight = lambda p: one(spark, matching.detector_lint(F.lit(p)))
    assert weight("(eval|exec)") > weight(r"\b(eval|exec)\b") and weight("a.*") > weight("^password[ ]?=$")


def test_flows_keep_one_frontier_and_each_pair_once(spark):
    """A line of seven places: what stays in the shared folder doesn't hold the pairs of all rounds again in each."""
    n = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")
    e = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(i + 1, i) for i in range(6)], "src long, dst long")
    top = Path(graph.shared_dir(spark).removeprefix("file:"))
    before = set(top.rglob("*.parquet"))
    got = graph.flows(n(0), n(2, 6), n(), e)
    kept = [spark.read.parquet(str(p)) for p in set(top.rglob("*.parquet")) - before]
    assert sum(t.count() for t in kept if {"source", "at"} <= set(t.columns)) <= 6 + 1 + 1  # pairs before the last round, its frontier, the sink on the way
    assert sorted(tuple(r) for r in got.collect()) == [(0, 2, [0, 1, 2]), (0, 6, [0, 1, 2, 3, 4, 5, 6])]
