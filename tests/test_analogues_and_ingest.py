"""Rule analogues against all pairs; ingest with replays, merges and late rows; table functions; k-means and PCA."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import analogues as an
from siltstone.operators import learning as ln
from siltstone.sources import reports
from siltstone.sources import table_functions as tf
from siltstone.streaming import events as ev
from siltstone.streaming import ingest as ing

LEFT, RIGHT = "id int, type string, languages array<string>, cwe array<string>, tokens array<string>", "id int, type string, lang string, cwe array<string>, tokens array<string>, text string"


def plain_best(left, right, phrases, side):
    fits = lambda a, b: b is None or a == b or (a, b) in {("VULNERABILITY", "SECURITY_HOTSPOT"), ("CODE_SMELL", "BUG"), ("BUG", "CODE_SMELL")}
    good = lambda ts: {t for t in ts or [] if len(t) >= 3 or t.isdigit()}
    out = {}
    for i, lt, langs, lc, ltok in left:
        for k, rt, lang, rc, rtok, text in right:
            if "any" not in langs and lang not in langs:
                continue
            both = good(ltok) & good(rtok)
            p = 2 * sum(c in (lc or []) and ph in (text or "").lower() for c, ph in phrases)
            hits, multi, cwe, fit = len(both) + p, sum(len(t) >= 6 for t in both) + p, bool(set(lc or []) & set(rc or [])), fits(lt, rt)
            level = 2 if cwe and fit else 1 if cwe else 2 if multi >= 2 and fit else 1 if hits >= 3 and fit else 1 if multi >= 1 and hits >= 2 else None
            if level:
                a, b = (i, k) if side == "l" else (k, i)
                out[a] = max(out.get(a, (0, 0, 0, 0)), (level, hits, -b, b))
    return {a: (x[3], x[1], x[0]) for a, x in out.items()}


@pytest.mark.parametrize("most", [200, 3, 0])
def test_analogues_equal_all_pairs(spark, most, monkeypatch):
    monkeypatch.setattr(an, "MOST_SHARING", most)
    rng = random.Random(6)
    word = lambda: rng.choice(["sql", "injection", "password", "the", "of", "12", "ab", "hardcoded", "buffer", "overflow", "null", "pointer", *(f"rare{i}" for i in range(30))])
    bag = lambda: [word() for _ in range(rng.randint(0, 6))]
    kind = lambda: rng.choice(["VULNERABILITY", "CODE_SMELL", "BUG", "SECURITY_HOTSPOT", None])
    cwe = lambda: rng.choice([None, [], ["CWE-1"], ["CWE-2", "CWE-3"], [f"CWE-{rng.randint(4, 40)}"]])
    left = [(i, kind() or "BUG", rng.choice([["any"], ["java"], ["py", "js"]]), cwe(), bag()) for i in range(60)]
    right = [(100 + i, kind(), rng.choice(["java", "py", "js", None]), cwe(), rng.choice([bag(), None]), " ".join(bag()).upper()) for i in range(70)]
    phrases = [("CWE-1", "sql injection"), ("CWE-2", "pass"), ("CWE-3", "null")]
    l, r = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    scored = an.matches(l, r, spark.createDataFrame(phrases, "cwe string, phrase string"))
    for side, mine in (("l", l), ("r", r)):
        best = an.best_of(scored, side)
        other = "r" if side == "l" else "l"
        want = plain_best(left, right, phrases, side)
        assert {x[side]: (x[other], x.hits, x.level) for x in best.collect()} == want
        status = {x.rule: x.status for x in an.coverage(mine, best, side).collect()}
        assert len(status) == mine.count() and sum(s != "uncovered" for s in status.values()) == len(want)


SCHEMA = "repo int, analysis_id int, ts timestamp, loc int, issues array<string>"
DAY = datetime(2024, 1, 1)


def analysis(i, repo, hours, *issues):
    return (repo, i, DAY + timedelta(hours=hours), 100, list(issues))


def findings_of(batch):
    rows = batch.select("repo", "analysis_id", "ts", F.explode("issues").alias("x"))
    part = lambda k: F.split("x", ":")[k]
    return rows.select("repo", "analysis_id", "ts", part(0).alias("fingerprint"), F.lit("R").alias("rule_id"), part(1).alias("severity"), F.lit(10).alias("effort"))


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("merged", [16, 1])
def test_ingest_with_replays(spark, tmp_path, monkeypatch, merged):
    monkeypatch.setattr(ing, "MERGED", merged)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    read = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    add(spark, source, [analysis(1, 1, 1, "a:MAJOR", "b:BLOCKER"), analysis(2, 1, 30, "a:MINOR"), analysis(3, 2, 2), analysis(3, 2, 2)])
    first = ing.ingest_analyses(read(), findings_of, folder)
    issues = lambda k: {(r.repo, r.fingerprint): (r.first.analysis_id, r.last.analysis_id, r.last.severity, r.seen) for r in k.state("issues").collect()}
    repos = lambda k: {r.repo: (r.last.analysis_id, r.last.findings, r.analyses, r.failed) for r in k.state("repos").collect()}
    want_issues, want_repos = {(1, "a"): (1, 2, "MINOR", 2), (1, "b"): (1, 1, "BLOCKER", 1)}, {1: (2, 1, 2, 1), 2: (3, 0, 1, 0)}
    assert (issues(first), repos(first)) == (want_issues, want_repos)
    # The batch ran but was not marked as done: it runs again and replaces what it wrote.
    commits = f"{folder}/run/checkpoint/commits"
    for name in os.listdir(commits):
        os.remove(f"{commits}/{name}")
    again = ing.ingest_analyses(read(), findings_of, folder)
    assert (issues(again), repos(again)) == (want_issues, want_repos)
    add(spark, source, [analysis(4, 1, 40, "b:MINOR", "c:CRITICAL"), analysis(5, 2, 0, "a:INFO")])
    more = ing.ingest_analyses(read(), findings_of, folder)
    assert issues(more) == want_issues | {(1, "b"): (1, 4, "MINOR", 2), (1, "c"): (4, 4, "CRITICAL", 1), (2, "a"): (5, 5, "INFO", 1)}
    assert repos(more) == {1: (4, 2, 3, 2), 2: (3, 0, 2, 0)}  # an older analysis that comes late is counted, not the last
    days = {(r.repo, r.day): (r.analyses, r.findings, r.debt) for r in more.state("days").collect()}
    assert days == {(1, "2024-01-01"): (1, 2, 20), (1, "2024-01-02"): (2, 3, 30), (2, "2024-01-01"): (2, 1, 10)}
    assert more.summaries().count() == 5 and ing.Ingested(spark, str(tmp_path / "none")).state("issues") is None


def test_late_rows_are_counted(spark, tmp_path):
    schema = "ts timestamp, event_type string"
    source = str(tmp_path / "in")
    at = lambda h: DAY + timedelta(hours=h)
    seen = []
    handle = lambda b, n: seen.extend((r.start, r.n) for r in b.collect())
    run = lambda: ing.run_counting_late(ev.windowed_counts(spark.readStream.schema(schema).parquet(source), ["event_type"], "1 hour", "2 hours"), str(tmp_path / "out"), handle)
    put = lambda *hours: spark.createDataFrame([(at(h), "x") for h in hours], schema).coalesce(1).write.mode("append").parquet(source)
    put(1, 2, 50)
    assert run() == 0
    put(3, 4, 49.5)
    assert run() == 2
    assert (at(49), 1) in seen and not any(s == at(3) for s, _ in seen)


def test_table_functions(spark, tmp_path):
    lcov = "TN:\nDA:1,1\nSF:./a.js\nDA:1,0\nDA:2,3\nDA:1,2\nend_of_record\nSF:b.js\r\nDA:7,0\r\nBRF:2\n"
    diff = "--- a/x\n+++ b/src/x.py\n@@ -1,2 +5,3 @@ def f\n+a\n@@ -9 +20 @@\n+++ /dev/null\n@@ -1,2 +0,0 @@\n--- a/y\n+++ b/y.py\n@@ -3,2 +3,0 @@\n"
    for name, text in (("l", lcov), ("d", diff)):
        os.makedirs(tmp_path / name)
        for i in range(2):
            (tmp_path / name / f"{i}.txt").write_text(text)
    got = Counter(map(tuple, tf.lcov_lines(spark, str(tmp_path / "l")).collect()))
    assert got == Counter({("a.js", 1, True): 1, ("a.js", 2, True): 1, ("b.js", 7, False): 1}) == Counter(map(tuple, reports.read_lcov(spark, str(tmp_path / "l")).where("path is not null").collect()))
    got = sorted(map(tuple, tf.diff_lines(spark, str(tmp_path / "d")).collect()))
    assert got == [("src/x.py", 5), ("src/x.py", 6), ("src/x.py", 7), ("src/x.py", 20)] == sorted(map(tuple, reports.read_diff(spark, str(tmp_path / "d")).collect()))
    tf.register(spark)
    tf.text_lines(spark, str(tmp_path / "l")).createOrReplaceTempView("report_rows")
    assert spark.sql("SELECT count(*) AS n FROM lcov_lines(TABLE(report_rows) PARTITION BY file ORDER BY (block, i))").first().n == 8


def test_kmeans_and_report(spark):
    rng = np.random.default_rng(2)
    points = [(i, (np.eye(3)[i % 3] * 10 + rng.random(3)).tolist(), f"f{i % 20:02}") for i in range(90)]
    df = spark.createDataFrame(points, "id int, vec array<double>, file string")
    assigned, centres = ln.kmeans(df, 3)
    rows = assigned.collect()
    assert len(centres) == 3 and all(len({r.cluster for r in rows if r.id % 3 == k}) == 1 for k in range(3))
    for r in rows:
        d = [np.linalg.norm(np.array(r.vec) - c) for c in centres]
        assert r.cluster == int(np.argmin(d)) and r.distance == pytest.approx(min(d))
    for k, c in enumerate(centres):
        assert np.allclose(c, np.mean([r.vec for r in rows if r.cluster == k], axis=0))
    assert np.allclose(centres, ln.kmeans(df.repartition(5), 3)[1])
    report = {r.family: r for r in ln.family_report(assigned.join(df.select("id", "file"), "id"), 3).collect()}
    assert set(report) == {f"fam-3-{k}" for k in range(3)} and all(r["size"] == 30 and r.samples == [f"f{i:02}" for i in range(8)] for r in report.values())
    assert sum(r.inertia for r in report.values()) == pytest.approx(sum(r.distance**2 for r in rows))
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(9)], "id int, vec array<double>")
    assert len(ln.kmeans(same, 4)[1]) == 1 and ln.kmeans(same.limit(0), 4)[0].count() == 0


def test_draws_follow_the_squared_distance(spark):
    """One point at 0, one at 1, one at 3: from 0 the second centre is the far one nine times of ten."""
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [3.0])], "id int, vec array<double>")
    drawn = Counter()
    for seed in range(60):
        first, second = ln.weighted_centres(df, 2, seed)
        if first == [0.0]:
            drawn[second[0]] += 1
    assert drawn[3.0] > 3 * drawn[1.0] and set(drawn) <= {1.0, 3.0}


def test_power_pca(spark):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((80, 5)) * [5, 2, 1, 0.5, 0.1]
    got = {r.id: (r.x, r.y) for r in ln.power_pca(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id int, vec array<double>")).collect()}
    c = m - m.mean(axis=0)
    _, _, axes = np.linalg.svd(c, full_matrices=False)
    for k in range(2):
        assert np.allclose(np.abs([got[i][k] for i in range(80)]), np.abs(c @ axes[k]), atol=1e-3)
    assert ln.power_pca(spark.createDataFrame([], "id int, vec array<double>")).count() == 0
    flat = ln.power_pca(spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "id int, vec array<double>")).collect()
    assert all(r.x == r.y == 0 for r in flat)
