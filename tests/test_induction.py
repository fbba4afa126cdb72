"""Votes, induced cases, mined rules, evolution, anomalies and similar pairs against plain Python."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.operators import evolution as ev
from siltstone.operators import induction as ind
from siltstone.operators import learning as ln
from siltstone.operators import mining, similarity
from siltstone.plans import all_plans
from siltstone.plans.induction_plans import RULES, SPECS
from tests.test_learning import plain_label_model

CANDIDATES = "candidate string, rule_id string, path string, ln int, col int, end_col int, txt string, cwe array<string>, engine string, scope string"


def candidate(spark, *rows):
    return spark.createDataFrame([(f"c{i}", *r) for i, r in enumerate(rows)], CANDIDATES)


def said(df):
    return {r.candidate: r.vote for r in df.collect()}


def test_comment_votes(spark):
    files = spark.createDataFrame([("a.py", 'x = 1  # secret one\ny = "secret"\nsecret # two\r\n#secret', "python"), ("b", None, "conf")], "path string, text string, profile string")
    at = lambda ln, col, scope="any", path="a.py": ("R", path, ln, col, col + 6, "", [], "pattern", scope)
    c = candidate(spark, at(1, 10), at(1, 10, "code"), at(2, 6), at(3, 1), at(4, 2), at(9, 1), at(1, 1, path="b"))
    assert said(ind.comment_votes(c, files)) == {"c0": 0, "c4": 0}


def test_agreement_votes(spark):
    of = lambda rule, ln, *cwe: (rule, "f", ln, 1, 2, "", list(cwe), "pattern", "any")
    c = candidate(spark, of("A", 1, "X"), of("B", 2, "X", "Y"), of("C", 3, "Z"), of("D", 3), of("A", 9, "X"), of("C", 10, "Z"), of("C", 10, "Z"), of("A", 20, "X"))
    # c2 has one neighbour without a common weakness, which is no evidence; c4 has two.
    assert said(ind.agreement_votes(c)) == {"c0": 1, "c1": 1, "c4": 0}


def test_flow_density_and_rarity(spark):
    f = lambda rule, ln, engine, txt, path="f": (rule, path, ln, 1, 2, txt, [], engine, "any")
    lines = [f"only {'x' * i}" for i in range(130)] + ["same 7"] * 100 + ["twice"] * 2
    files = spark.createDataFrame([("f", "\n".join(lines)), ("short", "a\nb"), ("empty", None)], "path string, text string")
    c = candidate(spark, f("T", 3, "taint", lines[2]), f("T", 4, "pattern", lines[3]), f("T", 5, "taint", "twice"), f("U", 6, "pattern", "same 9"), *(f("W", i, "pattern", "twice") for i in range(60)), f("U", 1, "pattern", "a", "short"))
    tainted = spark.createDataFrame([("T",)], "rule_id string")
    paths = spark.createDataFrame([("f#1", "f#3"), ("f#2", "f#3")], "source string, sink string")
    assert said(ind.flow_votes(c, tainted, paths)) == {"c0": 1, "c1": 0}
    density = said(ind.density_votes(c, files))
    assert density["c3"] == 1 and density["c4"] == 0 and "c0" not in density and "c64" not in density
    assert said(ind.rarity_votes(c, files)) == {"c0": 1, "c1": 1, "c3": 0, "c64": 1}
    none = candidate(spark, f("T", 1, "taint", "x")).limit(0)
    assert ind.stacked({"a": ind.rarity_votes(none, files), "b": ind.comment_votes(none, files.withColumn("profile", F.lit("conf")))}).count() == 0


def test_induced_cases_and_verdicts(spark):
    rng = random.Random(9)
    votes, rows = [], []
    for i in range(120):
        truth = rng.random() < {"R0": 0.97, "R1": 0.6, "R2": 0.1}[f"R{i % 3}"]
        rows.append((f"c{i}", f"R{i % 3}", f" code {i} "))
        for v, right in (("a", 0.95), ("b", 0.9), ("c", 0.9), ("d", 0.85), ("e", 0.6)):
            if rng.random() < 0.8:
                votes.append((f"c{i}", v, int((rng.random() < right) == truth)))
    rows.append(("alone", "R9", "x"))
    c = spark.createDataFrame(rows, "candidate string, rule_id string, txt string")
    labels, verdicts, voters = ind.induce(c, spark.createDataFrame(votes, "candidate string, voter string, vote int"))
    p, _ = plain_label_model(votes)
    n = Counter(x for x, _, v in votes if v is not None)
    want = {x: ("match" if p[x] >= 0.9 else "no_match" if p[x] <= 0.1 else None) if n[x] >= 2 else None for x, _, _ in rows}
    got = {r.candidate: r for r in labels.collect()}
    assert {k: r.expected for k, r in got.items()} == want and Counter(want.values())["match"] > 20
    assert {k: r.p for k, r in got.items() if k in p} == pytest.approx(p) and got["alone"].p is None and got["c3"].code == "code 3"
    by_rule = defaultdict(list)
    for x, rule, _ in rows:
        by_rule[rule].append(want[x])
    for r in verdicts.collect():
        yes, no = by_rule[r.rule_id].count("match"), by_rule[r.rule_id].count("no_match")
        share = yes / (yes + no) if yes + no else None
        verdict = "no-evidence" if len(by_rule[r.rule_id]) < 5 or share is None else "approve" if share >= 0.85 else "review" if share >= 0.5 else "quarantine"
        assert (r.candidates, r.confirmed, r.refuted, r.verdict) == (len(by_rule[r.rule_id]), yes, no, verdict)
    assert {r.voter for r in voters.collect()} == set("abcde")


def test_mined_rules(spark):
    cases = [("F", i, f"call evalCode(input{i}, unsafe_mode)\nother Shared", True) for i in range(4)] + [("F", 10 + i, f"call safeCode(input{i}) shared", False) for i in range(3)]
    cases += [("few", 1, "abc", True), ("few", 2, "xyz", False), ("good", 1, "abc", False), ("good", 2, "abc", False), ("good", 3, "abc", False), ("good", 4, None, False)]
    df = spark.createDataFrame(cases, "family string, case_id int, code string, bad boolean")
    got = {(r.a, r.b): r for r in mining.synthesize(df).collect()}
    # "call" and "shared" stand in good cases, "other" is on another line than the rest, so no pair with it holds.
    assert set(got) == {("evalcode", None), ("other", None), ("unsafe_mode", None), ("evalcode", "unsafe_mode")}
    assert all(r.family == "F" and (r.tp, r.fp, r.fn, r.f1) == (4, 0, 0, 1.0) for r in got.values())
    assert got["evalcode", None].nth == 1 and got["evalcode", "unsafe_mode"].nth == 4
    assert mining.synthesize(df.limit(0)).count() == 0


def test_pairs_are_bounded_and_frequent(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    df = spark.createDataFrame([("F", i, " ".join(words), True) for i in range(5)] + [("F", 9, "none", False)], "family string, case_id int, code string, bad boolean")
    kinds = Counter(r.b is None for r in mining.synthesize(df).collect())
    assert kinds == {True: 60, False: mining.MOST_PAIRS}


def plain_evolution(cases, generations):
    def apply(rule, spec):
        regex, unless = rule
        _, _, kind, value = spec
        if kind == "append_regex_alt":
            return (f"{regex}|{value}" if regex else value), unless
        if kind == "replace_in_regex":
            return regex.replace(*value.split("=>"), 1), unless
        return regex, value if kind == "set_unless" or not unless else f"{unless}|{value}"

    out = {}
    for rule_id, regex, unless in RULES:
        pool, own = [s for s in SPECS if s[0] == rule_id], [c for c in cases if c[0] == rule_id]

        def score(mask, pool=pool, own=own, start=(regex, unless)):
            rule = start
            for i, s in enumerate(pool):
                if mask >> i & 1:
                    rule = apply(rule, s)
            hit = [bool(re.search(rule[0], c[2])) and not (rule[1] and re.search(rule[1], c[2])) for c in own]
            tp, fp, fn = (sum(h is a and c[3] is b for h, c in zip(hit, own, strict=True)) for a, b in ((True, True), (True, False), (False, True)))
            p, r = tp / (tp + fp) if tp + fp else 1.0, tp / (tp + fn) if tp + fn else 1.0
            f1 = 2 * p * r / (p + r) if p + r else 0.0
            return round(1000 * f1 + 10 * p + 1 - bin(mask).count("1") / (len(pool) + 1), 6)

        seen = {m: (0, score(m)) for m in {0, 2 ** len(pool) - 1, *(1 << i for i in range(len(pool)))}}
        for g in range(1, generations + 1):
            top = sorted(seen, key=lambda m: (-seen[m][1], m))[:4]
            for m in {m ^ 1 << i for m in top for i in range(len(pool))} - set(seen):
                seen[m] = (g, score(m))
        out |= {(rule_id, m): x for m, x in seen.items()}
    return out


def test_evolution(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the ", "the zoo", " la ", "de", "dem", "fou", "q", "xx", "7", "ende", "or "])
    cases = [(r, i, "".join(word() for _ in range(4)), rng.random() < 0.5) for r in ("R1", "R2") for i in range(60)]
    df = spark.createDataFrame(cases, "rule_id string, case_id int, code string, truth boolean")
    rules, specs = spark.createDataFrame(list(RULES), "rule_id string, regex string, unless string"), spark.createDataFrame(list(SPECS), "rule_id string, id int, kind string, value string")
    tables, decided = ev.evolve(rules, specs, df, generations=3)
    got = {(r.rule_id, r["mask"]): (r.generation, r.fitness) for t in tables for r in t.collect()}
    assert got == plain_evolution(cases, 3)
    assert sum(t.count() for t in tables) == len(got)
    for r in decided.collect():
        assert r.f1 >= r.base_f1 and r.decision in ("no-gain", "imprecise", "regression", "promoted")


def test_promotion_needs_no_regression(spark):
    rules = spark.createDataFrame([("P", "aa", None), ("Q", "aa", None), ("S", "aa", None)], "rule_id string, regex string, unless string")
    specs = [("P", 1, "append_regex_alt", "bb"), ("P", 2, "append_regex_alt", "("), ("Q", 1, "replace_in_regex", "aa=>bb")]
    cases = [("P", 1, "aa", True), ("P", 2, "bb", True), ("P", 3, "cc", False), ("Q", 1, "aa", True), ("Q", 2, "bb", True), ("Q", 3, "bb", True), ("S", 1, "aa", True)]
    _, decided = ev.evolve(rules, spark.createDataFrame(specs, "rule_id string, id int, kind string, value string"), spark.createDataFrame(cases, "rule_id string, case_id int, code string, truth boolean"))
    got = {r.rule_id: (r.decision, r["mask"], r.regressions) for r in decided.collect()}
    assert got == {"P": ("promoted", 1, 0), "Q": ("regression", 1, 1)}


def plain_anomalies(points, z_min=2.0):
    n = len(points)
    if n < 8:
        return {}
    m = np.array([p for _, p in points], float)
    m = m * (np.log((n + 1) / ((m > 0).sum(axis=0) + 1)) + 1)
    m = m / np.where(np.linalg.norm(m, axis=1) > 0, np.linalg.norm(m, axis=1), 1)[:, None]
    k = max(2, min(12, math.floor(math.sqrt(n / 2) + 0.5)))
    c = [m[0]]
    while len(c) < k:
        c.append(m[max(range(n), key=lambda i: (min(np.linalg.norm(m[i] - x) for x in c), -i))])
    for _ in range(50):
        own = [min(range(k), key=lambda j: (np.linalg.norm(v - c[j]), j)) for v in m]
        c = [m[[o == j for o in own]].mean(axis=0) if j in own else c[j] for j in range(k)]
    patterns = [c[j] for j in range(k) if own.count(j) >= max(2, n // 20)]
    if not patterns:
        return {}
    d = np.array([min(np.linalg.norm(v - x) for x in patterns) for v in m])
    if d.std() <= 1e-12:
        return {}
    return {i: z for (i, _), z in zip(points, (d - d.mean()) / d.std(), strict=True) if z >= z_min}


def test_anomalies(spark):
    rng = np.random.default_rng(1)
    points = [(i, (np.eye(6)[i % 2] * 3 + rng.random(6) * 0.3).tolist()) for i in range(40)] + [(40, [0.0] * 5 + [9.0]), (41, [0.0] * 3 + [9.0, 0.0, 0.0])]
    df = lambda rows: spark.createDataFrame(rows, "id int, vec array<double>")
    want = plain_anomalies(points)
    assert {r.id: r.z for r in ln.anomalies(df(points)).collect()} == pytest.approx(want) and {40, 41} >= set(want) and want
    assert ln.anomalies(df(points[:7])).count() == 0
    assert ln.anomalies(df([(i, [1.0, 2.0]) for i in range(20)])).count() == 0
    assert ln.anomalies(df([])).count() == 0


def test_confident_joint(spark):
    rows = [(i, 1, 0.9) for i in range(8)] + [(8, 1, 0.05)] + [(9 + i, 0, 0.1) for i in range(4)] + [(13, 0, 0.97), (14, None, 0.5), (15, 0, None)]
    got = {(r.given, r.likely): r for r in ln.confident_joint(spark.createDataFrame(rows, "id int, label int, prob double")).collect()}
    assert {k: r.counted for k, r in got.items()} == {(0, 0): 4, (0, 1): 1, (1, 0): 1, (1, 1): 8}
    assert all(r.noise == round(2 / 14, 6) for r in got.values()) and sum(r.share for r in got.values()) == pytest.approx(1)
    empty = ln.confident_joint(spark.createDataFrame([], "id int, label int, prob double")).collect()
    assert len(empty) == 4 and all(r.counted == 0 and r.noise == 0 for r in empty)


@pytest.mark.parametrize("tile", [1024, 30])
def test_similar_pairs_lose_none(spark, monkeypatch, tile):
    monkeypatch.setattr(similarity, "TILE", tile)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 16))
    rows = [(i, int(i % 3), (centres[rng.integers(20)] * rng.uniform(0.5, 2) + rng.standard_normal(16) * rng.choice([0.1, 0.3])).tolist()) for i in range(600)]
    rows += [(600, 0, [0.0] * 16), (601, None, rows[0][2]), (602, 0, None), (603, 0, rows[0][2])]
    rows += [(700 + i, 1, rows[1][2]) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, label int, vec array<double>")
    first = {}
    for i, y, v in rows:
        if y is not None and v is not None and any(v):
            first.setdefault((y, tuple(v)), []).append(i)
    usable = [(min(ids), y, np.array(v) / np.linalg.norm(v)) for (y, v), ids in first.items()]
    copies = {(y, min(ids), i) for (y, _), ids in first.items() for i in ids if i != min(ids)}
    want = {(y, a, b): round(float(u @ v), 6) for (a, y, u), (b, z, v) in itertools.combinations(usable, 2) if y == z and round(float(u @ v), 6) >= 0.9}
    found = similarity.similar_pairs(df).collect()
    got = {(r.label, r.a, r.b): r.cosine for r in found if not r.copy}
    assert got == pytest.approx(want, abs=2e-6) and len(want) > 1000
    assert {(r.label, r.a, r.b) for r in found if r.copy} == copies and len(copies) == 51 and len(found) == len(want) + 51
    per_label = Counter(y for _, y, _ in usable)
    assert similarity.multiplied(df) < 2 * len(want) < sum(n * (n - 1) / 2 for n in per_label.values())
    nested = df.withColumn("file", F.lit(1)).withColumn("start", F.col("id")).withColumn("end", F.lit(1000))
    assert similarity.similar_pairs(nested).count() == 0 and similarity.similar_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile, at_once", [(1024, 65_536), (30, 7)])
def test_similar_units_are_all_their_pairs(spark, monkeypatch, tmp_path, tile, at_once):
    """Copies and near copies, of which some lie inside others or at one place, pair by pair and as the SQL has them."""
    monkeypatch.setattr(similarity, "TILE", tile)
    monkeypatch.setattr(similarity, "AT_ONCE", at_once)
    rng = np.random.default_rng(12)
    copy, near = rng.standard_normal(16), rng.standard_normal(16)
    vectors = [copy if i % 3 == 0 else near + 0.05 * rng.standard_normal(16) if i % 3 == 1 else rng.standard_normal(16) for i in range(400)]
    rows = [(i, [float(x) for x in v.astype(np.float32)], None if i % 50 == 7 else i % 2) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    units = [(i, y, np.array(v) / np.linalg.norm(v), (i % 4, i % 9, i % 9 + i % 5)) for i, v, y in rows if y is not None]
    inside = lambda p, q: p[0] == q[0] and q[1] <= p[1] and p[2] <= q[2]
    want = {(y, a, b) for (a, y, u, p), (b, z, v, q) in itertools.combinations(units, 2) if y == z and round(float(u @ v), 6) >= 0.9 and not inside(p, q) and not inside(q, p)}
    got = [(r.label, r.a, r.b) for r in all_plans()[0]["j18_similar_pairs"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) > 6_000
    assert sum(a % 3 == b % 3 == 0 for _, a, b in got) > 3_000 and (0, 0, 180) not in want and (0, 0, 186) in want
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(all_plans()[1]["j18_similar_pairs"]).fetchall()) == sorted(got)


def test_units_at_one_place_have_pairs_with_others(spark):
    rows = [(i, 0, [1.0, 2.0], "f", 5, 9) for i in range(3)] + [(3, 0, [1.0, 2.0], "g", 5, 9), (4, 0, [1.0, 2.1], "f", 6, 8)]
    df = spark.createDataFrame(rows, "id int, label int, vec array<double>, file string, start int, end int")
    assert sorted((r.a, r.b, r.copy) for r in similarity.similar_pairs(df).collect()) == [(0, 3, False), (1, 3, False), (2, 3, False), (3, 4, False)]


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), None])
@pytest.mark.parametrize("places", [True, False])
def test_odd_vectors_take_no_pair_from_others(spark, odd, places):
    rows = [(i, 0, [1.0, 0.01 * i]) for i in range(5)] + [(5 + i, 0, [odd, 1.0]) for i in range(5)] + [(None, 0, [1.0, 0.5]), (None, 0, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "id int, label int, vec array<double>")
    if places:
        df = df.withColumn("file", F.col("id")).withColumn("start", F.lit(1)).withColumn("end", F.lit(2))
    assert sorted((r.a, r.b) for r in similarity.similar_pairs(df).collect()) == list(itertools.combinations(range(5), 2))


def test_sides_of_a_tile_come_in_any_order():
    """Fetched blocks of a shuffle arrive in any order, so place 3 of one side may be place 7 of the other."""
    rng = np.random.default_rng(4)
    tile = pd.DataFrame({"id": range(40), "vec": list(rng.standard_normal(8) + 0.1 * rng.standard_normal((40, 8)))})
    turned = tile.sample(frac=1, random_state=5).reset_index(drop=True)
    at, of, _, _ = similarity.verified(tile, turned, True, np.eye(8)[:, :3], 0.5)
    assert sorted(zip(tile["id"][at], turned["id"][of])) == list(itertools.combinations(range(40), 2))


def test_little_is_multiplied_out_of_random_vectors(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, 0, rng.standard_normal(64).tolist()) for i in range(800)], "id int, label int, vec array<double>")
    assert similarity.multiplied(df) < 800 * 799 / 2 / 100
