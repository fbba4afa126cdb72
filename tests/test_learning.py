"""Iterative operators against plain Python, at their own number of rounds."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from siltstone.operators import learning as ln


def plain_stumps(rows, n_features, rounds=40, rate=0.15):
    y = np.array([r[0] for r in rows], float)
    x = np.array([r[1:] for r in rows], float)
    p = min(1 - 1e-6, max(1e-6, y.mean()))
    score = np.full(len(y), math.log(p / (1 - p)))
    stumps = []
    for _ in range(rounds):
        res = y - 1 / (1 + np.exp(-score))
        best = None
        for f in range(n_features):
            values = sorted(set(x[:, f]))
            for a, b in zip(values, values[1:]):
                left = x[:, f] <= a
                gain = round(res[left].sum() ** 2 / left.sum() + res[~left].sum() ** 2 / (~left).sum(), 9)
                if best is None or gain > best[0]:
                    best = (gain, f, (a + b) / 2, res[left].mean(), res[~left].mean())
        if best is None:
            break
        _, f, t, left, right = best
        stumps.append((f, t, left, right))
        score += rate * np.where(x[:, f] < t, left, right)
    return math.log(p / (1 - p)), stumps


def examples(seed, n=120):
    rng = random.Random(seed)
    return [(int(rng.random() < (0.8 if a > 4 else 0.2)), float(a), float(b)) for a, b in ((rng.randint(0, 9), rng.choice([0.0, 0.5, 2.5])) for _ in range(n))]


def test_stumps(spark):
    rows = examples(1)
    model = ln.train_stumps(spark.createDataFrame(rows, "label int, a double, b double"), ["a", "b"])
    base, want = plain_stumps(rows, 2)
    assert model["base"] == pytest.approx(base) and len(model["stumps"]) == 40
    for (name, t, left, right), (f, wt, wl, wr) in zip(model["stumps"], want, strict=True):
        assert (name, t) == ("ab"[f], wt) and (left, right) == (pytest.approx(wl), pytest.approx(wr))


def test_stumps_of_several_models(spark):
    rows = examples(2)
    df = spark.createDataFrame([(i % 3, *r) for i, r in enumerate(rows)], "fold int, label int, a double, b double")
    from pyspark.sql import functions as F

    others = F.filter(F.sequence(F.lit(0), F.lit(2)), lambda k: k != F.col("fold"))
    models = ln.train_stumps_many(df.withColumn("_models", others), ["a", "b"], 3, rounds=7)
    for k, model in enumerate(models):
        base, want = plain_stumps([r for i, r in enumerate(rows) if i % 3 != k], 2, 7)
        assert model["base"] == pytest.approx(base)
        assert [(n, t) for n, t, _, _ in model["stumps"]] == [("ab"[f], t) for f, t, _, _ in want]


def test_stumps_with_percentiles(spark, monkeypatch):
    monkeypatch.setattr(ln, "MOST_BINS", 8)
    rows = [(int(i > 500), float(i)) for i in range(1000)]
    model = ln.train_stumps(spark.createDataFrame(rows, "label int, a double"), ["a"], rounds=5)
    assert abs(model["stumps"][0][1] - 500) < 130


def plain_label_model(votes, rounds=50, tolerance=1e-6):
    by = defaultdict(list)
    for c, v, x in votes:
        if x is not None:
            by[c].append((v, x))
    p = {c: sum(x for _, x in vs) / len(vs) for c, vs in by.items()}
    voters = sorted({v for vs in by.values() for v, _ in vs})
    for _ in range(rounds):
        n = {(v, y, x): (3.0 if x == y else 1.0) for v in voters for y in (0, 1) for x in (0, 1)}
        for c, vs in by.items():
            for v, x in vs:
                n[v, 1, x] += p[c]
                n[v, 0, x] += 1 - p[c]
        pi = (sum(p.values()) + 1) / (len(p) + 2)
        new = {}
        for c, vs in by.items():
            a, b = math.log(pi), math.log(1 - pi)
            for v, x in vs:
                a += math.log(n[v, 1, x] / (n[v, 1, 0] + n[v, 1, 1]))
                b += math.log(n[v, 0, x] / (n[v, 0, 0] + n[v, 0, 1]))
            new[c] = 1 / (1 + math.exp(b - a))
        moved = max(abs(new[c] - p[c]) for c in p)
        p = new
        if moved < tolerance:
            break
    return p, n


def test_label_model(spark):
    rng = random.Random(3)
    votes = []
    for c in range(80):
        truth = rng.random() < 0.4
        for v, right in (("a", 0.9), ("b", 0.8), ("c", 0.3), ("d", 0.6)):
            x = rng.random()
            votes.append((c, v, None if x < 0.2 else int((rng.random() < right) == truth)))
    p, confusion = ln.dawid_skene(spark.createDataFrame(votes, "candidate int, voter string, vote int"))
    want, n = plain_label_model(votes)
    assert {r.candidate: r.p for r in p.collect()} == pytest.approx(want)
    assert {(r.voter, r.y): (r.n0, r.n1) for r in confusion.collect()} == {(v, y): (pytest.approx(n[v, y, 0]), pytest.approx(n[v, y, 1])) for v, y, x in n if x == 0}
    state = ln.carried_state(confusion, "a")
    again, c2 = ln.dawid_skene(spark.createDataFrame(votes[:8], "candidate int, voter string, vote int"), state=state)
    assert again.count() == 2 and {r.voter for r in c2.collect()} == {v for _, v, x in votes[:8] if x is not None}
    nothing, _ = ln.dawid_skene(spark.createDataFrame([(1, "a", None)], "candidate int, voter string, vote int"))
    assert nothing.count() == 0


def test_lloyd(spark):
    rng = random.Random(5)
    points = [(i, [rng.gauss(m, 0.4), rng.gauss(-m, 0.4)]) for i in range(60) for m in [(i % 3) * 3.0]]
    assigned, centres = ln.lloyd(spark.createDataFrame(points, "id int, vec array<double>"), 3)
    c = [points[0][1]]
    while len(c) < 3:
        c.append(max(points, key=lambda q: (min(math.dist(q[1], x) for x in c), -q[0]))[1])
    for _ in range(50):
        own = {i: min(range(3), key=lambda k: (math.dist(v, c[k]), k)) for i, v in points}
        c = [list(np.mean([v for i, v in points if own[i] == k], axis=0)) for k in range(3)]
    assert {r.id: r.cluster for r in assigned.collect()} == own
    assert np.allclose(centres, c)
    assert ln.lloyd(spark.createDataFrame([], "id int, vec array<double>"), 3)[0].count() == 0


def test_unsigned_vectors_do_not_cancel(spark):
    bags = spark.createDataFrame([(1, f"t{i}") for i in range(300)], "id int, token string")
    rows = ln.hashed_vectors(bags, "id", "token", 8, signed=False).collect()
    assert len(rows) == 8 and all(r.value > 0 for r in rows) and sum(r.value**2 for r in rows) == pytest.approx(1)


def test_mutations(spark):
    rules = spark.createDataFrame([("R", "a{12,}b{12,}", None), ("S", "", "x")], "rule_id string, regex string, unless string")
    specs = [("R", "1", "append_regex_alt", "c"), ("R", "2", "replace_in_regex", "{12,}=>{16,}"), ("R", "3", "replace_in_regex", "none"), ("R", "4", "set_unless", "u("), ("S", "5", "append_unless_alt", "y"), ("S", "6", "append_regex_alt", "z"), ("R", "7", "odd", "q"), ("R", " ", "set_unless", "u"), ("R", "8", "set_unless", " ")]
    got = {r.id: (r.regex, r.unless, r.safe) for r in ln.mutate(rules, spark.createDataFrame(specs, "rule_id string, id string, kind string, value string")).collect()}
    plain = "a{12,}b{12,}"
    assert got == {
        "1": (plain + "|c", None, True), "2": ("a{16,}b{12,}", None, True), "3": (plain, None, True), "4": (plain, "u(", False), "5": ("", "x|y", True), "6": ("z", "x", True),
        "7": (plain, None, True), " ": (plain, "u", False), "8": (plain, " ", False),
    }
