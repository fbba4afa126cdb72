"""Nearest neighbours against brute force: exact where one part is left, recall and exact scores elsewhere."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import ann
from siltstone.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, cand string, ids string"


def brute(rows, k=20, every=20):
    """(query, [(score, id)...]) of each query row, by row and not by id."""
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    length = max(Counter(len(v) for _, v in ok).items(), key=lambda x: (x[1], x[0]), default=(0,))[0]
    ok = [x for x in ok if len(x[1]) == length]
    ids, m = np.array([x[0] for x in ok]), np.array([x[1] for x in ok])
    out = []
    for n, (i, v) in enumerate(ok):
        if i % every == 0:
            s = (m * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if j != n][:k]
            out.append((i, [(float(s[j]), int(ids[j])) for j in order]))
    return out


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r["rank"], r.score, r.vec_id))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y", "z") for i, v in rows], SCHEMA)


def by_twenty(c):
    return c % 20 == 0


def odd_rows():
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 4)) for i in range(300)]  # few distinct vectors, many ties
    bad = [None, [], [0, 0, 0, 0], [1, None, 0, 0], [float("nan"), 1, 1, 1], [float("inf"), 1, 1, 1], [1, 2, 3], [-0.0, 0.0, 1, 1], [0.0, -0.0, 1, 1]]
    return rows + [(1000 + 20 * i, v) for i, v in enumerate(bad)] + [(None, [1, 1, 1, 1]), (-40, [1, 1, 1, 1])]


@pytest.mark.parametrize("rows", [odd_rows(), [(20, [1, 0])], [(20, [1, 0]), (21, [1, 0]), (40, [0, 1])], [(i, [1, 2]) for i in range(200)]])
def test_exact_with_one_part(spark, rows):
    got = answers(ann.search(frame(spark, rows), by_twenty))
    want = {i: near for i, near in brute(rows) if near}
    assert set(got) == set(want)
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, len(near) + 1))
        assert [(s, i) for _, s, i in near] == want[q]


def test_rows_that_share_an_id(spark):
    rows = [(20, [1, 0]), (20, [1, 0]), (20, [0.5, 0]), (7, [0.25, 1])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame(spark, rows), by_twenty).collect())
    want = sorted((i, n + 1, j, s) for i, near in brute(rows) for n, (s, j) in enumerate(near))
    assert got == want and len(got) == 9


def test_recall_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "HELD", 500)
    monkeypatch.setattr(ann, "QUERIES", 50)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16)) * 2
    rows = [(i, centres[rng.integers(30)] + rng.standard_normal(16) * 0.5) for i in range(8000)] + [(8000 + i, centres[0]) for i in range(3000)]
    got, want = answers(ann.search(frame(spark, rows), by_twenty)), dict(brute(rows))
    assert set(got) == set(want)
    hits = [len({i for _, _, i in got[q]} & {i for _, i in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    vec = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, near in got.items():
        assert len(near) == 20 and len({i for _, _, i in near}) == 20
        for _, s, i in near:
            assert s == pytest.approx(float(vec[q] @ vec[i]), abs=1e-12)
        assert near == sorted(near, key=lambda x: (-x[1], x[2]))
    assert Counter((q, *x) for q, n in got.items() for x in n) == Counter((q, *x) for q, n in answers(ann.search(frame(spark, rows).repartition(5), by_twenty)).items() for x in n)


def test_parts_are_balanced_and_cut_little():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.standard_normal((100, 8)) * 0.1 + np.eye(8)[i] * 3 for i in range(8)])
    near = ann.nearest(points, points, 10, own=True)
    a, b = np.repeat(np.arange(800), 10), near.ravel()
    edges = np.unique(np.concatenate([a * 800 + b, b * 800 + a]))
    part = ann.balanced_parts(800, edges // 800, edges % 800, 8, rng)
    assert Counter(np.bincount(part).tolist()) == {100: 8}
    assert (part[a] == part[b]).mean() > 0.9
    router = ann.fit_router(points, 8, 5)
    assert router.probes <= 2  # clusters far apart need few parts


def test_query_of_the_given_table(spark):
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = dict(brute([(r.vec_id, r.embedding) for r in t]))
    got = answers(QUERIES["op11_learned_partitions"](spark, sf))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert np.mean([len({i for _, _, i in got[q]} & {i for _, i in want[q]}) / 20 for q in want]) >= 0.9


def test_empty(spark):
    assert ann.search(spark.createDataFrame([], SCHEMA), by_twenty).count() == 0
    assert ann.search(frame(spark, [(20, None), (40, [0.0])]), by_twenty).count() == 0
    assert ann.search(frame(spark, [(3, [1, 1]), (5, [1, 1])]), by_twenty).select(F.count("*")).first()[0] == 0
