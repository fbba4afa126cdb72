"""The mix against plain Python: targets by repeated sharing, seats by highest quotients, words near the targets."""

import heapq
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing
from tests.llm.cases import DOCS, documents


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def case(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "B", "\U0001f600", "é", None, "tiny"] if i % 20 == 0 else ["a", "b", "c"])
        out.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 10, 300, 2000]))), "en", source, 0, None, None))
    return out + [(i, r[1], "en", r[3], 0, None, None) for i, r in enumerate(out[:3])]


@pytest.mark.parametrize("rows", [case(1), case(2), documents()])
def test_mix(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 5000)
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r[0], r[3], size(r[1])) for r in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.02 * t), (s, taken[s], t)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df.repartition(7)).collect()))


@pytest.mark.parametrize("seed", range(6))
def test_highest_quotients(spark, seed):
    rng = random.Random(seed)
    votes = [(i, float(rng.choice([0, 1, 5, 1000, 1000, rng.randint(1, 10**6)]))) for i in range(rng.choice([1, 3, 40]))]
    seats = rng.choice([0, 1, 7, 500, 5000])
    df = spark.createDataFrame(votes, "party int, v double")
    got = {r.party: r.quota for r in mixing.apportion(df, F.lit(seats).cast("long"), "v", [], [F.col("party")]).collect()}
    want, heap = Counter(), [(-v, p, 0) for p, v in votes if v > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, p, k = heapq.heappop(heap)
        want[p] += 1
        heapq.heappush(heap, (-votes[p][1] / (2 * k + 3), p, k + 1))
    assert got == {p: want[p] for p, _ in votes}


@pytest.mark.parametrize("seed", range(4))
def test_deal_by_halving_is_the_same(spark, seed, monkeypatch):
    rng = random.Random(seed)
    votes = [(f"s{i}", float(rng.choice([0, 1, 5, 1000, 1000, rng.randint(1, 10**6)]))) for i in range(60)] + [(None, 7.0)]
    df = spark.createDataFrame(votes, "source string, v double")
    order = [F.col("source").asc_nulls_last()]
    for seats in (1, 40, 777, 10**7):
        want = {r.source: r.quota for r in mixing.apportion(df, F.lit(seats).cast("long"), "v", [], order).collect()}
        monkeypatch.setattr(mixing, "RANKED", 3)
        assert {r.source: r.quota for r in mixing.dealt(df, seats, "v", order).collect()} == want and sum(want.values()) == seats
        monkeypatch.undo()


def test_all_sources_are_in_one_deal(spark):
    """At the default sizes, on the given tables: quotas of all sources and shards come from highest quotients."""
    seen = []
    for sf in ("sf0.001", "sf0.01"):
        df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
        total = sum(r.target for r in got)
        votes, quota = {r.source: r.target for r in got}, Counter()
        heap = [(-v, s or "", s, 0) for s, v in votes.items() if v > 0]
        heapq.heapify(heap)
        assert total < mixing.DEALT  # a block is a word
        for _ in range(round(total)):
            _, name, s, k = heapq.heappop(heap)
            quota[s] += 1
            heapq.heappush(heap, (-votes[s] / (2 * k + 3), name, s, k + 1))
        assert {r.source: r.taken for r in got} == {s: quota[s] for s in votes}
        seen.append(len(got))
    assert min(seen) > 3


@pytest.mark.parametrize("dealt", [2000, 8000])
def test_small_sources_share_what_their_party_wins(spark, dealt, monkeypatch):
    monkeypatch.setattr(mixing, "DEALT", dealt)
    monkeypatch.setattr(mixing, "BLOCKS", 64)
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([1, 5, 40]), "en", rng.choice(["big"] * 30 + [f"s{k}" for k in range(12)] + [None]), 0, None, None) for i in range(900)] + [(900, "", "en", "none", 0, None, None)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"]
    assert len(got) == 901 and all(abs(taken[s] - t) <= max(3, 0.05 * t) for s, t in target.items()), (taken, target)


def test_native_and_empty(spark):
    df = spark.createDataFrame(documents(), DOCS)
    assert "Python" not in mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    none = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(none).collect()] == [(0, 0.0)] * 2
