"""The similarity join against all pairs compared in plain Python."""

import random
import re
from collections import Counter

import pytest

from siltstone.llm import ngram_join
from tests.llm.cases import DOCS, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent):
    sets = [shingles(r[1], k) for r in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return Counter((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


def copies(seed, n=150):
    """Chains and groups of edited copies, and a passage that many texts share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(25)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, len(words) // 40 + 1])):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 30)}"
            if rng.random() < 0.3:
                words = words[: max(1, int(len(words) * 0.93))]
        else:
            words = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([2, 5, 20, 60, 150]))]
            if rng.random() < 0.6:
                at = rng.randint(0, len(words))
                words[at:at] = passage
        out.append((1000 - i, " ".join(words), "en", "s", 0, None, None))
    return out


@pytest.mark.parametrize("rows,k,percent", [(copies(1), 4, 85), (copies(2), 5, 80), (documents(), 4, 85)])
def test_components(spark, rows, k, percent):
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS), k, percent).collect()
    assert Counter(tuple(r)[:3] for r in got) == brute(rows, k, percent)
    assert len({r.component_id for r in got}) < len(rows) - 5


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rows = copies(3, 80)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 85).collect()
    assert Counter(tuple(r)[:3] for r in got) == brute(rows, 4, 85)


def test_tiles_in_parts(spark, monkeypatch):
    """Common shingles whose tiles have many parts."""
    monkeypatch.setattr(ngram_join, "PART_TEXTS", 3)
    for seed in (4, 5):
        rows = copies(seed)
        got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 85).collect()
        assert Counter(tuple(r)[:3] for r in got) == brute(rows, 4, 85)


def test_nothing_is_similar(spark):
    rows = [(i, " ".join(f"x{i}y{j}" for j in range(30)), "en", "s", 0, None, None) for i in range(20)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 85).collect()
    assert Counter(tuple(r)[:3] for r in got) == brute(rows, 4, 85)


def test_bound_is_never_below_the_overlap(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows, common = [], []
    for i in range(60):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 3000), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.3, 0.95])], rng.integers(0, 2**63, rng.integers(0, 400), dtype=np.uint64)]))
        rows.append((i, len(a), len(b), ngram_join.signature(a).tolist(), ngram_join.signature(b).tolist()))
        common.append(len(np.intersect1d(a, b)))
    df = spark.createDataFrame(rows, "i int, n_a long, n_b long, signature_a array<long>, signature_b array<long>").withColumn("bound", ngram_join.overlap_bound())
    bounds = [r.bound for r in df.orderBy("i").collect()]
    assert all(x >= y for x, y in zip(bounds, common, strict=True))
    assert any(len(r[3]) != len(r[4]) for r in rows)
    assert sum(x <= y + 0.7 * (min(r[1], r[2]) - y) + 2 for x, y, r in zip(bounds, common, rows, strict=True)) > 50


def test_empty(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_chains(spark, tmp_path):
    from siltstone.llm.components import connected_components
    from siltstone.llm.scratch import Scratch

    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + rng.randint(0, 30), 200 + rng.randint(0, 30)) for _ in range(40)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        top[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, Scratch(spark), "t").collect()}
    assert got == {x: find(x) for x in {y for p in links for y in p if p[0] != p[1]}}
    with pytest.raises(RuntimeError):
        connected_components(df, Scratch(spark), "u", max_rounds=1)
    assert connected_components(df.limit(0), Scratch(spark), "e").count() == 0
