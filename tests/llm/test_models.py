"""Toxicity and language-model scoring: held-out accuracy, the estimator's properties, brute-force recursion."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import lattice_lm, toxicity
from tests.llm.cases import DOCS, documents

BAD = ["grumpf", "zorkish", "blathen"]


def toxic_case(n=900):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randint(0, 200)}" for _ in range(rng.randint(5, 80))]
        y = rng.random() < 0.2
        if y:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "s", "ing", ","])
        docs.append((i, " ".join(words), "en", "s", 0, None, None))
        if i % 2 == 0:
            labels.append((i, 1, int(y)))
    return docs, labels


def test_toxicity_on_held_out(spark):
    docs, labels = toxic_case()
    labels += [labels[0], (None, 1, 1), (5, None, None)]
    extra = [(5000, None, None, None, 0, None, None), (5001, "", "en", "s", 0, None, None), (None, "w1 grumpf", "en", "s", 0, None, None), docs[3]]
    df = spark.createDataFrame(docs + extra, DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(df.withColumn("score", F.lit(0.7)).withColumn("predicted", F.lit("mine")), lab)
    rows = out.select("doc.*").collect()
    assert all(r.score == 0.7 and r.predicted == "mine" for r in rows) and sorted(rows[0].asDict()) == sorted([*df.columns, "score", "predicted"])
    out = out.select("doc.doc_id", "score", "predicted")
    got = {r.doc_id: (r.score, r.predicted) for r in out.collect()}
    truth = {r[0]: any(w.startswith(tuple(BAD)) for w in r[1].split()) for r in docs}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i][1] == truth[i] for i in held]) > 0.95
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p in got.values())
    assert got[5000][1] == got[5001][1] == 0 and got[None][1] == 1


def test_held_out_rule(spark):
    rows = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_no_labels(spark):
    df = spark.createDataFrame(documents(), DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 1e-9 and r.predicted == 0 for r in toxicity.score_documents(df, none).collect())
    assert toxicity.score_documents(spark.createDataFrame([], DOCS), none).count() == 0


def test_risk_is_not_negative_and_falls():
    rng = random.Random(1)
    positive = [[0, rng.randint(2, 40)] for _ in range(60)]
    unlabelled = [[1, rng.randint(2, 40)] for _ in range(240)] + [[0, rng.randint(2, 40)] for _ in range(60)]
    w, bias, risks = toxicity.train_nnpu(positive, unlabelled, 41, 0.2)
    assert min(risks) >= 0 and risks[-1] < risks[0] / 2
    assert w[0] + bias > 0 > w[1] + bias


def brute_scores(rows):
    tokens = {i: (r[1] or "").encode().lower().split() for i, r in enumerate(rows)}
    held = {i: zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 10 == 0 for i, r in enumerate(rows)}
    c = Counter(t for i in tokens if not held[i] for t in [*tokens[i], None])
    total, v = sum(c.values()), len(c)
    out = []
    for i, r in enumerate(rows):
        mine = [*tokens[i], None]
        base = sum(math.log10((c[t] + 0.1) / (total + 0.1 * (v + 1))) for t in mine)
        out.append((r[0], held[i], len(mine), sum(c[t] > 0 for t in mine), total, round(base, 6)))
    return Counter(out)


@pytest.mark.parametrize("head", [300_000, 20])
def test_lattice_scores(spark, head):
    rows = documents()
    got = lattice_lm.score_documents(spark.createDataFrame(rows, DOCS), head=head).collect()
    assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in got) == brute_scores(rows)
    assert all(r.score < 0 for r in got)
    same = {round(r.score, 8) for r in got if r.doc_id in (100, 101, 102)}
    assert len(same) == 1


def test_head_and_tail_agree(spark):
    df = spark.createDataFrame(documents(), DOCS)
    a, b = (Counter((r.doc_id, round(r.score, 6)) for r in lattice_lm.score_documents(df, head=h).collect()) for h in (5, 300_000))
    assert a == b


def test_lattice_sums_all_segmentations():
    pieces, logs = lattice_lm.load_pieces(lattice_lm.VOCABULARY)
    lattice = lattice_lm.Lattice(pieces, logs)
    weights = dict(zip(pieces, logs, strict=True))
    words = [w.encode() for w in ["the", "a", "segmentation", "ünïcödé", "\U0001f600", "x" * 200, "abcdefghijklmnopqrstuvwxyz" * 3, ""]] + [b"\xff\x00\x01"]
    got = lattice.log_probability(words)
    assert np.allclose(got, [lattice_lm.brute_log_probability(w, weights) for w in words])
    assert abs(np.exp(logs).sum() - 1) < 1e-9
    counts = lattice.expected([b"the", b"them"], np.array([2.0, 1.0]))
    letters = sum(n * len(p) for n, p in zip(counts, pieces, strict=True))
    assert abs(letters - (2 * 4 + 5)) < 1e-6


def test_lattice_empty(spark):
    assert lattice_lm.score_documents(spark.createDataFrame([], DOCS)).count() == 0


LONG = ["漢字仮名交じり文の長い行です" * 12, "https://example.org/" + "segmentation-of-the-words/" * 8, "ที่นี่ไม่มีช่องว่าง" * 9, "x" * 63, "x" * 64, "a" * 1000]


def whole_log_probability(word, weights):
    """By scaled sums over the whole word, apart from the module's own code."""
    sums, scale = [1.0], 0.0
    for end in range(1, len(word) + 1):
        sums.append(sum(sums[a] * math.exp(weights[word[a:end]]) for a in range(max(0, end - 80), end) if word[a:end] in weights))
        scale += math.log(sums[-1])
        sums = [x / sums[-1] for x in sums]
    return scale


def test_long_words_are_not_cut():
    pieces, logs = lattice_lm.load_pieces(lattice_lm.VOCABULARY)
    lattice = lattice_lm.Lattice(pieces, logs)
    weights = dict(zip(pieces, logs, strict=True))
    words = [w.encode() for w in LONG]
    got = lattice.log_probability(words)
    assert np.allclose(got, [whole_log_probability(b" " + w, weights) for w in words], rtol=1e-10)
    for w in words:
        counts = lattice.expected([w], np.array([3.0]))
        assert abs(sum(n * len(p) for n, p in zip(counts, pieces, strict=True)) - 3 * (len(w) + 1)) < 1e-5


def test_chain_equals_table():
    pieces, logs = lattice_lm.load_pieces(lattice_lm.VOCABULARY)
    lattice = lattice_lm.Lattice(pieces, logs)
    words = [w.encode() for w in ("segmentation", "ünïcödé", "漢字", "a", "")]
    marked = [b" " + w for w in words]
    assert np.allclose([lattice.along(len(m), *lattice.chain(m))[-1] for m in marked], lattice.log_probability(words))
    table = lattice.expected(words, np.ones(len(words)))
    keep, lattice_lm.LONGEST = lattice_lm.LONGEST, 0
    try:
        assert np.allclose(lattice.expected(words, np.ones(len(words))), table)
    finally:
        lattice_lm.LONGEST = keep
