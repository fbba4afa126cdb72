"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training texts, whatever they are, count as unlabelled. The risk
of a classifier g is estimated with the class prior p as

    p * mean_P loss(g) + max(0, mean_U loss(-g) - p * mean_P loss(-g))

so toxic texts among the unlabelled do not pull the classifier down, and the negative part can't fall below zero.
Numpy classifiers are trained each in a task of its own on a shard of the sample (about ``PER_FOLD`` positives);
their weights are averaged. Features are the presence of words and of word beginnings, with weights made sparse by soft thresholding.

Only training reads a sample: at most ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` unlabelled texts, the ones
with the least hash of their id. Scoring reads every whole text and shuffles nothing; what is broadcast are the
sampled ids and at most MAX_FEATURES weights of each classifier.

Defined cases: null and empty texts get the score of a text without features; a null doc_id is held out; without a
positive example every score is the prior (0 if that is 0); a very long text is scored whole, by the words that it has;
repeated rows each get a result; equal texts of the sample are one example; repeated labels count once, toxic if one
of them is; the caller's columns, ``score`` and ``predicted`` among them, keep their values in ``doc``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.words import give_back

MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 6_000, 24_000, 20_000
#: Positives that a classifier is trained on, about; there are as many classifiers as the sample allows.
PER_FOLD = 1_500
PREFIXES = (4, 5, 6)
#: A feature is in this share of the positives at least, and this many times as common there as among the unlabelled.
LEAST_SHARE, LEAST_LIFT = 0.004, 3.0
STEPS, RATE, SPARSITY = 300, 0.08, 2e-5

#: Lower case for A-Z; ASCII letters, digits and all other bytes stay, the rest of ASCII separates words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that no label may be learned from: crc32 of the id as text, divided by ``folds``, leaves 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def word_set(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").translate(TABLE).split())


def features_of(word: bytes) -> list[bytes]:
    return [b"=" + word, *(b"^" + word[:k] for k in PREFIXES if len(word) >= k)]


def text_features(text: str | None) -> set[bytes]:
    out: set[bytes] = set()
    for w in word_set(text):
        out.update(features_of(w))
    return out


class Sparse:
    """Rows of present features."""

    def __init__(self, rows: list[list[int]], width: int):
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.columns = np.fromiter((c for r in rows for c in r), np.int64, self.at[-1])
        self.owner = np.repeat(np.arange(len(rows)), np.diff(self.at))
        self.n, self.width = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.columns], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, g[self.owner], self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def train_nnpu(positive: list[list[int]], unlabelled: list[list[int]], width: int, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float, list[float]]:
    """Weights, bias and the risk at every step, by Adam on the non-negative risk."""
    p, u = Sparse(positive, width), Sparse(unlabelled, width)
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, risks = np.zeros(width + 1), np.zeros(width + 1), []
    for t in range(1, steps + 1):
        gp, gu = p.dot(w[:-1]) + w[-1], u.dot(w[:-1]) + w[-1]
        good = prior * softplus(-gp).mean()
        bad = softplus(gu).mean() - prior * softplus(gp).mean()
        risks.append(good + max(0.0, bad))
        dp_good, dp_bad, du = -prior * sigmoid(-gp) / p.n, -prior * sigmoid(gp) / p.n, sigmoid(gu) / u.n
        if bad >= 0:
            dp = dp_good + dp_bad
        else:  # the estimate of the negatives' risk is below zero: step back from overfitting
            dp, du = -dp_bad, -du
        grad = np.append(p.back(dp) + u.back(du), dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        scale = np.sqrt(v / (1 - 0.999**t)) + 1e-8
        w -= RATE * (m / (1 - 0.9**t)) / scale
        cut = RATE * SPARSITY / scale
        w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - cut[:-1])
    return w[:-1], float(w[-1]), risks


def candidate_features(positive: DataFrame, least: float) -> list[bytes]:
    """Features of at least so many positive texts, the most frequent MAX_FEATURES of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                n = Counter(f for t in batch["text"][a : a + 500] for f in text_features(t if isinstance(t, str) else ""))
                yield pd.DataFrame({"feature": list(n), "n": list(n.values())})

    found = positive.select("text").mapInPandas(count, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return [bytes(r.feature) for r in found.where(F.col("n") >= least).orderBy(F.desc("n"), "feature").limit(MAX_FEATURES).collect()]


def fit_fold(pdf: pd.DataFrame, width: int, prior: float) -> pd.DataFrame:
    """One classifier from a shard of the sample (text_key, positive, features): rows of (feature, weight), the bias at -1."""
    flags = pdf["positive"].to_numpy(bool)
    rows = [np.asarray(r, np.int64) for r in pdf["features"]]
    count = lambda some: np.bincount(np.concatenate([*some, np.zeros(0, np.int64)]), minlength=width)
    in_positive = count([r for r, y in zip(rows, flags, strict=True) if y])
    in_unlabelled = count([r for r, y in zip(rows, flags, strict=True) if not y])
    n_positive, n_unlabelled = int(flags.sum()), int((~flags).sum())
    if not n_positive or not n_unlabelled:
        return pd.DataFrame({"feature": [], "weight": []})
    good = (in_positive >= max(3, n_positive * LEAST_SHARE)) & (in_positive >= LEAST_LIFT * (in_unlabelled * n_positive / n_unlabelled + 1))
    names = np.flatnonzero(good)
    index = np.cumsum(good) - 1
    rows = [index[r[good[r]]].tolist() for r in rows]
    w, bias, _ = train_nnpu([r for r, y in zip(rows, flags, strict=True) if y], [r for r, y in zip(rows, flags, strict=True) if not y], len(names), prior)
    kept = np.flatnonzero(w)
    return pd.DataFrame({"feature": [*names[kept].tolist(), -1], "weight": [*w[kept].tolist(), bias]})


def fit(docs: DataFrame, labels: DataFrame, seed: int = 11) -> tuple[dict[bytes, float], float]:
    """Weights and bias, learned from the rows of labels and docs that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = known.agg(F.count("*"), F.sum("toxic")).first()
    if not counts[0] or not counts[1]:
        return {}, -np.inf
    prior = min(0.9, max(1e-3, counts[1] / counts[0]))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    positive = known.where("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(MAX_POSITIVE)
    unlabelled = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).orderBy(order, "doc_id").limit(MAX_UNLABELLED)
    text = docs.select("doc_id", "text")
    n_positive = min(MAX_POSITIVE, counts[1])
    names = candidate_features(text.join(F.broadcast(positive), "doc_id"), max(3, n_positive * LEAST_SHARE / 2))
    shared = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    @F.pandas_udf("array<int>")
    def indexed(texts: pd.Series) -> pd.Series:
        index = shared.value
        return pd.Series([np.array([index[f] for f in text_features(t if isinstance(t, str) else "") if f in index], np.int32) for t in texts])

    folds = max(1, n_positive // PER_FOLD)
    chosen = positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.distinct().withColumn("positive", F.lit(False)))
    width = len(names)
    fold = F.pmod(F.xxhash64("text"), F.lit(folds)).alias("fold")
    sample = text.join(F.broadcast(chosen), "doc_id").select(fold, F.xxhash64("text").alias("text_key"), "positive", indexed("text").alias("features"))
    # Equal texts are one example, dropped where a fold's rows meet, so no group grows with copies.
    sample = sample.repartition("fold").dropDuplicates(["fold", "positive", "text_key"])
    found = sample.groupBy("fold").applyInPandas(lambda pdf: fit_fold(pdf, width, prior), "feature long, weight double").collect()
    biases = [r.weight for r in found if r.feature < 0]
    if not biases:
        return {}, float(np.log(prior / (1 - prior)))
    weights: dict[bytes, float] = {}
    for r in found:
        if r.feature >= 0:
            weights[names[r.feature]] = weights.get(names[r.feature], 0.0) + r.weight / len(biases)
    return {f: w for f, w in weights.items() if abs(w) > 1e-3}, float(np.mean(biases))


def scorer(spark, model: tuple[dict[bytes, float], float]):
    """A column function: the text's probability of being toxic."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        known: dict[bytes, tuple[bytes, ...]] = {}
        for batch in batches:
            out = np.empty(len(batch))
            for i, text in enumerate(batch):
                hit: set[bytes] = set()
                for w in word_set(text if isinstance(text, str) else ""):
                    f = known.get(w)
                    if f is None:
                        if len(known) > 100_000:
                            known.clear()
                        f = known[w] = tuple(x for x in features_of(w) if x in weights)
                    if f:
                        hit.update(f)
                out[i] = bias + sum(weights[f] for f in sorted(hit)) if hit else bias
            yield pd.Series(sigmoid(out))
        known.clear()
        give_back()

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc`` (the row of the input, whatever its columns are called), ``score`` and ``predicted``."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
