"""Statistics, clustering, boosting, label quality and weak supervision.

Iterations are driver loops over tables; only scalars, centroids and voter tables (bounded by their definition) reach
the driver. Plans are cut in the cluster's shared folder.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.graph import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def k_for(n: Column, most: int = 24) -> Column:
    """Number of clusters for n units."""
    return F.when(n < 2, 1).when(n < 6, 2).otherwise(F.least(F.lit(most), F.greatest(F.lit(2), F.round(F.sqrt(n / 2)).cast("int"))))


def hashed_vectors(bags: DataFrame, key: str, token: str, size: int = 64, signed: bool = True) -> DataFrame:
    """(key, bucket, value): counts of a bag of strings by hashed bucket, of unit length.

    Signed counts let tokens of one bucket cancel on average; unsigned ones are plain counts. Bucket and sign come from
    the first digits of the token's MD5, so other engines give the same vectors.
    """
    digest = F.md5(F.col(token).cast("binary"))
    number = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("bigint")
    sign = F.when(number(9, 1) % 2 == 0, 1.0).otherwise(-1.0) if signed else F.lit(1.0)
    counted = bags.groupBy(key, token).agg(F.count("*").alias("n"))
    v = counted.select(key, (number(1, 8) % size).alias("bucket"), (F.col("n") * sign).alias("v")).groupBy(key, "bucket").agg(F.sum("v").alias("v"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy(key)))
    return v.where("v != 0").withColumn("value", F.col("v") / length).select(key, "bucket", "value")


def idf(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """(dim, idf) of the non-zero entries of array vectors: ln((n + 1) / (df + 1)) + 1."""
    n = vectors.agg(F.count("*").alias("n"))
    df = vectors.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.count_if(F.col("x") > 0).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("dim", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def numbers(xs: list[float]) -> Column:
    """An array of doubles as one literal."""
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in xs) + ")")


def nearest_of(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, the first of equally near ones, and the squared distance to it."""
    away = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centres], axis=1)
    own = away.argmin(axis=1)
    return own, away[np.arange(len(own)), own]


def assign(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Nearest centre of each point and the distance to it; centres are at most a few dozen."""
    table = np.array(centres, float)

    @F.pandas_udf("cluster int, distance double")
    def place(vec: pd.Series) -> pd.DataFrame:
        own, away = nearest_of(np.stack(vec.to_numpy()).astype(float), table) if len(vec) else (np.zeros(0), np.zeros(0))
        return pd.DataFrame({"cluster": own.astype(np.int32), "distance": np.sqrt(away)})

    return points.withColumn("_b", place("vec")).select(*points.columns, "_b.cluster", "_b.distance")


def _centre_sums(points: DataFrame, centres: list[list[float]]) -> list:
    """(cluster, n, sums) of each cluster: every task adds up its own points, and the driver gets a row for each centre."""
    table = np.array(centres, float)

    def add(batches):
        n, sums = np.zeros(len(table)), np.zeros(table.shape)
        for batch in batches:
            if len(batch):
                vectors = np.stack(batch["vec"].to_numpy()).astype(float)
                own, _ = nearest_of(vectors, table)
                n += np.bincount(own, minlength=len(table))
                np.add.at(sums, own, vectors)
        yield pd.DataFrame({"cluster": np.arange(len(table)), "n": n, "sums": list(sums)})[n > 0]

    parts = points.select("vec").mapInPandas(add, "cluster int, n double, sums array<double>")
    total = F.array(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(table.shape[1])))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), total.alias("sums")).collect()


def uniform(seed: int, step: int, key: str) -> Column:
    """A number in (0, 1) for each row, drawn from its key: reruns and retried tasks draw the same."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(step), F.col(key)), 11) + 0.5) / F.lit(float(1 << 53))


def weighted_centres(points: DataFrame, k: int, seed: int = 42) -> list[list[float]]:
    """k-means++: each centre is drawn with a chance in proportion to the squared distance from all centres before it.

    The least of ``-ln(u) / weight`` over all rows is such a draw, so a centre is one aggregate and nothing is summed or
    walked in order. Fewer distinct points than ``k`` give as many centres as there are.
    """
    first = points.agg(F.min_by("vec", F.struct(uniform(seed, 0, "id"), "id"))).first()[0]
    centres = [] if first is None else [list(first)]
    while centres and len(centres) < k:
        away = assign(points, centres).where("distance > 0")
        key = -F.log(uniform(seed, len(centres), "id")) / (F.col("distance") * F.col("distance"))
        drawn = away.agg(F.min_by("vec", F.struct(key, "id"))).first()[0]
        if drawn is None:
            break
        centres.append(list(drawn))
    return centres


def kmeans(points: DataFrame, k: int, rounds: int = 40, seed: int = 42) -> tuple[DataFrame, list[list[float]]]:
    """Seeded k-means++ and rounds of means over points (id, vec): (id, vec, cluster, distance) and the centres.

    A centre that no point is nearest to is moved to a point drawn from all. Rounds end when no point changes its
    cluster, which is when no centre moves, or after ``rounds``, as the algorithm is defined. No points give no centres.
    """
    points = cut(points.where("vec is not null").select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec")))
    centres = weighted_centres(points, k, seed)
    if not centres:
        return points.select("*", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance")), []
    for i in range(rounds):
        sums = {r.cluster: [s / r.n for s in r["sums"]] for r in _centre_sums(points, centres)}
        for c in range(len(centres)):
            if c not in sums:
                sums[c] = list(points.agg(F.min_by("vec", F.struct(uniform(seed + 1 + c, i, "id"), "id"))).first()[0])
        moved = max(math.dist(centres[c], sums[c]) for c in sums)
        centres = [sums[c] for c in range(len(centres))]
        if moved < 1e-9:
            break
    return assign(points, centres), centres


#: Files that stand for a family at most.
SAMPLE_FILES = 8


def family_report(assigned: DataFrame, k: int) -> DataFrame:
    """Families of units (id, file, cluster, distance): (family, size, inertia, samples), samples being the first
    SAMPLE_FILES distinct files by name, cut before they are gathered."""
    family = F.concat(F.lit(f"fam-{k}-"), F.col("cluster").cast("string"))
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(F.col("distance") * F.col("distance")).alias("inertia"))
    nth = F.dense_rank().over(W.partitionBy("cluster").orderBy("file"))
    few = assigned.where("file is not null").select("cluster", "file").withColumn("_n", nth).where(F.col("_n") <= SAMPLE_FILES).groupBy("cluster").agg(F.array_sort(F.collect_set("file")).alias("samples"))
    return sums.join(few, "cluster", "left").select(family.alias("family"), "size", "inertia", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def gram(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of vectors, their mean, and the sum of their centred outer products, as sums of sums over the tasks."""
    size = points.select(F.size("vec").alias("d")).first()
    d = size.d if size else 0

    def add(batches):
        n, sums, products = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if len(batch):
                m = np.stack(batch["vec"].to_numpy()).astype(float)
                n, sums, products = n + len(m), sums + m.sum(axis=0), products + m.T @ m
        yield pd.DataFrame({"i": np.arange(d + 2), "row": [np.full(d, float(n)), sums, *products]})

    parts = points.select("vec").mapInPandas(add, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    table = np.zeros((d + 2, d))
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        table[r.i, r.j] = r.x
    n = int(table[0, 0]) if d else 0
    mean = table[1] / max(n, 1)
    return n, mean, table[2:] - n * np.outer(mean, mean)


def power_pca(points: DataFrame, steps: int = 25) -> DataFrame:
    """(id, x, y): points (id, vec) along the first two directions, by power iteration and deflation from a fixed start.

    One pass gives the matrix of centred products, which is all that the steps need; a second projects the points. A
    direction without spread is 0.
    """
    points = points.where("vec is not null")
    _, mean, products = gram(points)
    start = np.array([(i * 17 + 3) % 100 / 100 - 0.5 for i in range(len(mean))])

    def power(avoid: np.ndarray | None) -> np.ndarray:
        v = start if avoid is None else start - (start @ avoid) * avoid
        for _ in range(steps):
            w = products @ v
            w = w if avoid is None else w - (w @ avoid) * avoid
            v = w / (np.linalg.norm(w) or 1.0)
        return v

    first = power(None)
    axes = np.stack([first, power(first)], axis=1) if len(mean) else np.zeros((0, 2))

    @F.pandas_udf("x double, y double")
    def project(vec: pd.Series) -> pd.DataFrame:
        m = np.stack(vec.to_numpy()).astype(float) if len(vec) else np.zeros((0, len(mean)))
        return pd.DataFrame((m - mean) @ axes, columns=["x", "y"])

    return points.withColumn("_p", project("vec")).select("id", "_p.x", "_p.y")


def lloyd(points: DataFrame, k: int, rounds: int = 50, start: list[list[float]] | None = None) -> tuple[DataFrame, list[list[float]]]:
    """k-means from the farthest points: the first id starts, then always the point farthest from all centres so far.

    ``start`` gives other first centres. A round adds up the points of each centre inside the tasks, so only sums and
    centres reach the driver. Rounds end when no centre moves, or after ``rounds`` as the algorithm is defined.
    """
    points = cut(points.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec")))
    first = points.orderBy("id").first()
    if first is None:
        return points.select("*", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance")), []
    centres = [list(c) for c in start] if start else [list(first.vec)]
    while len(centres) < k and not start:
        far = assign(points, centres).agg(F.max_by("vec", F.struct("distance", -F.col("id")))).first()[0]
        centres.append(list(far))
    for _ in range(rounds):
        new = [list(c) for c in centres]
        for r in _centre_sums(points, centres):
            new[r.cluster] = [s / r.n for s in r["sums"]]
        moved = max(math.dist(a, b) for a, b in zip(centres, new, strict=True))
        centres = new
        if moved < 1e-9:
            break
    return assign(points, centres), centres


#: Units below which nothing is an anomaly, and the share of them that makes a cluster a pattern.
LEAST_UNITS, POPULATED = 8, 0.05


def idf_vectors(points: DataFrame) -> DataFrame:
    """(id, vec): entries weighted by ln((n + 1) / (df + 1)) + 1, of unit length; df counts positive entries."""
    size = points.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not size.n:
        return points.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    df = points.agg(*(F.count_if(F.col("vec")[i] > 0).alias(f"d{i}") for i in range(size.d))).first()
    weights = numbers([math.log((size.n + 1) / (n + 1)) + 1 for n in df])
    weighted = F.zip_with("vec", weights, lambda x, w: x.cast("double") * w)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return points.select("id", weighted.alias("vec")).withColumn("_l", length).select("id", F.transform("vec", lambda x: F.when(F.col("_l") > 0, x / F.col("_l")).otherwise(x)).alias("vec"))


def anomalies(points: DataFrame, k: int | None = None, z_min: float = 2.0) -> DataFrame:
    """Units far from every established pattern: (id, distance, z) of points (id, vec).

    Points are weighted by IDF and clustered (k is the root of half their number, 2 to 12). A cluster with a twentieth of
    the units, and two at least, is a pattern; a point is as far as its nearest pattern, not as its own centre, which may
    be the point itself. Fewer than LEAST_UNITS units, no pattern, or equal distances give no anomalies.
    """
    n = points.count()
    none = points.select("id", F.lit(0.0).alias("distance"), F.lit(0.0).alias("z")).limit(0)
    if n < LEAST_UNITS:
        return none
    weighted = cut(idf_vectors(points))
    assigned, centres = lloyd(weighted, k or max(2, min(12, math.floor(math.sqrt(n / 2) + 0.5))))
    sizes = {r.cluster: r["count"] for r in assigned.groupBy("cluster").count().collect()}
    patterns = [c for i, c in enumerate(centres) if sizes.get(i, 0) >= max(2, math.floor(n * POPULATED))]
    if not patterns:
        return none
    away = cut(assign(weighted, patterns).select("id", "distance"))
    spread = away.agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("sd")).first()
    if not spread.sd or spread.sd <= 1e-12 * abs(spread.mean):
        return none
    return away.withColumn("z", (F.col("distance") - spread["mean"]) / spread["sd"]).where(F.col("z") >= z_min)


def outliers(assigned: DataFrame) -> DataFrame:
    """Distance over the largest distance of the cluster; 1 where that is 0."""
    most = assigned.groupBy(F.col("cluster").alias("_cluster")).agg(F.max("distance").alias("_most"))
    ratio = F.when(F.col("_most") > 0, F.col("distance") / F.col("_most")).otherwise(1.0)
    return assigned.join(most, F.col("cluster").eqNullSafe(F.col("_cluster"))).withColumn("outlier", ratio).drop("_cluster", "_most")


def z_scores(rows: DataFrame, value: str, limit: float = 2.0) -> DataFrame:
    """Global z-score; no spread, no anomalies."""
    s = rows.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return rows.crossJoin(F.broadcast(s)).withColumn("z", F.round(z, 6)).withColumn("anomaly", F.col("z") >= limit).drop("_m", "_s")


def confusion(rows: DataFrame, by: list[str], optimistic: bool) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of ``predicted`` against ``truth``; empty ratios are 1 or 0."""
    p, t = F.col("predicted"), F.col("truth")
    g = rows.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    empty = 1.0 if optimistic else 0.0
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(empty)
    g = g.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    g = g.withColumn("f1", F.when(both > 0, F.round(2 * F.col("precision") * F.col("recall") / both, 6)).otherwise(0.0))
    return g.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


def regressions(now: DataFrame, baseline: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """(key, metric, before, after) where a metric fell by more than its tolerance."""
    b = baseline.select(F.col(key).alias("_k"), *(F.col(m).alias(f"_b_{m}") for m in tolerances))
    x = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"_b_{m}").cast("double").alias("before"), F.col(m).cast("double").alias("after"), F.lit(tol).alias("tol")) for m, tol in tolerances.items())))
    return now.join(b, now[key] == b["_k"]).select(key, x.alias("x")).select(key, "x.*").where("before - after > tol").drop("tol")


def confident_learning(rows: DataFrame) -> DataFrame:
    """Suspects among (id, label, prob): a row whose other class is at or above that class's mean self-confidence.

    Adds ``given`` (confidence in its own label), ``other``, ``suspect``; rows are told apart by one pass of averages.
    """
    m = rows.agg(F.avg(F.when(F.col("label") == 1, F.col("prob"))).alias("_t1"), F.avg(F.when(F.col("label") == 0, 1 - F.col("prob"))).alias("_t0"))
    own = F.when(F.col("label") == 1, F.col("prob")).otherwise(1 - F.col("prob"))
    limit_other = F.when(F.col("label") == 1, F.col("_t0")).otherwise(F.col("_t1"))
    limit_own = F.when(F.col("label") == 1, F.col("_t1")).otherwise(F.col("_t0"))
    other = 1 - own
    suspect = (other >= limit_other) & ((own < limit_own) | (other > own))
    return rows.crossJoin(F.broadcast(m)).withColumn("given", F.round(own, 6)).withColumn("other", F.round(other, 6)).withColumn("suspect", F.coalesce(suspect, F.lit(False))).drop("_t0", "_t1")


def confident_joint(rows: DataFrame) -> DataFrame:
    """The joint of given and likely labels of (id, label, prob), four rows: given, likely, counted, noise, share,
    share_noise.

    A row counts for the class whose threshold (its mean self-confidence; a half for a class without rows) its probability
    reaches, the more probable one if both; rows that reach none are left out. ``noise`` is the share of counted rows whose
    likely label is another than the given one. ``share`` rescales the counts to how many rows have each given label, so
    that all shares add up to 1, and ``share_noise`` is what lies off the diagonal then. Null labels and probabilities are
    left out; nothing counted gives zeros.
    """
    known = rows.where("label is not null and prob is not null")
    mean = lambda y, p: F.coalesce(F.avg(F.when(F.col("label") == y, p)), F.lit(0.5))
    m = known.agg(mean(1, F.col("prob")).alias("_t1"), mean(0, 1 - F.col("prob")).alias("_t0"))
    one, zero = F.col("prob") >= F.col("_t1"), 1 - F.col("prob") >= F.col("_t0")
    likely = F.when(one & (~zero | (F.col("prob") >= 0.5)), 1).when(zero, 0)
    joint = known.crossJoin(F.broadcast(m)).select(F.col("label").cast("int").alias("y"), likely.alias("l"))
    cells = [(g, x) for g in (0, 1) for x in (0, 1)]
    n = joint.agg(*(F.count_if((F.col("y") == g) & (F.col("l") == x)).alias(f"n{g}{x}") for g, x in cells), *(F.count_if(F.col("y") == g).alias(f"all{g}") for g in (0, 1)))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    scaled = {(g, x): part(F.col(f"n{g}{x}") * F.col(f"all{g}"), F.col(f"n{g}0") + F.col(f"n{g}1")) for g, x in cells}
    whole = sum(scaled.values(), F.lit(0.0))
    off = part(F.col("n01") + F.col("n10"), F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11"))
    share_off = part(scaled[0, 1] + scaled[1, 0], whole)
    out = F.explode(F.array(*(F.struct(F.lit(g).alias("given"), F.lit(x).alias("likely"), F.col(f"n{g}{x}").alias("counted"), F.round(off, 6).alias("noise"), F.round(part(scaled[g, x], whole), 6).alias("share"), F.round(share_off, 6).alias("share_noise")) for g, x in cells)))
    return n.select(out.alias("x")).select("x.*")


#: Values of a feature that are all tried as thresholds; of more, as many percentiles.
MOST_BINS = 1_024


def edges_of(examples: DataFrame, feature: str) -> list[float]:
    """The values of a feature, or its percentiles where there are more than MOST_BINS."""
    value = F.col(feature).cast("double")
    few = [r[0] for r in examples.select(value.alias("v")).where("v is not null").distinct().limit(MOST_BINS + 1).collect()]
    if len(few) > MOST_BINS:
        few = examples.agg(F.percentile_approx(value, [i / MOST_BINS for i in range(MOST_BINS + 1)], 100_000)).first()[0]
    return sorted(set(few))


def train_stumps(examples: DataFrame, features: list[str], rounds: int = 40, rate: float = 0.15) -> dict:
    """Boosted stumps: log-odds base, then the split with the least squared error of the residuals each round."""
    return train_stumps_many(examples.withColumn("_models", F.array(F.lit(0))), features, 1, rounds, rate)[0]


def train_stumps_many(examples: DataFrame, features: list[str], n_models: int, rounds: int = 40, rate: float = 0.15) -> list[dict]:
    """The same for several models at once; the array ``_models`` says of which models a row is an example.

    Features are places among their values (at most MOST_BINS each), so a round is one aggregate whose result is small:
    residuals by model, feature and place. Ties go to the first feature and the least threshold. A model is a base and
    at most ``rounds`` stumps.
    """
    edges = [edges_of(examples, c) for c in features]

    @F.pandas_udf("array<int>")
    def places(*values: pd.Series) -> pd.Series:
        at = [np.searchsorted(e, v.to_numpy(float), "right") - 1 for e, v in zip(edges, values, strict=True)]
        return pd.Series(list(np.stack(at, axis=1).astype(np.int32)))

    packed = cut(examples.select(F.col("label").cast("double").alias("label"), "_models", places(*(F.col(c).cast("double") for c in features)).alias("xs")))
    rows = packed.select(F.explode("_models").alias("m"), "label", "xs")
    share = {r.m: r.p for r in rows.groupBy("m").agg(F.avg("label").alias("p")).collect()}
    models = []
    for m in range(n_models):
        p = min(1 - 1e-6, max(1e-6, share.get(m, 0.5)))
        models.append({"base": math.log(p / (1 - p)), "rate": rate, "stumps": [], "_cuts": []})
    stump = "struct<f:int,bin:int,left:double,right:double>"
    base = numbers([m["base"] for m in models])
    for _ in range(rounds):
        cuts = [[{"f": f, "bin": b, "left": x, "right": y} for f, b, x, y in m["_cuts"]] for m in models]
        known = F.from_json(F.lit(json.dumps(cuts)), f"array<array<{stump}>>")
        score = F.aggregate(F.element_at(known, F.col("m") + 1), F.element_at(base, F.col("m") + 1), lambda s, t: s + rate * F.when(F.element_at("xs", t["f"] + 1) <= t["bin"], t["left"]).otherwise(t["right"]))
        residual = rows.select("m", "xs", (F.col("label") - 1 / (1 + F.exp(-score))).alias("r"))
        sums = residual.select("m", "r", F.posexplode("xs").alias("f", "bin")).groupBy("m", "f", "bin").agg(F.sum("r").alias("r"), F.count("*").alias("n")).collect()
        if not [_add_stump(m, [s for s in sums if s.m == i], features, edges) for i, m in enumerate(models)].count(True):
            break
    return [{k: v for k, v in m.items() if k != "_cuts"} for m in models]


def _add_stump(model: dict, sums: list, features: list[str], edges: list[list[float]]) -> bool:
    """The best split by residuals (f, bin, r, n); False if no feature can be split."""
    best = None
    for f in range(len(features)):
        own = sorted((s for s in sums if s.f == f), key=lambda s: s.bin)
        r, n = math.fsum(s.r for s in own), sum(s.n for s in own)
        left, count = 0.0, 0
        for s, after in zip(own, own[1:]):
            left, count = left + s.r, count + s.n
            gain = round(left * left / count + (r - left) ** 2 / (n - count), 9)
            if best is None or gain > best[0]:
                low, high = (edges[f][max(0, x.bin)] for x in (s, after))
                best = (gain, f, s.bin, (low + high) / 2, left / count, (r - left) / (n - count))
    if best is None:
        return False
    _, f, place, threshold, left, right = best
    model["stumps"].append((features[f], threshold, left, right))
    model["_cuts"].append((f, place, left, right))
    return True


#: Voters of a label model; their tables are the only ones that reach the driver.
MOST_VOTERS = 10_000


def dawid_skene(votes: DataFrame, rounds: int = 50, tolerance: float = 1e-6, good: float = 3.0, bad: float = 1.0, smooth: float = 1.0, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Probabilities of (candidate, voter, vote) votes, and each voter's confusion: ((candidate, p), (voter, y, n0, n1)).

    Starts from the share of yes votes; the confusion of each round is the prior (and the carried state) plus one pass
    of this batch, so the batch is never counted twice. Abstentions (null) say nothing. Candidates with the same votes
    have the same probability, so rounds run over distinct votings; a probability is an expression of the voters' table
    (at most MOST_VOTERS), and nothing else is kept between rounds.
    """
    spark = votes.sparkSession
    by_candidate = cut(votes.where("vote is not null").groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("voter", F.col("vote").cast("int").alias("vote")))).alias("votes")))
    kind = by_candidate.schema["votes"].dataType.elementType["voter"].dataType
    voters = [r[0] for r in by_candidate.select(F.explode("votes").alias("v")).select("v.voter").distinct().limit(MOST_VOTERS + 1).collect()]
    if len(voters) > MOST_VOTERS:
        raise ValueError(f"more than {MOST_VOTERS} voters")
    # Voters by number, so that their facts are an array, and candidates with the same votes as one row.
    numbers_ = F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(voters)], f"voter {kind.simpleString()}, number int"))
    numbered = by_candidate.select("candidate", F.explode("votes").alias("v")).select("candidate", "v.*").join(numbers_, "voter")
    by_candidate = cut(numbered.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("number", "vote"))).alias("votes")))
    votings = cut(by_candidate.groupBy("votes").agg(F.count("*").cast("double").alias("n")))
    carried = {(r.voter, r.y): (r.n0, r.n1) for r in state.select("voter", "y", "n0", "n1").collect()} if state is not None else {}
    yes = F.aggregate("votes", F.lit(0.0), lambda s, v: s + v["vote"]) / F.size("votes")

    def probability(model: tuple[dict, float] | None) -> Column:
        if model is None:
            return yes
        confusion_, pi = model
        log = lambda v, y: tuple(math.log(x / sum(confusion_[v, y])) for x in confusion_[v, y])
        facts = F.from_json(F.lit(json.dumps([[log(v, 1)[vote] - log(v, 0)[vote] for vote in (0, 1)] for v in voters])), "array<array<double>>")
        odds = F.aggregate("votes", F.lit(math.log(pi) - math.log(1 - pi)), lambda s, v: s + F.element_at(F.element_at(facts, v["number"] + 1), v["vote"] + 1))
        return 1 / (1 + F.exp(-odds))

    def same_votes(y: int, vote: int) -> Column:
        return F.sum(F.when(F.col("x.vote") == vote, F.col("n") * (F.col("p") if y else 1 - F.col("p"))).otherwise(0.0)).alias(f"y{y}n{vote}")

    everyone_ = F.struct(F.lit(-1).alias("number"), F.lit(1).alias("vote"))
    before, model = None, None
    for _ in range(rounds if voters else 0):
        moved = F.lit(None).cast("double") if model is None else F.abs(F.col("p") - F.col("was"))
        p = votings.select(probability(model).alias("p"), probability(before).alias("was"), "n", F.explode(F.array_append("votes", everyone_)).alias("x"))
        rows = {r.number: r for r in p.groupBy("x.number").agg(F.max(moved).alias("moved"), *(same_votes(y, v) for y in (0, 1) for v in (0, 1))).collect()}
        everyone = rows.pop(-1)
        if everyone.moved is not None and everyone.moved < tolerance:
            break
        pi = (everyone.y1n1 + smooth) / (everyone.y1n1 + everyone.y0n1 + 2 * smooth)
        confusion_ = {}
        for i, v in enumerate(voters):
            for y in (0, 1):
                more = carried.get((v, y), (0.0, 0.0))
                confusion_[v, y] = tuple(rows[i][f"y{y}n{vote}"] + more[vote] + (good if vote == y else bad) for vote in (0, 1))
        before, model = model, (confusion_, pi)
    schema = f"voter {kind.simpleString()}, y int, n0 double, n1 double"
    found = [(v, y, *n) for (v, y), n in model[0].items()] if model else []
    return by_candidate.select("candidate", probability(model).alias("p")), spark.createDataFrame(found, schema)


def voter_report(confusion_: DataFrame, bias: float = 0.15) -> DataFrame:
    """Mean diagonal, bias between the classes, and mass of each voter."""
    right = F.when(F.col("y") == 1, F.col("n1")).otherwise(F.col("n0")) / (F.col("n0") + F.col("n1"))
    g = confusion_.select("voter", "y", right.alias("r"), (F.col("n0") + F.col("n1")).alias("m")).groupBy("voter").agg(F.avg("r").alias("accuracy"), (F.max(F.when(F.col("y") == 1, F.col("r"))) - F.max(F.when(F.col("y") == 0, F.col("r")))).alias("lean"), F.sum("m").alias("mass"))
    return g.withColumn("biased", F.abs("lean") > bias)


def carried_state(confusion_: DataFrame, anchor: str, decay: float = 0.95) -> DataFrame:
    """The confusion for the next round, faded; all classes swap if the anchor voter is wrong more often than right."""
    a = confusion_.where(F.col("voter") == anchor).agg((F.sum(F.when(F.col("y") == 1, F.col("n1")).otherwise(F.col("n0"))) / F.sum(F.col("n0") + F.col("n1")) < 0.5).alias("_flip"))
    f = confusion_.crossJoin(F.broadcast(a)).withColumn("_flip", F.coalesce("_flip", F.lit(False)))
    return f.select("voter", F.when(F.col("_flip"), 1 - F.col("y")).otherwise(F.col("y")).alias("y"), (F.col("n0") * decay).alias("n0"), (F.col("n1") * decay).alias("n1"))


def verdicts(cases: DataFrame, by: str) -> DataFrame:
    """Verdict of each rule from its cases' probabilities: confirmed, refuted, uncertain, and what follows."""
    g = cases.groupBy(by).agg(F.count_if(F.col("p") >= 0.9).alias("confirmed"), F.count_if(F.col("p") <= 0.1).alias("refuted"), F.count_if((F.col("p") > 0.1) & (F.col("p") < 0.9)).alias("uncertain"))
    n = F.col("confirmed") + F.col("refuted")
    share = F.when(n > 0, F.col("confirmed") / n).otherwise(0.0)
    return g.withColumn("verdict", F.when(n < 5, "no-evidence").when(share >= 0.85, "approve").when(share >= 0.5, "review").otherwise("quarantine"))


def variant_grid(specs: DataFrame, cases: DataFrame) -> DataFrame:
    """F1 of every pattern variant (rule_id, variant, regex) on the rule's cases (rule_id, text, truth)."""
    j = cases.join(specs, "rule_id").select("rule_id", "variant", "truth", F.expr("text rlike regex").alias("predicted"))
    return confusion(j, ["rule_id", "variant"], optimistic=True)


def promote(grid: DataFrame, base_variant: str) -> DataFrame:
    """The best variant of each rule by f1, then precision, then name; promoted if it beats the base and is precise."""
    best = grid.groupBy("rule_id").agg(F.max_by(F.struct("variant", "f1", "precision"), F.struct("f1", "precision", "variant")).alias("b"))
    base = grid.where(F.col("variant") == base_variant).select("rule_id", F.col("f1").alias("base_f1"))
    return best.join(base, "rule_id").select("rule_id", "b.variant", "b.f1", "base_f1", ((F.col("b.f1") > F.col("base_f1")) & (F.col("b.precision") >= 0.85)).alias("promoted"))


#: Mutated patterns that are compiled for the safety check at most.
MOST_PATTERNS = 20_000


def mutate(rules: DataFrame, specs: DataFrame) -> DataFrame:
    """Rules (rule_id, regex, unless) under mutation specs (rule_id, id, kind, value): (rule_id, id, regex, unless, safe).

    The kinds are append_regex_alt, replace_in_regex (``from=>to``, the first place), set_unless and append_unless_alt; any
    other kind leaves the rule as it is. Safe is a spec with an id and a value whose patterns compile.
    """
    value, at = F.col("value"), F.instr("value", "=>")
    alt = lambda c: F.when(F.coalesce(c, F.lit("")) == "", value).otherwise(F.concat(c, F.lit("|"), value))
    kind = lambda k: F.col("kind") == k
    before, after = F.substring(value, F.lit(1), at - 1), F.substring(value, at + 2, F.length(value))
    place = F.expr("locate(substring(value, 1, instr(value, '=>') - 1), regex)")
    replaced = F.when((at > 0) & (place > 0), F.concat(F.substring(F.col("regex"), F.lit(1), place - 1), after, F.substring(F.col("regex"), place + F.length(before), F.length("regex")))).otherwise(F.col("regex"))
    j = specs.join(rules.select("rule_id", "regex", "unless"), "rule_id").select(
        "rule_id", "id", "value", F.when(kind("append_regex_alt"), alt(F.col("regex"))).when(kind("replace_in_regex"), replaced).otherwise(F.col("regex")).alias("regex"),
        F.when(kind("set_unless"), value).when(kind("append_unless_alt"), alt(F.col("unless"))).otherwise(F.col("unless")).alias("unless"),
    )
    patterns = j.select(F.explode(F.array("regex", "unless")).alias("p")).where("p is not null").distinct().limit(MOST_PATTERNS + 1).collect()
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} mutated patterns")
    broken = rules.sparkSession.createDataFrame([(r.p,) for r in patterns if not compiles(rules.sparkSession, r.p)], "p string")
    bad = lambda c: F.broadcast(broken.select(F.col("p").alias(f"_{c}"), F.lit(True).alias(f"_bad_{c}")))
    j = j.join(bad("regex"), F.col("regex") == F.col("_regex"), "left").join(bad("unless"), F.col("unless") == F.col("_unless"), "left")
    named = (F.trim(F.coalesce("id", F.lit(""))) != "") & (F.trim(F.coalesce("value", F.lit(""))) != "")
    return j.select("rule_id", "id", "regex", "unless", (named & F.col("_bad_regex").isNull() & F.col("_bad_unless").isNull()).alias("safe"))


def compiles(spark, pattern: str) -> bool:
    """Whether Spark's own regular expressions take the pattern."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException

    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def voter(function) -> Column:
    """A labelling function of a text as a column function: 1, 0 or null; what it fails on is an abstention."""

    @F.pandas_udf("int")
    def vote(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                said = function(text)
                return None if said is None else int(bool(said))
            except Exception:  # noqa: BLE001
                return None

        return pd.Series([one(t) for t in texts], dtype="object")

    return vote


def recorded_votes(candidates: DataFrame, recorded: DataFrame, name: str) -> DataFrame:
    """(candidate, voter, vote): what an outside voter said of each candidate, null where it said nothing."""
    said = recorded.select("candidate", F.col("vote").cast("int").alias("vote"))
    return candidates.select("candidate").join(said, "candidate", "left").select("candidate", F.lit(name).alias("voter"), "vote")
