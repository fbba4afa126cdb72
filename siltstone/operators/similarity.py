"""Pairs of vectors with a large cosine, without comparing all pairs.

Unit vectors at an angle have a distance, so pivots bound it: whatever the pivot p, d(x, y) >= |d(x, p) - d(y, p)|. Vectors
are dealt into tiles of their nearest pivot, and each tile keeps the least and greatest distance to every pivot as its
interval keys; two tiles whose intervals are too far apart for one pivot are never brought together. Inside two tiles,
the pivots' directions split a product into a part that is known and a rest that its lengths bound; only pairs whose
bound reaches the limit are multiplied out. Both bounds are exact, so no pair is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.graph import cut

#: Pivots at most (half of the dimensions, if those are fewer), vectors that they are chosen from, vectors of a tile.
MOST_PIVOTS, PIVOT_SAMPLE, TILE = 32, 2_000, 1_024
#: Pairs of two tiles that are multiplied out at once: near copies are all pairs of them, each with two vectors.
AT_ONCE = 65_536
#: For rounding: a cosine is rounded to six places before it is held against the limit.
SLACK = 1e-6


def choose_pivots(units: np.ndarray) -> np.ndarray:
    """The vectors farthest from all before them, from the first one on."""
    picked = [0]
    near = units @ units[0]
    while len(picked) < min(MOST_PIVOTS, max(1, units.shape[1] // 2), len(units)):
        at = int(np.argmin(near))
        if near[at] >= 1 - 1e-9:
            break
        picked.append(at)
        near = np.maximum(near, units @ units[at])
    return units[picked]


def unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``cell`` (the nearest pivot) and ``away`` (the distance to each pivot)."""

    @F.pandas_udf("cell int, away array<double>")
    def place(vec: pd.Series) -> pd.DataFrame:
        away = np.sqrt(np.maximum(2 - 2 * unit_rows(vec) @ pivots.T, 0))
        return pd.DataFrame({"cell": away.argmin(axis=1).astype(np.int32), "away": list(away)})

    return vectors.withColumn("_p", place("vec")).select(*vectors.columns, "_p.cell", "_p.away")


def tile_pairs(tiles: DataFrame, reach: float) -> DataFrame:
    """(label, t1, t2) of tiles (label, t, low, high) that can hold a pair, t1 <= t2."""
    apart = F.exists(F.zip_with(F.zip_with("low1", "high2", lambda a, b: a - b), F.zip_with("low2", "high1", lambda a, b: a - b), lambda x, y: F.greatest(x, y)), lambda gap: gap > reach)
    a = tiles.select("label", F.col("t").alias("t1"), F.col("low").alias("low1"), F.col("high").alias("high1"))
    b = tiles.select("label", F.col("t").alias("t2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    return a.join(b, "label").where("t1 <= t2").where(~apart).select("label", "t1", "t2")


def verified(a: pd.DataFrame, b: pd.DataFrame, same: bool, directions: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places in a and b of the pairs that reach the limit, their cosines, and how many were multiplied out."""
    x, y = unit_rows(a["vec"]), unit_rows(b["vec"])
    px, py = x @ directions, y @ directions
    rest = lambda m, p: np.sqrt(np.maximum(1 - (p * p).sum(axis=1), 0))[:, None]
    bound = np.hstack([px, rest(x, px)]) @ np.hstack([py, rest(y, py)]).T
    at, of = np.nonzero(bound >= least - SLACK)
    if same:
        # by id, as the two sides of one tile come from two shuffles, each in an order of its own
        first = a["id"].to_numpy()[at] < b["id"].to_numpy()[of]
        at, of = at[first], of[first]
    exact = np.empty(len(at))
    for i in range(0, len(at), AT_ONCE):
        exact[i : i + AT_ONCE] = (x[at[i : i + AT_ONCE]] * y[of[i : i + AT_ONCE]]).sum(axis=1)
    keep = np.round(exact, 6) >= least
    return at[keep], of[keep], exact[keep], len(at)


PLACE = ("file", "start", "end")


def has_direction(vec: str) -> Column:
    """Whether a vector has an angle to others: it is finite (Spark orders NaN above all), without nulls, and not zero."""
    return F.exists(vec, lambda x: x != 0) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def _tiled(vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame, np.ndarray] | None:
    """Vectors with their tile, the tiles to bring together, and the pivots' directions; None without vectors."""
    usable = vectors.where("id is not null and label is not null and vec is not null").where(has_direction("vec"))
    sample = usable.orderBy(F.xxhash64("id"), "id").select("vec").limit(PIVOT_SAMPLE).toPandas()
    if not len(sample):
        return None
    pivots = choose_pivots(unit_rows(sample["vec"]))
    rows = cut(with_pivots(usable, pivots))
    sizes = rows.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    rows = cut(rows.join(F.broadcast(sizes), ["label", "cell"]).withColumn("t", F.struct("cell", F.pmod(F.xxhash64("id"), "tiles").alias("part"))).drop("tiles", "cell"))
    ends = [f(F.col("away")[i]).alias(f"{n}{i}") for i in range(len(pivots)) for f, n in ((F.min, "l"), (F.max, "h"))]
    tiles = rows.groupBy("label", "t").agg(*ends)
    tiles = tiles.select("label", "t", *(F.array(*(f"{n}{i}" for i in range(len(pivots)))).alias(name) for n, name in (("l", "low"), ("h", "high"))))
    directions, _ = np.linalg.qr(pivots.T)
    return rows.drop("away"), cut(tile_pairs(tiles, float(np.sqrt(2 - 2 * (least - SLACK))) + 1e-9)), directions


def _brought_together(vectors: DataFrame, least: float, schema: str, of) -> DataFrame | None:
    made = _tiled(vectors, least)
    if made is None:
        return None
    rows, pairs, directions = made
    keys = ["label", "t1", "t2"]
    own = lambda df, **names: df.select(*(F.col(c).alias(names.get(c, c)) for c in df.columns))  # noqa: E731  columns of its own, as a table meets itself
    left = own(rows, t="t1").join(own(pairs), ["label", "t1"])
    right = own(rows, t="t2").join(own(pairs), ["label", "t2"])

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return of(a, b, *verified(a, b, key[1] == key[2], directions, least))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def classes(vectors: DataFrame) -> DataFrame:
    """Equal vectors of a label as one row under their least id."""
    return vectors.where("label is not null and vec is not null").groupBy("label", "vec").agg(F.min("id").alias("id"))


def similar_pairs(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs (label, a, b, cosine, copy), a < b, of vectors (id, label, vec) of one label with a cosine of at least
    ``least``.

    Equal vectors are a class under their least id: pairs are those between classes (copy is false), and each further
    member is a pair with its class (copy is true), so a thousand copies are a thousand rows and not their square. Where
    the vectors have a place (file, start, end), a unit and one inside it are no pair; what lies inside what differs from
    copy to copy, so every unit stands for itself there and all its pairs are returned (copy is false). Null ids and
    labels, vectors that are null, zero or hold nulls or non-finite numbers have no pairs; rows that share an id are no
    pair of each other. All vectors have one length.
    """
    place = [c for c in PLACE if c in vectors.columns]
    place = place if len(place) == 3 else []
    kind, label = vectors.schema["id"].dataType.simpleString(), vectors.schema["label"].dataType.simpleString()

    def pairs(a: pd.DataFrame, b: pd.DataFrame, at, of, cosine, _) -> pd.DataFrame:
        x, y = a.iloc[at].reset_index(drop=True), b.iloc[of].reset_index(drop=True)
        out = pd.DataFrame({"label": x["label"], "a": x["id"], "b": y["id"], "cosine": np.round(cosine, 6), "copy": False})
        keep = out["a"] != out["b"]
        if place:
            inside = lambda u, v: (u["start"] <= v["start"]) & (v["end"] <= u["end"])
            keep &= ~((x["file"] == y["file"]) & (inside(x, y) | inside(y, x)))
        turned = out["a"] > out["b"]
        out.loc[turned, ["a", "b"]] = out.loc[turned, ["b", "a"]].to_numpy()
        return out[keep]

    schema = f"label {label}, a {kind}, b {kind}, cosine double, copy boolean"
    own = vectors.select("id", "label", "vec", *place) if place else cut(classes(vectors))
    found = _brought_together(own, least, schema, pairs)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    if place:
        return found
    rows = vectors.where(has_direction("vec")).select("label", "vec", F.col("id").alias("b"))
    copies = rows.join(own.withColumnRenamed("id", "a"), ["label", "vec"]).where("a < b")
    return found.unionByName(copies.select("label", "a", "b", F.lit(1.0).alias("cosine"), F.lit(True).alias("copy")))


def multiplied(vectors: DataFrame, least: float = 0.9) -> int:
    """How many pairs the same search multiplies out, for a look at what the bounds save."""
    found = _brought_together(cut(classes(vectors)), least, "n long", lambda a, b, at, of, cosine, n: pd.DataFrame({"n": [n]}))
    return 0 if found is None else found.agg(F.sum("n")).first()[0] or 0
