"""Nearest neighbours by learned partitions.

A bounded sample is joined to its nearest neighbours; that graph is cut into balanced parts with few edges between them,
and a small network learns from the vectors in which parts a vector's neighbours lie. Every vector is indexed under its
most probable part. A query goes to its several most probable parts, and what lies there is ranked by exact products.
How many parts a query needs is measured on vectors that the graph and the network didn't see.

Equal vectors are one indexed row with their least ids, as no answer can hold more of them; a query vector is searched
once, however many rows have it. Queries go in blocks of some QUERIES with neighbouring homes; the parts are dealt to a
few pieces. A block meets a piece in one task: it holds the block's queries and the best found so far, and the vectors of
the parts that the block asks for stream by, a batch at a time. So a task's memory is bounded whatever the size of a
part, nothing is cut, and a query leaves each piece with no more rows than its answer has.

Defined cases: rows whose vec_id is null and vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do vectors of another length than the most frequent one (of ties the longest). A row's own row is left out of its answer once;
other rows with its id or its vector are candidates like all others. Equal scores go to the smaller vec_id. With fewer
candidates than asked for, all of them are the answer, as then there is one part. An empty table gives no rows. Only
vec_id and embedding are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch

#: Vectors that the graph and the network are fitted on at most, by hash; a fifth of them is held out to count the parts.
SAMPLE = 8_192
#: Neighbours in the graph; vectors for each part, and parts at most; share of neighbours that the parts searched must hold.
GRAPH_NEIGHBOURS, PART_ROWS, MOST_PARTS, RECALL = 10, 800, 64, 0.94
HIDDEN, EPOCHS, BATCH, RATE = 128, 30, 256, 0.003
#: Queries of a block, about; pieces that the parts are dealt to; finds that are held before the best are picked.
QUERIES, PIECES, HELD = 1_024, 8, 200_000


def nearest(points: np.ndarray, queries: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Places of the k points with the largest product, nearest first, by blocks; ``own``: query i is point i, left out."""
    out = []
    for at in range(0, len(queries), 512):
        s = queries[at : at + 512] @ points.T
        if own:
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, axis=1), axis=1), axis=1))
    return np.concatenate(out)


def bisect(n: int, a: np.ndarray, b: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """Sides of n nodes with edges (a, b), given both ways: True for a fixed share of them, with few edges between.

    Starts at the slowest wave of a random walk, then swaps nodes of both sides as long as fewer edges are cut.
    """
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    x = rng.standard_normal(n)
    for _ in range(80):
        x = 0.5 * (x + np.bincount(a, x[b], minlength=n) / degree)
        x -= np.average(x, weights=degree)
        x /= np.abs(x).max() or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[: round(n * share)]] = True
    cut = np.count_nonzero(side[a] != side[b])
    step = n
    while step:
        gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), minlength=n)
        one, two = (i[np.argsort(-gain[i], kind="stable")] for i in (np.flatnonzero(side), np.flatnonzero(~side)))
        step = min(step, np.count_nonzero(gain[one[: min(len(one), len(two))]] + gain[two[: min(len(one), len(two))]] > 0))
        while step:
            moved = side.copy()
            moved[one[:step]], moved[two[:step]] = False, True
            if (now := np.count_nonzero(moved[a] != moved[b])) < cut:
                side, cut = moved, now
                break
            step //= 2
    return side


def balanced_parts(n: int, a: np.ndarray, b: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each node, of equal sizes but for one node, by bisecting again and again."""
    out = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        nodes, first, count = todo.pop()
        if count == 1:
            out[nodes] = first
            continue
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        inside = (place[a] >= 0) & (place[b] >= 0)
        side = bisect(len(nodes), place[a[inside]], place[b[inside]], (count // 2) / count, rng)
        todo += [(nodes[side], first, count // 2), (nodes[~side], first + count // 2, count - count // 2)]
    return out


@dataclass
class Router:
    """A network of one hidden layer from a vector to the odds of its parts, and how many of them a query searches."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float
    probes: int = 1

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w1 + self.b1, 0)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """All parts of each vector, the most probable first."""
        return np.argsort(-(self.hidden(x) @ self.w2 + self.b2), axis=1, kind="stable")


def train(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> Router:
    """Least cross entropy to the target shares of the parts, by Adam."""
    scale = 1 / max(float(np.sqrt(np.mean(np.sum(x * x, axis=1)))), 1e-30)
    net = Router(rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, target.shape[1])) * 0.01, np.zeros(target.shape[1]), scale)
    names = ("w1", "b1", "w2", "b2")
    m1, m2, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            h = net.hidden(x[rows])
            odds = h @ net.w2 + net.b2
            p = np.exp(odds - odds.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (d @ net.w2.T) * (h > 0)
            t += 1
            for k, g in zip(names, ((x[rows] * scale).T @ back, back.sum(0), h.T @ d, d.sum(0)), strict=True):
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
                setattr(net, k, getattr(net, k) - RATE * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8))
    return net


def fit_router(sample: np.ndarray, parts: int, k: int, recall: float = RECALL, seed: int = 7) -> Router | None:
    """The router learned from a sample; None where one part, or too small a sample, leaves nothing to learn."""
    held, rest = sample[::5], np.delete(sample, np.s_[::5], axis=0)
    if parts < 2 or len(rest) < max(4 * parts, 4 * k, 2 * GRAPH_NEIGHBOURS):
        return None
    rng = np.random.default_rng(seed)
    near = nearest(rest, rest, GRAPH_NEIGHBOURS, own=True)
    a, b = np.repeat(np.arange(len(rest)), GRAPH_NEIGHBOURS), near.ravel()
    edges = np.unique(np.concatenate([a * len(rest) + b, b * len(rest) + a]))
    part = balanced_parts(len(rest), edges // len(rest), edges % len(rest), parts, rng)
    target = np.zeros((len(rest), parts))
    np.add.at(target, (np.arange(len(rest)), part), 1.0)
    np.add.at(target, (a, part[b]), 1.0)
    router = train(rest, target / target.sum(axis=1, keepdims=True), rng)
    home = router.ranked(rest)[:, 0]
    place = np.argsort(router.ranked(held), axis=1)  # place[i, p]: how probable part p is for held-out vector i
    found = np.take_along_axis(place, home[nearest(rest, held, k, own=False)], axis=1)
    shares = np.cumsum(np.bincount(found.ravel(), minlength=parts)) / found.size
    router.probes = int(np.searchsorted(shares, recall) + 1)
    return router


def taking_part(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vec") == (length.n if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def with_parts(vectors: DataFrame, router: Router | None) -> DataFrame:
    """Adds ``parts``: those that a query searches, the most probable first, which is also where the vector lies."""
    if router is None:
        return vectors.withColumn("parts", F.array(F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranked = router.ranked(matrix(batch.column("vec")))[:, : router.probes].astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, ranked.size + 1, router.probes), pa.int32()), pa.array(ranked.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], names=[*batch.schema.names, "parts"])

    return vectors.mapInArrow(run, f"cand long, vec {vectors.schema['vec'].dataType.simpleString()}, ids array<long>, parts array<int>")


class Meeting:
    """The queries of a block in one piece, and the best that they have met."""

    def __init__(self, k: int):
        self.k, self.queries, self.vectors, self.asks = k, [], [], []
        self.found, self.n_found = [], 0

    def add_queries(self, rows: pa.RecordBatch) -> None:
        self.queries.append(rows.column("cand").to_numpy())
        self.vectors.append(matrix(rows.column("vec")))
        self.asks += rows.column("parts").to_pylist()

    def begin(self) -> None:
        self.queries, self.vectors = np.concatenate(self.queries), np.concatenate(self.vectors)
        self.length = np.linalg.norm(self.vectors, axis=1)
        self.least = np.full(len(self.queries), -np.inf)
        part = np.concatenate([np.asarray(a, np.int64) for a in self.asks])
        who = np.repeat(np.arange(len(self.asks)), [len(a) for a in self.asks])
        self.of_part = {int(p): who[part == p] for p in np.unique(part)}

    def meet(self, part: int, rows: pa.RecordBatch) -> None:
        """Keeps what may be among the k best of a query: by a matrix product with slack for its rounding, then exactly."""
        if isinstance(self.queries, list):
            self.begin()
        who = self.of_part.get(part)
        if who is None:
            return
        vectors = matrix(rows.column("vec"))
        s = self.vectors[who] @ vectors.T
        least = self.least[who]
        if len(vectors) > self.k:
            least = np.maximum(least, np.partition(s, len(vectors) - self.k, axis=1)[:, len(vectors) - self.k])
        at, of = np.nonzero(s >= (least - 1e-12 * self.length[who] * np.linalg.norm(vectors, axis=1).max())[:, None])
        used, of = np.unique(of, return_inverse=True)
        picked = rows.take(pa.array(used))
        ids = np.empty(len(used), object)
        ids[:] = picked.column("ids").to_pylist()
        first = np.fromiter((i[0] for i in ids), np.int64, len(ids))
        score = (self.vectors[who[at]] * vectors[used][of]).sum(axis=1)
        self.found.append((who[at], score, first[of], picked.column("cand").to_numpy()[of], ids[of]))
        self.n_found += len(at)
        if self.n_found > HELD:
            self.pick()

    def pick(self) -> None:
        """Only the k best of each query stay; of equal scores those with the least id."""
        at, score, first, cand, ids = (np.concatenate(c) for c in zip(*self.found, strict=True))
        order = np.lexsort((first, -score, at))
        place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        keep = order[place < self.k]
        last = order[place == self.k - 1]
        self.least[at[last]] = score[last]
        self.found, self.n_found = [(at[keep], score[keep], first[keep], cand[keep], ids[keep])], len(keep)

    def result(self) -> pa.RecordBatch:
        if not self.found:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))], names=["q", "score", "cand", "ids"])
        self.pick()
        at, score, _, cand, ids = self.found[0]
        return pa.RecordBatch.from_arrays([pa.array(self.queries[at]), pa.array(score), pa.array(cand), pa.array(list(ids), pa.list_(pa.int64()))], names=["q", "score", "cand", "ids"])


def met(rows: DataFrame, k: int) -> DataFrame:
    """(q, score, cand, ids) of rows in the order of (block, piece, kind, part), queries (kind 0) before vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            block, piece, kind, part = (batch.column(c).to_numpy() for c in ("block", "piece", "kind", "part"))
            edges = np.flatnonzero(np.diff(block) | np.diff(piece) | np.diff(kind) | np.diff(part)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                if key != (block[a], piece[a]):
                    if now is not None:
                        yield now.result()
                    key, now = (block[a], piece[a]), Meeting(k)
                if kind[a]:
                    now.meet(int(part[a]), batch.slice(a, b - a))
                else:
                    now.add_queries(batch.slice(a, b - a))
        if now is not None:
            yield now.result()

    return rows.mapInArrow(run, "q long, score double, cand long, ids array<long>")


def search(embeddings: DataFrame, is_query, k: int = 20, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """The k nearest other rows of every row for which the condition on vec_id holds: query_id, rank, vec_id, score."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    rows, more = taking_part(embeddings), k + 1
    by_vector = Window.partitionBy("vec").orderBy("vec_id")
    least = rows.withColumn("nth", F.row_number().over(by_vector)).where(F.col("nth") <= more).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    vectors, seen = scratch.measured(least.select(F.monotonically_increasing_id().alias("cand"), "vec", "ids"), "vectors")
    parts = 1
    while parts * 2 <= MOST_PARTS and parts * 2 * PART_ROWS <= seen["rows"]:
        parts *= 2
    some = vectors.orderBy(F.xxhash64("vec"), "cand").select("vec").limit(sample).toArrow()["vec"].combine_chunks() if parts > 1 else None
    router = fit_router(matrix(some), parts, k, recall) if some is not None else None
    index = scratch.keep(with_parts(vectors, router), "index")

    asked = scratch.keep(rows.where(is_query(F.col("vec_id"))).join(index.select("vec", "cand"), "vec").select("vec_id", "cand"), "asked")
    queries = index.join(asked.select("cand").distinct(), "cand", "left_semi")
    # A block's queries have neighbouring homes: the place of a query is that of its home, and some place within it.
    homes = queries.groupBy(F.col("parts")[0].alias("home")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    homes = F.broadcast(homes.select("home", "n", before.alias("before")))  # one row for each part
    block = F.floor((F.col("before") + F.pmod(F.xxhash64("cand"), "n")) / QUERIES).alias("block")
    pieces = min(PIECES, parts)
    piece = lambda p: F.floor(p * pieces / parts).cast("int")
    placed = scratch.keep(queries.join(homes, F.col("parts")[0] == F.col("home")).select(block, "cand", "vec", "parts"), "placed")
    asks = placed.select("block", "cand", "vec", "parts", F.explode(F.array_distinct(F.transform("parts", piece))).alias("piece"))
    asks = asks.select("block", "piece", F.lit(0).alias("kind"), F.lit(-1).alias("part"), "cand", "vec", F.lit(None).cast("array<long>").alias("ids"), F.filter("parts", lambda p: piece(p) == F.col("piece")).alias("parts"))
    wanted = placed.select("block", F.explode("parts").alias("part")).distinct()
    gives = index.withColumn("part", F.col("parts")[0]).join(wanted, "part").select("block", piece(F.col("part")).alias("piece"), F.lit(1).alias("kind"), "part", "cand", "vec", "ids", F.lit(None).cast("array<int>").alias("parts"))
    rows_ = asks.unionByName(gives).repartition("block", "piece").sortWithinPartitions("block", "piece", "kind", "part")
    found = met(rows_, more)

    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    top = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= more)
    near = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("vec_id"), F.col("own").alias("same")))
    top = top.withColumn("own", F.col("q") == F.col("cand")).select("q", near.alias("near")).groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, more).alias("near"))
    mine = F.array_position(F.transform("near", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))), True)
    out = asked.withColumnRenamed("vec_id", "query_id").join(top, F.col("cand") == F.col("q")).withColumn("mine", mine)
    others = F.slice(F.filter("near", lambda x, i: i + 1 != F.col("mine")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score"))
