"""Language-model scoring by the subword lattice.

The vocabulary and the order of its scores come from an existing subword model; nothing is added to it. Every way
to cut a word into its pieces (single bytes included) is a path of a lattice, and the forward recursion in log
space sums them all: the marginal probability of the word. A document is its words and one end; its score is the
sum of their log10 probabilities. Pieces never cross white space, so the sum over words is the sum over all
segmentations of the text.

The piece weights start from the vocabulary's own scores (by rank) and are reweighted once with the expected piece
counts of the training words under those scores (one pass of forward and backward).

Work at scale: words are counted once over all documents; the lattice runs once per distinct word, not per
occurrence. The most frequent words (fewer than HEAD) are looked up from a broadcast table; all other words
meet their counts by a join on two hashes of the word (128 bits), so no common word makes a hot key. Piece statistics are bounded by the vocabulary.

Defined cases: null and empty texts are one end token; a null doc_id is held out; without training documents the
base is uniform over nothing (c = 0, N = 0, V = 0, giving log10(0.1 / 0.1) = 0) and the vocabulary's own scores stay; repeated
rows each get a result; a very long text, and a very long word, is summed whole; columns other than doc_id and text,
whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch
from siltstone.llm.words import BASE, mix

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Most words that are broadcast.
HEAD = 300_000
#: Words held before a task hands its counts on.
HELD = 200_000
#: Words up to this many bytes are taken many at once; a longer one is a chain of its own, whole all the same.
LONGEST = 64
SPACE = "▁".encode()
LOG10 = math.log(10.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces without inner spaces as bytes (a leading space for the word mark), all single bytes among them, and log weights."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rank: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            piece, score = bytes([int(sp.id_to_piece(i)[3:5], 16)]), float(sp.get_piece_size())
        elif sp.is_control(i) or sp.is_unknown(i):
            continue
        else:
            piece, score = sp.id_to_piece(i).encode().replace(SPACE, b" "), -float(sp.get_score(i))
        if piece and b" " not in piece[1:]:
            rank[piece] = min(score, rank.get(piece, math.inf))
    pieces = sorted(rank)
    weight = np.array([1.0 / (rank[p] + 10.0) for p in pieces])
    return pieces, np.log(weight / weight.sum())


class Lattice:
    """All segmentations of many words at once."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.longest = max(map(len, pieces))
        self.logs = logs
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.piece = keys[order], order
        self.lens = {len(p) for p in pieces}
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.depth = int(np.diff(self.begin).max())

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * BASE + b + 1) & 0xFFFFFFFFFFFFFFFF
        return int(mix(np.array([h + len(piece) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        slot = (h >> self.shift).astype(np.int64)
        at, stop = self.begin[slot], self.begin[slot + 1]
        out = np.full(len(h), -1, np.int64)
        live = np.flatnonzero(at < stop)
        for d in range(self.depth):
            if not len(live):
                break
            k = at[live] + d
            same = self.keys[np.minimum(k, len(self.keys) - 1)] == h[live]
            out[live[same]] = self.piece[k[same]]
            live = live[~same & (k + 1 < stop[live])]
        return out

    def edges(self, table: np.ndarray, lens: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(end, piece length) -> (rows, piece indices) of the words in ``table`` (rows of padded bytes)."""
        n, width = table.shape
        prefix = np.zeros((n, width + 1), np.uint64)
        out = {}
        with np.errstate(over="ignore"):
            for j in range(width):
                prefix[:, j + 1] = prefix[:, j] * np.uint64(BASE) + table[:, j].astype(np.uint64) + np.uint64(1)
            power = np.array([pow(BASE, k, 1 << 64) for k in range(width + 1)], np.uint64)
            for end in range(1, width + 1):
                rows = np.flatnonzero(lens >= end)
                for k in range(1, min(end, self.longest) + 1):
                    if k in self.lens:
                        found = self.find(mix(prefix[rows, end] - prefix[rows, end - k] * power[k] + np.uint64(k)))
                        hit = found >= 0
                        if hit.any():
                            out[end, k] = rows[hit], found[hit]
        return out

    def forward(self, n: int, width: int, edges: dict) -> np.ndarray:
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0.0
        for (end, k), (rows, piece) in edges.items():
            alpha[rows, end] = np.logaddexp(alpha[rows, end], alpha[rows, end - k] + self.logs[piece])
        return alpha

    def backward(self, lens: np.ndarray, width: int, edges: dict) -> np.ndarray:
        beta = np.full((len(lens), width + 1), -np.inf)
        beta[np.arange(len(lens)), lens] = 0.0
        for (end, k), (rows, piece) in reversed(edges.items()):
            beta[rows, end - k] = np.logaddexp(beta[rows, end - k], beta[rows, end] + self.logs[piece])
        return beta

    def chain(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of all edges of one word, by end."""
        codes = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(word) + 1, np.uint64)
        starts, ends, pieces = [], [], []
        with np.errstate(over="ignore"):
            for k in range(1, min(len(word), self.longest) + 1):
                h = h[:-1] * np.uint64(BASE) + codes[k - 1 :]  # of the k bytes from each start
                if k in self.lens:
                    found = self.find(mix(h + np.uint64(k)))
                    at = np.flatnonzero(found >= 0)
                    starts.append(at)
                    ends.append(at + k)
                    pieces.append(found[at])
        start, end, piece = (np.concatenate(x) for x in (starts, ends, pieces))
        order = np.argsort(end, kind="stable")
        return start[order], end[order], piece[order]

    def along(self, n: int, start: np.ndarray, end: np.ndarray, piece: np.ndarray) -> list[float]:
        """Forward sums of a chain of n bytes; edges by end."""
        return _sums(n, start.tolist(), end.tolist(), self.logs[piece].tolist())

    def against(self, n: int, start: np.ndarray, end: np.ndarray, piece: np.ndarray) -> list[float]:
        """Backward sums of a chain: the forward ones of the chain read from its end."""
        order = np.argsort(-start, kind="stable")
        return _sums(n, (n - end[order]).tolist(), (n - start[order]).tolist(), self.logs[piece[order]].tolist())[::-1]

    def batches(self, words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Padded tables of the words of up to LONGEST bytes, those of like length together."""
        parts = [(i, m) for i, m in enumerate(map(marked, words)) if len(m) <= LONGEST]
        parts.sort(key=lambda x: len(x[1]))
        for a in range(0, len(parts), 8192):
            some = parts[a : a + 8192]
            lens = np.array([len(p) for _, p in some])
            width = int(lens.max())
            table = np.frombuffer(b"".join(p.ljust(width, b"\0") for _, p in some), np.uint8).reshape(len(some), width)
            yield [i for i, _ in some], table, lens

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the sum over all segmentations of each word."""
        out = np.zeros(len(words))
        for owners, table, lens in self.batches(words):
            alpha = self.forward(len(lens), table.shape[1], self.edges(table, lens))
            out[owners] = alpha[np.arange(len(lens)), lens]
        for i, m in long_words(words):
            out[i] = self.along(len(m), *self.chain(m))[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected count of every piece over all segmentations of the words."""
        out = np.zeros(len(self.logs))
        for owners, table, lens in self.batches(words):
            edges = self.edges(table, lens)
            alpha, beta = self.forward(len(lens), table.shape[1], edges), self.backward(lens, table.shape[1], edges)
            total, n = alpha[np.arange(len(lens)), lens], counts[owners]
            for (end, k), (rows, piece) in edges.items():
                out += np.bincount(piece, n[rows] * np.exp(alpha[rows, end - k] + self.logs[piece] + beta[rows, end] - total[rows]), len(out))
        for i, m in long_words(words):
            start, end, piece = self.chain(m)
            alpha, beta = (np.array(f(len(m), start, end, piece)) for f in (self.along, self.against))
            out += np.bincount(piece, counts[i] * np.exp(alpha[start] + self.logs[piece] + beta[end] - alpha[-1]), len(out))
        return out


def _sums(n: int, start: list[int], end: list[int], logs: list[float]) -> list[float]:
    """Log of the sum over all paths from 0 to each place; edges by end."""
    alpha = [0.0] + [-math.inf] * n
    i = 0
    while i < len(end):
        at, terms = end[i], []
        while i < len(end) and end[i] == at:
            terms.append(alpha[start[i]] + logs[i])
            i += 1
        top = max(terms)
        if top > -math.inf:
            alpha[at] = top + math.log(sum([math.exp(t - top) for t in terms]))
    return alpha


def marked(word: bytes) -> bytes:
    return b" " + word


def long_words(words: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Place and marked word of those over LONGEST bytes."""
    return ((i, m) for i, m in enumerate(map(marked, words)) if len(m) > LONGEST)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """word, n (in all documents), c (in training documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for counts, weight in ((train, 1), (other, 0)):
                words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                for a in range(0, len(words), 50_000):
                    part = n[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 50_000], pa.binary()), pa.array(part), pa.array(part * weight)], names=["word", "n", "c"])
                counts.clear()

        for batch in batches:
            for text, test in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (other if test else train).update(tokens(text.as_py()))
                if len(train) + len(other) > HELD:
                    yield from out()
        yield from out()

    found = docs.select("text", held_out(F.col("doc_id")).alias("test")).mapInArrow(run, "word binary, n long, c long")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def expected_pieces(words: DataFrame, spark, lattice: Lattice) -> np.ndarray:
    """Expected piece counts of all training words; each task hands on one row per piece that it met."""
    shared = spark.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.logs))
        for batch in batches:
            total += shared.value.expected(batch.column(0).to_pylist(), np.asarray(batch.column(1), float))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["piece", "n"])

    out = np.zeros(len(lattice.logs))
    for r in words.where("c > 0").select("word", F.col("c").cast("double")).mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.piece] = r.n
    return out


def reweighted(lattice: Lattice, counts: np.ndarray, ends: int) -> tuple[np.ndarray, float]:
    """Log weights of the pieces and of the end, from expected counts smoothed by the vocabulary's own weights."""
    prior = 0.01 * counts.sum() + 1000.0
    mass = counts + prior * np.exp(lattice.logs)
    total = mass.sum() + ends + 1.0
    return np.log(mass / total), math.log((ends + 1.0) / total)


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, word binary, n long, known long, base double, lattice double"


def score_documents(docs: DataFrame, vocabulary: str = VOCABULARY, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = scratch.keep(count_words(own), "counted")
    sums = counted.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    end_count = own.agg(F.sum((~held_out(F.col("doc_id"))).cast("long"))).first()[0] or 0
    total, distinct = (sums[0] or 0) + end_count, (sums[1] or 0) + (end_count > 0)
    pieces, logs = load_pieces(vocabulary)
    lattice = Lattice(pieces, logs)
    logs, end_log = reweighted(lattice, expected_pieces(counted, spark, lattice), end_count)
    lattice.logs = logs
    shared = spark.sparkContext.broadcast(lattice)
    base = lambda c: math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    unknown = base(0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.log_probability(batch.column(0).to_pylist()) / LOG10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["word", "hash", "n", "c", "lattice"])

    weighed = scratch.keep(counted.select("word", F.xxhash64("word").alias("hash"), "n", "c").mapInArrow(weigh, "word binary, hash long, n long, c long, lattice double"), "weighed")
    scratch.drop("counted")
    most = weighed.select("n").orderBy(F.desc("n")).limit(head)
    floor = most.agg(F.when(F.count("*") == head, F.min("n")).otherwise(0)).first()[0]
    table = {bytes(r.word): (base(r.c), int(r.c > 0), r.lattice) for r in weighed.where(F.col("n") > floor).toLocalIterator()}
    common = spark.sparkContext.broadcast(table)
    end = (base(end_count), int(end_count > 0), end_log / LOG10)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                uid, words, count, heads = [], [], [], []
                for i, (text, row) in enumerate(zip(part.column(3), part.column(0).to_pylist(), strict=True)):
                    bag = Counter(tokens(text.as_py()))
                    n, seen, b, l = 1, end[1], end[0], end[2]
                    for w, k in bag.items():
                        n += k
                        f = known.get(w)
                        if f is None:
                            uid.append(i)
                            words.append(w)
                            count.append(k)
                        else:
                            b += k * f[0]
                            seen += k * f[1]
                            l += k * f[2]
                    heads.append((n, seen, b, l))
                m = part.num_rows
                uid = np.array(uid, np.int64)
                flat = lambda head, rest, kind: pa.array(np.concatenate([np.array(head, kind), np.full(len(uid), rest, kind)]))  # noqa: B023, E731
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids, ids[uid]])),
                        pa.concat_arrays([part.column(1), pa.nulls(len(uid), pa.int64())]),
                        pa.concat_arrays([part.column(2), pa.nulls(len(uid), pa.bool_())]),
                        flat([h[0] for h in heads], 0, np.int64),
                        pa.array([None] * m + words, pa.binary()),
                        pa.array(np.concatenate([np.zeros(m, np.int64), np.array(count, np.int64)])),
                        flat([h[1] for h in heads], 0, np.int64),
                        flat([h[2] for h in heads], 0.0, np.float64),
                        flat([h[3] for h in heads], 0.0, np.float64),
                    ],
                    names=["uid", "doc_id", "held_out", "n_tokens", "word", "n", "known", "base", "lattice"],
                )

    rows = own.select(F.monotonically_increasing_id().alias("uid"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    parts = rows.mapInArrow(look_up, SCORED)
    parts = parts.select("uid", "doc_id", "held_out", "n_tokens", F.when(F.col("word").isNull(), F.xxhash64("uid")).otherwise(F.xxhash64("word")).alias("hash"), F.xxhash64(F.lit(1), "word").alias("hash2"), F.col("word").isNotNull().alias("rare"), "n", "known", "base", "lattice")
    rare = weighed.where(F.col("n") <= floor).select("hash", F.xxhash64(F.lit(1), "word").alias("hash2"), F.lit(True).alias("rare"), "c", F.col("lattice").alias("word_lattice"))
    joined = parts.join(rare, ["hash", "hash2", "rare"], "left")
    rare_base = F.log10((F.col("c") + 0.1) / F.lit(total + 0.1 * (distinct + 1)))
    return (
        joined.groupBy("uid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum(F.col("known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + F.col("n") * F.coalesce(F.when(F.col("rare"), rare_base), F.lit(unknown))).alias("base_score"),
            F.sum(F.col("lattice") + F.col("n") * F.coalesce(F.col("word_lattice"), F.lit(0.0))).alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
    )


def brute_log_probability(word: bytes, weights: dict[bytes, float]) -> float:
    """The same by plain recursion, for tests."""
    whole = b" " + word
    alpha = [0.0] + [-math.inf] * len(whole)
    for end in range(1, len(whole) + 1):
        terms = [alpha[a] + weights[whole[a:end]] for a in range(end) if whole[a:end] in weights and alpha[a] > -math.inf]
        if terms:
            top = max(terms)
            alpha[end] = top + math.log(sum(math.exp(t - top) for t in terms))
    return alpha[-1]
