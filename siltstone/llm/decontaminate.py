"""Benchmark decontamination with suffix arrays over shards of the training texts.

Every task cuts its texts into shards of a few MB. A shard's words become ids of the benchmark's vocabulary
(0 for a word that no item has) and the positions that can begin a match are sorted into a suffix array.
Every suffix of every benchmark item is then found by binary search, which gives all places of its first
``window`` words at once. Test suffixes that begin with the same window are one query with a list of the items that
hold it, so a window that is common on both sides is found once and not once for each pair of places; its places count
as hit, and each text takes the window's items once. Matches that follow each other on one diagonal are joined into the
longest verbatim match of the text and the item. Nothing is shuffled: the texts stay where they are read.

The benchmark is a stated query set. It goes to the tasks in blocks of at most ``BLOCK_WORDS`` words, and one pass over
the texts searches as many of them as hold ``PASS_WORDS`` words together (some 200 bytes a word in each task). A larger
benchmark takes more passes over texts with a key of their own; each leaves only the texts that it found something in,
with the places that were hit, and their union is the result.

Defined cases: null and empty texts have no words and are never contaminated; a very long text is a shard of its own;
null or wordless items match nothing; null item ids are left out of the ids but their words count as hit; repeated rows
each get a result; an empty table gives no rows. Columns of the inputs other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch
from siltstone.llm.words import NOT_ALNUM, Words, chunks, combine, give_back

WINDOW = 13
BLOCK_WORDS, PASS_WORDS = 2_000_000, 4_000_000

PLACE = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FOUND = "_row long, items array<long>, matches array<struct<item_id:long,doc_start:long,item_start:long,n_words:long>>, hits array<struct<start:long,end:long>>"
RESULT = "doc_id long, n_words long, n_hit long, items array<long>, matches array<struct<item_id:long,doc_start:long,item_start:long,n_words:long>>"
SPAN = pa.struct([("item_id", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())])


class Queries:
    """The distinct first windows of the test suffixes of some items, as a suffix array is searched, and whose they are."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        words = Words([(t or "").encode("utf-8", "surrogatepass") for _, t in items], NOT_ALNUM)
        self.window = window
        self.item_ids = [k for k, _ in items]
        self.vocabulary, ids = np.unique(words.hashes(), return_inverse=True)
        ids = ids.astype(np.uint32) + np.uint32(1)
        sizes = words.n[words.n > 0]
        self.anchor = int(min(3, sizes.min())) if len(sizes) else 0
        width = np.minimum(words.n, window)
        count = np.where(width > 0, words.n - width + 1, 0)
        item = np.repeat(np.arange(len(items)), count)
        start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        at, length = words.first[:-1][item] + start, width[item]
        table = np.zeros((len(item), window), np.uint32)
        for j in range(window):
            table[:, j] = np.where(j < length, ids[np.minimum(at + j, len(ids) - 1)] if len(ids) else 0, 0)
        self.low, own = np.unique(as_keys(table), return_inverse=True)
        first = np.zeros(len(self.low), np.int64)
        first[own[::-1]] = np.arange(len(own))[::-1]
        self.length = length[first]
        filled = table[first]
        filled[np.arange(window)[None, :] >= self.length[:, None]] = 0xFFFFFFFF
        self.high = as_keys(filled)
        # The first place of each window in each item: rows of (window, item), in that order.
        pairs = np.unique(np.stack([own.reshape(-1), item, start]), axis=1)
        once = np.ones(pairs.shape[1], bool)
        once[1:] = (np.diff(pairs[0]) != 0) | (np.diff(pairs[1]) != 0)
        self.item, self.start = pairs[1][once], pairs[2][once]
        self.of = np.searchsorted(pairs[0][once], np.arange(len(self.low) + 1))
        self.words, self.first = ids, words.first
        self.anchors = np.unique(combine_at(ids, at, self.anchor)) if len(item) else np.zeros(0, np.uint64)

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)


def as_keys(table: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that sort like the rows."""
    return np.ascontiguousarray(table.astype(">u4")).view(f"S{4 * table.shape[1]}").reshape(-1)


class SuffixArray:
    """Sorted suffixes of a shard, of those that begin with some ``anchor`` words that also stand in the benchmark.

    Every match is at least so long, so no other suffix can be found.
    """

    def __init__(self, ids: np.ndarray, text_of: np.ndarray, q: Queries):
        k = q.anchor
        starts = np.flatnonzero(ids)
        if k > 1:
            starts = starts[starts <= len(ids) - k]
            for j in range(1, k):
                starts = starts[(ids[starts + j] > 0) & (text_of[starts + j] == text_of[starts])]
            codes = combine_at(ids, starts, k)
            at = np.minimum(np.searchsorted(q.anchors, codes), len(q.anchors) - 1)
            starts = starts[q.anchors[at] == codes]
        table = np.zeros((len(starts), q.window), np.uint32)
        live = np.ones(len(starts), bool)
        for j in range(q.window):
            p = np.minimum(starts + j, len(ids) - 1)
            live &= (starts + j < len(ids)) & (text_of[p] == text_of[starts])
            table[:, j] = np.where(live, ids[p], 0)
        keys = as_keys(table)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], starts[order]

    def ranges(self, q: Queries) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.keys, q.low, "left"), np.searchsorted(self.keys, q.high, "right")


def combine_at(ids: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    rows = np.stack([ids[starts + j] for j in range(k)]) if len(starts) else np.zeros((k, 0))
    out = np.empty((len(starts), k), np.uint64)
    out[:] = rows.T
    flat = combine(out.reshape(-1), k)
    return flat[::k] if len(starts) else np.zeros(0, np.uint64)


def spread(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for counts[i] numbers, one i after the other."""
    return np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def shard_hits(raws: list[bytes], blocks: list[Queries]) -> Iterator[tuple[int, int, list, list, list]]:
    """Per text of the shard: words, hit words, item ids found, longest matches (item id, doc_start, item_start, words),
    and the ranges of words that are hit."""
    words = Words(raws, NOT_ALNUM)
    edge = np.zeros(len(words.start) + 1, np.int64)
    found: list[list[tuple]] = [[] for _ in raws]
    text_of = np.repeat(np.arange(len(raws)), words.n)
    hashes = words.hashes() if len(words.start) else None
    for q in blocks:
        if not len(q.low) or hashes is None:
            continue
        ids = q.ids_of(hashes)
        suffixes = SuffixArray(ids, text_of, q)
        low, high = suffixes.ranges(q)
        counts = high - low
        if not counts.any():
            continue
        window = np.repeat(np.arange(len(low)), counts)
        place = suffixes.at[spread(counts, low)]
        np.add.at(edge, place, 1)
        np.add.at(edge, place + q.length[window], -1)
        # Each window of a text once, at its first place, and then all items that hold it.
        order = np.lexsort((place, window, text_of[place]))
        text, window, place = text_of[place[order]], window[order], place[order]
        once = np.ones(len(text), bool)
        once[1:] = (np.diff(text) != 0) | (np.diff(window) != 0)
        text, window, place = text[once], window[once], place[once] - words.first[text[once]]
        counts = q.of[window + 1] - q.of[window]
        own = np.repeat(np.arange(len(window)), counts)
        held = spread(counts, q.of[window])
        runs = joined(text[own], q.item[held], place[own], q.start[held], q.length[window[own]])
        for t, i, p, s, n in longest(*extended(ids, words.first, q, *runs)):
            found[t].append((q.item_ids[i], p, s, n))
    is_hit = np.cumsum(edge[:-1]) > 0
    covered = np.concatenate([[0], np.cumsum(is_hit)])
    for t in range(len(raws)):
        a, b = words.first[t], words.first[t + 1]
        hit = int(covered[b] - covered[a])
        ends = np.flatnonzero(np.diff(np.concatenate([[False], is_hit[a:b], [False]]))) if hit else np.zeros(0, np.int64)
        yield int(words.n[t]), hit, sorted({r[0] for r in found[t] if r[0] is not None}), found[t], list(zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True))


def joined(text: np.ndarray, item: np.ndarray, place: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows that follow each other in the text and in the item: text, item, doc_start, item_start, words."""
    order = np.lexsort((start, start - place, item, text))
    text, item, place, start, length = (x[order] for x in (text, item, place, start, length))
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(start - place) != 0) | (start[1:] > start[:-1] + length[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(text)) - 1
    return text[head], item[head], place[head], start[head], start[tail] + length[tail] - start[head]


def extended(ids: np.ndarray, first: np.ndarray, q: Queries, text: np.ndarray, item: np.ndarray, place: np.ndarray, start: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs with what else stands verbatim at their ends: windows that the text already had at another place."""
    n_text, n_item = np.diff(first)[text], np.diff(q.first)[item]
    for left in (True, False):
        live = np.arange(len(text))
        while len(live):
            p, s = (place[live] - 1, start[live] - 1) if left else (place[live] + words[live], start[live] + words[live])
            inside = (p >= 0) & (s >= 0) & (p < n_text[live]) & (s < n_item[live])
            live, p, s = live[inside], p[inside], s[inside]
            live = live[ids[first[text[live]] + p] == q.words[q.first[item[live]] + s]]
            words[live] += 1
            if left:
                place[live] -= 1
                start[live] -= 1
    return text, item, place, start, words


def longest(text: np.ndarray, item: np.ndarray, place: np.ndarray, start: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, doc_start, item_start, words) of the longest match of each text and item; the first of equal ones."""
    order = np.lexsort((place, -words, item, text))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(text[order]) != 0) | (np.diff(item[order]) != 0)
    yield from zip(*(x[order[first]].tolist() for x in (text, item, place, start, words)), strict=True)


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, a bounded block at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "") // 2 + 1
        if size >= block_words:
            yield held
            held, size = [], 0
    yield held


def passes(benchmark: DataFrame, block_words: int, pass_words: int) -> Iterator[list[list]]:
    """The blocks of items, as many at a time as one pass may hold."""
    held, size = [], 0
    for block in item_blocks(benchmark, block_words):
        words = sum(len(t or "") // 2 + 1 for _, t in block)
        if held and size + words > pass_words:
            yield held
            held, size = [], 0
        held.append(block)
        size += words
    yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, pass_words: int | None = None) -> DataFrame:
    """Per document: words, words inside any occurrence of a benchmark window, items found, and the longest verbatim
    match with each of them."""
    rounds = passes(benchmark, block_words, PASS_WORDS if pass_words is None else pass_words)
    blocks, more = next(rounds), next(rounds, None)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if more is None:
        return _one_pass(docs, blocks, window)
    return _many_passes(docs, chain([blocks, more], rounds), window)


def _one_pass(docs: DataFrame, blocks: list[list], window: int) -> DataFrame:
    shared = [docs.sparkSession.sparkContext.broadcast(Queries(block, window)) for block in blocks]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b.value for b in shared]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, raws in chunks(texts):
                rows = list(shard_hits(raws, blocks))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(raws)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), _spans(rows)],
                    names=["doc_id", "n_words", "n_hit", "items", "matches"],
                )
        give_back()

    return docs.mapInArrow(search, RESULT)


def _spans(rows: list[tuple]) -> pa.Array:
    return pa.array([[{"item_id": i, "doc_start": p, "item_start": s, "n_words": n} for i, p, s, n in r[3]] for r in rows], pa.list_(SPAN))


def _many_passes(docs: DataFrame, rounds: Iterator[list[list]], window: int) -> DataFrame:
    """The same over one pass after another: what each found is written, and its broadcasts are gone before the next."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    keyed = scratch.keep(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    found = None
    for i, blocks in enumerate(rounds):
        shared = [spark.sparkContext.broadcast(Queries(block, window)) for block in blocks]

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            blocks = [b.value for b in shared]
            for batch in batches:
                for first, raws in chunks(batch.column(1)):
                    rows = list(shard_hits(raws, blocks))
                    some = [k for k, r in enumerate(rows) if r[1]]
                    rows = [rows[k] for k in some]
                    hits = pa.array([[{"start": a, "end": b} for a, b in r[4]] for r in rows], pa.list_(PLACE))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raws)).take(pa.array(some, pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64())), _spans(rows), hits], names=["_row", "items", "matches", "hits"])

        one = scratch.keep(keyed.select("_row", "text").mapInArrow(search, FOUND), f"pass-{i}")
        found = one if found is None else found.unionByName(one)
        for b in shared:
            b.destroy()
    # A document's own finds are gathered: no more than its words for each pass.
    all_of = lambda c: F.flatten(F.collect_list(c)).alias(c)
    found = found.groupBy("_row").agg(all_of("items"), all_of("matches"), F.array_sort(all_of("hits")).alias("hits"))
    # Ranges in order: a word counts from where the last range ended, if that is later.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    union = F.aggregate("hits", start, lambda acc, h: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), h["end"] - F.greatest(acc["end"], h["start"]))).alias("n"), F.greatest(acc["end"], h["end"]).alias("end")))
    found = scratch.keep(found.select("_row", "items", "matches", union["n"].alias("n_hit")), "found")
    sizes = keyed.select("_row", "doc_id", "text").mapInArrow(_word_counts, "_row long, doc_id long, n_words long")
    out = sizes.join(found, "_row", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    kind = found.schema["matches"].dataType.simpleString()
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), empty("items", "array<long>"), empty("matches", kind))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, raws in chunks(batch.column(2)):
            n = Words(raws, NOT_ALNUM).n
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raws)), batch.column(1).slice(first, len(raws)), pa.array(n, pa.int64())], names=["_row", "doc_id", "n_words"])


def contaminated() -> F.Column:
    """The rule: some words hit, and they are at least a twentieth of the document's."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    """Columns of the contract from those of ``find_contamination``."""
    items = F.array_sort(F.transform(F.array_distinct("items"), lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size(F.array_distinct("items")).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), contaminated().alias("contaminated"))
