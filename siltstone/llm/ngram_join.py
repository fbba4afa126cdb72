"""Jaccard join on word shingles: size-banded tiles, hashed bitmap signatures, exact check on sorted arrays.

1. Every text becomes the sorted array of its distinct shingle hashes. Texts with equal sets are one class; only
   classes are compared, so a group of copies is one node however large it is.
2. A class enters the tiles of its prefix: the rarest shingles, so many that two sets that reach the threshold
   share one of them. Rarity comes from counts over all texts in a fixed number of hashed buckets, so shingles of
   one text come first and passages that many documents share come last and don't fill a tile. A tile is ordered
   by set size, and only sizes of the same or the next band (a ratio the threshold allows) can pair.
   Prefix shingles that are alone in their tile bound a set's overlap with others (see ``_most_common``).
   A tile of a common shingle has parts of about PART_TEXTS texts: how many is known from the counts, so no group of
   near copies, however large, fills one task.
3. Bit counts of two bitmap signatures, as wide as the sizes ask for, bound the overlap from above: each bit of one
   set that the other lacks is a shingle that the other lacks. Pairs whose bound is too low go no further; the rest
   are intersected exactly.
4. First every class tries only the best bound of the earlier neighbours that share most tiles with it (and the parts
   of a tile try each other's centres), and the links found give components. Then all pairs of a tile that lie in
   different components are tried, each part with each. Pairs inside a component can't change the result, so near
   copies aren't expanded into all pairs, and no link between components is lost.

The texts are read where they lie; what is shuffled are prefixes, and the sets of classes that have a candidate.
Shingles and classes are told apart by 64-bit hashes. Each step is written to the shared folder and its plan is
short; all but the result is dropped at the end.

Defined cases: null, empty and wordless texts have no shingles, link with nothing and are their own component; a very
long text is one set like any other; repeated rows each get a row; a null doc_id is never the least of a component
unless all its ids are null; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.components import connected_components
from siltstone.llm.scratch import Scratch
from siltstone.llm.words import chunks, give_back, mix, shingle_sets

#: Bits of a signature: twice the set's size at least, as a power of two; the wider of two is folded to the other.
LEAST_BITS = 1024
#: Hashed buckets in which shingles are counted, as a power of two, and buckets that travel together.
BUCKET_BITS, SLICE = 22, 1 << 12
#: Steps of a bucket's code to a doubling of its count, so that two bytes hold any count.
STEPS = 256
#: Texts of a part of a tile, about.
PART_TEXTS = 2_000
#: Neighbours of a class whose bound is computed in the first round.
FIRST_TRIES = 8
#: Ids that are broadcast at most (8 bytes each); more go through a join.
BROADCAST_IDS = 500_000


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How common the shingles of each hashed bucket are: 2**BUCKET_BITS codes of two bytes, whatever the input.

    A code is the logarithm of a count, so it keeps the order of counts of any size. A task hands on its counts in
    slices, and the slices of a place are summed as they stream in; there are a thousand places to sum at once.
    """
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.uint32)
        for batch in batches:
            for _, raws in chunks(batch.column(0)):
                sets = shingle_sets(raws, k)
                if sets:
                    np.add.at(seen, (np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        table = seen.reshape(-1, SLICE)
        some = np.flatnonzero(table.any(axis=1))
        for a in range(0, len(some), 64):
            part = some[a : a + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([table[i].astype(np.uint16 if table[i].max() < 1 << 16 else np.uint32).tobytes() for i in part], pa.binary())], names=["slice", "counts"])
        del seen, table
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py()
                mine = np.frombuffer(raw, np.uint16 if len(raw) == 2 * SLICE else np.uint32)
                sums[i] = sums[i] + mine if i in sums else mine.astype(np.uint64)
        for i, total in sums.items():
            code = np.round(STEPS * np.log2(total + 1.0)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([code.tobytes()], pa.binary())], names=["slice", "codes"])

    out = np.zeros(size, np.uint16)
    for r in docs.select("text").mapInArrow(count, "slice long, counts binary").repartition("slice").mapInArrow(add, "slice long, codes binary").collect():  # 2 bytes a bucket
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r.codes, np.uint16)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    width = max(LEAST_BITS, 1 << (2 * len(shingles) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def class_of(shingles: np.ndarray) -> int:
    """Hash of a set, whatever the order."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def prefix_of(shingles: np.ndarray, codes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first shingles in the common order of rarity, the parts of their tiles, and where in that order the last stands.

    Two sets that reach the threshold share one of their first shingles. The parts follow from the common counts, so
    all sets agree on them.
    """
    n = len(shingles)
    weight = codes[(shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    order = np.lexsort((shingles, weight))[: n + (-percent * n // 100) + 1]
    last = order[-1]
    parts = np.ceil((np.exp2(weight[order] / STEPS) - 1) / PART_TEXTS).astype(np.int32)
    return shingles[order], np.maximum(parts, 1), (int(weight[last]) << 48 | int(shingles[last]) >> 16) - (1 << 63)


SETS = "doc_id long, class long, n long, signature array<long>, prefix array<long>, parts array<int>, last long"


def prepare(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per document its class and set size; with the first text of a class in a task, its signature and prefix too."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(shingle_counts(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        met: set[int] = set()
        for batch in batches:
            for first, raws in chunks(batch.column(1)):
                classes, sizes, signatures, prefixes, parts, lasts = [], [], [], [], [], []
                for s in shingle_sets(raws, k):
                    c = class_of(s) if len(s) else None
                    new = c is not None and c not in met
                    if new:
                        met.add(c)
                    classes.append(c)
                    sizes.append(len(s))
                    signatures.append(signature(s) if new else None)
                    prefix, part, last = prefix_of(s, codes, percent) if new else (None, None, None)
                    prefixes.append(prefix.view(np.int64) if new else None)
                    parts.append(part)
                    lasts.append(last)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(raws)), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.list_(pa.int64())),
                        pa.array(prefixes, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32())), pa.array(lasts, pa.int64()),
                    ],
                    names=["doc_id", "class", "n", "signature", "prefix", "parts", "last"],
                )
        met.clear()
        give_back()

    return docs.mapInArrow(run, SETS)


def shingle_arrays(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raws in chunks(batch.column(0)):
                sets = [s for s in shingle_sets(raws, k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["class", "shingles"])
        give_back()

    return docs.select("text").mapInArrow(run, "class long, shingles array<long>")


def _folded(wide: Column, other: Column) -> Column:
    """The signature at the other's width, if that is less: a bit is set where any bit that falls there is set."""
    n = F.size(other)
    fold = lambda i: F.aggregate(F.sequence(i, F.size(wide) - 1, n), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseOR(F.get(wide, j)))
    return F.when(F.size(wide) > n, F.transform(F.sequence(F.lit(0), n - 1), fold)).otherwise(wide)


def _missing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)


def overlap_bound() -> Column:
    """No more shingles than these are common to the two sets of a row."""
    a, b = _folded(F.col("signature_a"), F.col("signature_b")), _folded(F.col("signature_b"), F.col("signature_a"))
    return F.least(F.col("n_a") - _missing_bits(a, b), F.col("n_b") - _missing_bits(b, a))


def _reaches(overlap: Column, percent: int) -> Column:
    return (100 + percent) * overlap >= percent * (F.col("n_a") + F.col("n_b"))


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _most_common() -> Column:
    """No more than this is common to the sets of a row, as their prefixes tell.

    A prefix shingle that is alone in its tile is in no other prefix. Of two sets, the one whose prefix ends first in
    the common order has no such shingle in the other set at all, as it would stand in that one's prefix.
    """
    return F.when(F.col("last_a") < F.col("last_b"), F.col("most_a")).when(F.col("last_b") < F.col("last_a"), F.col("most_b")).otherwise(F.greatest("most_a", "most_b"))


def _most_from_here() -> Column:
    """The same, if the row's tile is the first that the two sets share: what stands before it isn't common either.

    A pair that reaches the threshold passes in its first tile, so others may fail; a pair that doesn't comes up in
    few tiles or none.
    """
    end_a, end_b = F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")
    lone_a, lone_b = F.col("most_a") - F.col("rank_a"), F.col("most_b") - F.col("rank_b")
    lone = F.when(F.col("last_a") < F.col("last_b"), lone_a).when(F.col("last_b") < F.col("last_a"), lone_b).otherwise(F.greatest(lone_a, lone_b))
    return F.least(end_a, end_b, lone)


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bound reaches the threshold, with n_a, n_b and the bound."""
    side = lambda x: nodes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"signature_{x}"), F.col("most").alias(f"most_{x}"), F.col("last").alias(f"last_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("bound", F.least(overlap_bound(), _most_common())).where(_reaches(F.col("bound"), percent)).select("a", "b", "n_a", "n_b", "bound")


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs that reach the threshold, by intersection of the sorted arrays."""
    pairs = scratch.keep(pairs.select("a", "b"), f"{name}-pairs")
    wanted, seen = scratch.measured(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(nodes.select("class", "doc_id"), "class").select("doc_id").distinct(), f"{name}-wanted")
    ids = F.broadcast(wanted) if seen["rows"] <= BROADCAST_IDS else wanted
    texts = docs.alias("d").join(ids.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
    sets = scratch.keep(shingle_arrays(texts, k), f"{name}-sets")
    side = lambda x: sets.select(F.col("class").alias(x), F.col("shingles").alias(f"set_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    p, q = x.values.to_numpy(), y.values.to_numpy()
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * common >= percent * (len(p) + len(q) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    links = scratch.keep(joined.mapInArrow(run, "a long, b long").distinct(), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-wanted", f"{name}-pairs")
    return links


def _near(rows: DataFrame, tile: WindowSpec, percent: int) -> DataFrame:
    """Each row of a tile with the one before it by size and with the tile's centre, if the two may be similar."""
    facts = ("class", "n", "most", "last")
    centre = F.max(F.struct((F.col("most") / F.col("n")).alias("r"), *facts)).over(tile)
    rows = rows.withColumn("before", F.lag(F.struct(*facts)).over(tile.orderBy("n", "class"))).withColumn("centre", centre)
    other = F.explode(F.array(*(F.struct(F.col(f"{x}.class").alias("a"), F.col(f"{x}.n").alias("n_a"), F.col(f"{x}.most").alias("most_a"), F.col(f"{x}.last").alias("last_a")) for x in ("before", "centre"))))
    pairs = rows.select(*(F.col(x).alias({"class": "b"}.get(x, f"{x}_b")) for x in facts), other.alias("x")).select("b", "n_b", "most_b", "last_b", "x.*").where("a is not null and a != b")
    return pairs.where(_sizes_fit(F.col("n_a"), F.col("n_b"), percent) & _reaches(_most_common(), percent))


def _first_pairs(tiles: DataFrame, nodes: DataFrame, split: bool, percent: int, scratch: Scratch) -> DataFrame:
    """For each class the most promising pair of those that stand together in a part of a tile; and where tiles have
    parts, pairs that tie the centres of a tile's parts together."""
    nearest = W.partitionBy("b").orderBy(F.desc("tiles"), "a")
    few = _near(tiles, W.partitionBy("key", "part"), percent).groupBy("a", "b").agg(F.count("*").alias("tiles"))
    few = few.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= FIRST_TRIES).select("a", "b")
    best = _bounded(few, nodes, percent).groupBy("b").agg(F.max_by("a", F.struct("bound", "a")).alias("a")).select("a", "b")
    if split:
        r = F.struct((F.col("most") / F.col("n")).alias("r"), "class", "n", "most", "last")
        centres = tiles.where("parts > 1").groupBy("key", "part").agg(F.max(r).alias("c")).select("key", "c.*")
        across = scratch.keep(_near(centres, W.partitionBy("key"), percent).select("a", "b").distinct(), "across")
        best = best.unionByName(_bounded(across, nodes, percent).select("a", "b"))
    return best


def _rest_pairs(tiles: DataFrame, parts: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """All pairs of a tile in different components that may reach the threshold; none: no tile has two components."""
    labelled = tiles.join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    labelled = scratch.keep(labelled, "labelled")
    mixed, seen = scratch.measured(labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key"), "mixed")
    if not seen["rows"]:
        return None
    base = 1.001 * 100 / percent
    band = F.floor(F.log(F.col("n")) / math.log(base)).cast("int")
    rows = labelled.join(mixed, "key").withColumn("band", band)
    facts = ("class", "n", "most", "last", "pos", "rank", "component")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = rows.select("key", F.col("part").alias("part_a"), every.alias("part_b"), "band", *(F.col(x).alias(f"{x}_a") for x in facts))
    a = a.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    b = rows.select("key", every.alias("part_a"), F.col("part").alias("part_b"), "band", *(F.col(x).alias(f"{x}_b") for x in facts))
    pairs = a.join(b, ["key", "band", "part_a", "part_b"]).where("component_a != component_b").where("n_a < n_b or (n_a = n_b and class_a < class_b)")
    pairs = pairs.where(_sizes_fit(F.col("n_a"), F.col("n_b"), percent) & _reaches(_most_from_here(), percent))
    return pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (links of its class with other classes)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prepared = scratch.keep(prepare(docs, k, percent), "prepared")

    first = prepared.where("signature is not null")
    entry = F.posexplode(F.arrays_zip("prefix", "parts"))
    entries = first.select("class", "n", entry.alias("pos", "x")).select("class", "n", "pos", F.col("x.prefix").alias("key"), F.col("x.parts").alias("parts"), F.pmod("class", "x.parts").cast("int").alias("part"))
    entries = entries.repartition("key", "part").distinct()
    by_class, own = W.partitionBy("key", "part").orderBy("class"), W.partitionBy("class")
    alone = F.lag("class").over(by_class).isNull() & F.lead("class").over(by_class).isNull() & (F.col("parts") == 1)
    shared = entries.withColumn("alone", alone).where("not alone").drop("alone")
    shared = shared.withColumn("rank", F.row_number().over(own.orderBy("pos")) - 1).withColumn("tiles", F.count("*").over(own))
    least_overlap = F.floor((percent * F.col("n") + 99) / 100)
    shared = shared.withColumn("most", least_overlap - 1 + F.col("tiles")).drop("tiles")
    ends = first.groupBy("class").agg(F.min("last").alias("last"))
    tiles, seen = scratch.measured(shared.join(ends, "class"), "tiles", parts=F.max("parts"))

    links = None
    if seen["rows"]:
        signed = first.groupBy("class").agg(F.min_by(F.struct("doc_id", "n", "signature", "last"), F.coalesce("doc_id", F.lit(2**63 - 1))).alias("x"))
        nodes = scratch.keep(signed.join(tiles.where("rank = 0").select("class", "most"), "class").select("class", "x.*", "most"), "nodes")
        links = _links(_first_pairs(tiles, nodes, seen["parts"] > 1, percent, scratch), nodes, docs, k, percent, scratch, "first")
        found = scratch.keep(connected_components(links, scratch, "near").select(F.col("node").alias("class"), "component"), "found")
        rest = _rest_pairs(tiles, found, percent, scratch)
        if rest is not None:
            more, new = scratch.measured(_links(_bounded(rest, nodes, percent), nodes, docs, k, percent, scratch, "rest"), "more")
            links = scratch.keep(links.unionByName(more).distinct(), "links")
            found = _joined(found, more, scratch) if new["rows"] else found

    ids = prepared.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    if links is None:
        labels = scratch.keep(ids.select("class", F.col("least").alias("component_id"), F.lit(0).cast("long").alias("n_links")), "labels")
    else:
        degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
        named = ids.join(found, "class", "left").join(degree, "class", "left").withColumn("component", F.coalesce("component", "class"))
        named = scratch.keep(named, "named")
        least = scratch.keep(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
        labels = scratch.keep(named.join(least, "component").select("class", "component_id", "n_links"), "labels")
    out = prepared.select("doc_id", "class", "n").join(labels, "class", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = scratch.keep(out, "out")
    scratch.drop_all_but("out")
    return out


def _joined(found: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, component) of the components ``found`` with further links between their classes."""
    name = lambda x: found.select(F.col("class").alias(x), F.col("component").alias(f"c_{x}"))
    between = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    above = scratch.keep(connected_components(between, scratch, "across-components").select("node", F.col("component").alias("top")), "above")
    moved = found.join(above, found["component"] == above["node"], "left").select("class", F.coalesce("top", "component").alias("component"))
    single = above.select(F.col("node").alias("class"), F.col("top").alias("component")).join(found, "class", "left_anti")
    return scratch.keep(moved.unionByName(single), "joined")
