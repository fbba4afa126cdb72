"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame expressions only.

Words are cut into blocks of equal size, some ``DEALT`` for the whole mix. All blocks are dealt to sources by highest
quotients ``target / (2k + 1)``; sources with less than ``BLOCKS`` of them stand there as one party, and what that party
wins is dealt among them in the same way in blocks ``BLOCKS`` times smaller, and so on down to single words. Each source's
blocks are dealt to its shards in the same way by the shards' words, so every shard has an integer quota that it can fill
alone. Inside a shard the documents lie in a seeded order, end to end; a quota
of q over n blocks takes every block ``q div n`` times and, once more, the ``q mod n`` blocks with the least seeded
hashes of (source, shard, block). A document takes what its blocks take.

Work at scale: one pass over the texts gives their sizes; all else works on (id, source, size). Highest quotients
need no list of all quotients: the seats of a party lie within a known distance of its share, so each party lists
only that many and the rest are certain. A source is split into shards of about ``SHARD_WORDS`` words (and at most
about ``MOST_SHARDS`` in all) by a hash of id and text, so a hot source is many tasks. The targets come from a few
sums over the table of sources; only the deal of the blocks needs the sources, one row each, in one place.

Defined cases: null and empty texts have size 0 and take nothing; a very long text lies over as many blocks as it
needs; a null source is a source of its own, after all others; null ids are told apart by their texts; without words
all targets are 0; repeated rows are documents of their own; an empty table gives no rows; a document never takes more
than twice its size, as no block is taken more than twice; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch

WEIGHTS, SHARE, MOST_TIMES = (3, 1, 2), 1.5, 2
SHARD_WORDS, MOST_SHARDS = 1 << 16, 1 << 20
#: Blocks of the mix, about; blocks of a source at least, where it is not one of a party; sources ranked in one place.
DEALT, BLOCKS, RANKED = 1 << 20, 256, 50_000
#: Halvings of the range of quotients at most; a double has no more bits.
HALVINGS = 200
#: Rows of the source table that are broadcast at most.
BROADCAST_ROWS = 100_000
#: Rounds of sharing an excess; each binds a further cap, most of them many.
MOST_ROUNDS = 200


def size_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def ranked_sources(sums: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``k``, the place of each source by code point, null last: ranges of the names first, then inside each."""
    parts = sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    parts = scratch.keep(parts, "ranges")
    before = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("i", inside).join(F.broadcast(before.select("part", "before")), "part").withColumn("k", F.col("before") + F.col("i") - 1).drop("part", "before", "i")


def source_targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES) -> DataFrame:
    """source, source_size, target: the shares by weight, capped, with the excess shared again by weight.

    A round shares what the capped sources leave over all others; the caps below their share bind from then on. No
    share ever falls, so this ends with the level at which no source is above its cap.
    """
    sums = ranked_sources(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), scratch)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights)).cast("int") + 1)
    sums = scratch.keep(sums.select("source", "source_size", weight.alias("w"), (F.lit(float(most_times)) * F.col("source_size")).alias("cap")), "sums")
    total = share * (sums.agg(F.sum("source_size")).first()[0] or 0)
    level, bound = 0.0, -1
    for _ in range(MOST_ROUNDS):
        capped = F.col("cap") <= F.col("w") * F.lit(level)
        n, taken, rest = sums.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w")))).first()
        if n == bound or not rest:
            break
        bound, level = n, (total - taken) / rest
    else:
        raise RuntimeError("the excess is still shared after MOST_ROUNDS rounds")
    return sums.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


def apportion(parties: DataFrame, seats: Column, votes: str, within: list[str], order: list[Column]) -> DataFrame:
    """Adds ``quota``: ``seats`` of each group ``within`` dealt to its rows by Sainte-Laguë; ties go by ``order``.

    With n parties and N seats, the seats of a party with the share q lie in q * (1 -/+ n / 2N) -/+ 1, so only
    about 3n quotients of a group are ranked.
    """
    group = W.partitionBy(*within)
    all_votes, n = F.sum(votes).over(group), F.count("*").over(group)
    shared = parties.withColumn("_seats", seats).withColumn("_q", F.when(all_votes > 0, F.col(votes) / all_votes * F.col("_seats")).otherwise(F.lit(0.0)))
    slack = n / (2 * F.greatest(F.col("_seats"), F.lit(1)))
    shared = shared.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_q") * (1 - slack) - 1))).withColumn("_high", F.ceil(F.col("_q") * (1 + slack) + 1))
    shared = shared.withColumn("_low", F.when(F.col(votes) > 0, F.col("_low")).otherwise(F.lit(0)).cast("long")).withColumn("_open", F.col("_seats") - F.sum("_low").over(group))
    listed = shared.withColumn("_k", F.explode(F.sequence("_low", F.col("_high").cast("long"))))
    ranked = listed.withColumn("_rank", F.row_number().over(group.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *order, "_k")))
    won = (F.col("_rank") <= F.col("_open")) & (F.col(votes) > 0)
    keys = [c for c in parties.columns]
    return ranked.groupBy(*keys).agg((F.min("_low") + F.sum(won.cast("long"))).alias("quota"))


def dealt(parties: DataFrame, seats: int, votes: str, order: list[Column]) -> DataFrame:
    """Adds ``quota``: ``seats`` dealt to all rows by Sainte-Laguë; the same as ``apportion`` without groups.

    A party's seats are the number of its quotients above some level. The level is closed in from both sides by sums over
    the table until the parties whose seats still differ between the two are few; those alone are ranked.
    """
    n, total = parties.agg(F.count_if(F.col(votes) > 0), F.sum(votes)).first()
    if n <= RANKED or seats <= 0:
        return apportion(parties, F.lit(seats).cast("long"), votes, [], order)
    won = lambda level: F.when(F.col(votes) > 0, F.floor(F.col(votes) / F.lit(2 * level) + 0.5)).otherwise(F.lit(0)).cast("long")
    low, high = total / (2 * seats + 2 * n + 2), 2 * total  # of quotients: at the low one too many are dealt, at the high one none
    for _ in range(HALVINGS):
        middle = (low * high) ** 0.5 if high > 4 * low else (low + high) / 2
        if not low < middle < high:
            break
        got, near_low, near_high = parties.agg(F.sum(won(middle)), F.count_if(won(low) != won(middle)), F.count_if(won(middle) != won(high))).first()
        low, high, near = (middle, high, near_high) if got >= seats else (low, middle, near_low)
        if near <= RANKED:
            break
    sure = parties.withColumn("_sure", won(high))
    left = seats - (sure.agg(F.sum("_sure")).first()[0] or 0)
    open_ = sure.withColumn("_most", won(low)).where("_most > _sure").withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)))
    ranked = open_.withColumn("_rank", F.row_number().over(W.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *order, "_k"))).where(F.col("_rank") <= left)
    more = ranked.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("_more"))
    return sure.join(more, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("quota", F.col("_sure") + F.coalesce("_more", F.lit(0))).drop("_sure", "_source", "_more")


def source_quotas(targets: DataFrame, total: float, scratch: Scratch) -> DataFrame:
    """Adds block (its words) and quota (in blocks) to sources (source, source_size, target).

    All sources are in one deal: those with too few blocks for a near quota are one party of it, and share what it wins in
    a deal of their own with smaller blocks. Sources without words have no blocks.
    """
    words, given = max(1, int(total // DEALT)), int(round(total))
    order = [F.col("pool").cast("int"), F.col("source").asc_nulls_last()]
    kind = targets.schema["source"].dataType
    left, out, level = targets.withColumn("pool", F.lit(False)), None, 0
    while True:
        seats = int(round(given / words))
        alone = left.where((F.col("target") >= words * BLOCKS) | F.lit(words == 1))
        small = left.where((F.col("target") < words * BLOCKS) & F.lit(words > 1))
        pool = small.agg(F.lit(None).cast(kind).alias("source"), F.sum("source_size").alias("source_size"), F.sum("target").alias("target"), F.lit(True).alias("pool")).where("target > 0")
        found = scratch.keep(dealt(alone.unionByName(pool), seats, "target", order).withColumn("block", F.lit(words).cast("long")), f"deal-{level}")
        out = found.where("not pool") if out is None else out.unionByName(found.where("not pool"))
        won = found.where("pool").agg(F.sum("quota")).first()[0]
        if words == 1:
            return out.drop("pool")
        if won is None:  # nothing is pooled but sources without words
            return out.unionByName(small.withColumn("quota", F.lit(0).cast("long")).withColumn("block", F.lit(words).cast("long"))).drop("pool")
        given, words, left, level = won * words, max(1, words // BLOCKS), small, level + 1


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES, seed: int = 2024) -> DataFrame:
    """doc_id, source, size, source_size, target, shard, taken."""
    scratch = Scratch(docs.sparkSession)
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sizes = scratch.keep(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), draw.alias("draw")), "sizes")
    targets, facts = scratch.measured(source_targets(sizes, scratch, weights, share, most_times), "shares", total=F.sum("target"))
    total = facts["total"] or 0
    shard_words = max(SHARD_WORDS, int(total // MOST_SHARDS))
    sources = source_quotas(targets, total, scratch).withColumn("shards", F.ceil(F.col("source_size") / shard_words).cast("long")).withColumnRenamed("quota", "source_quota")
    sources, facts = scratch.measured(sources, "sources")

    side = sources.withColumnRenamed("source", "name")
    side = F.broadcast(side) if facts["rows"] <= BROADCAST_ROWS else side
    placed = sizes.join(side, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("shard", F.pmod(F.col("draw"), F.greatest(F.col("shards"), F.lit(1))))
    shards = placed.where("size > 0").groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("source_quota").alias("source_quota"), F.max("block").alias("block"))
    quotas = apportion(shards, F.col("source_quota"), "shard_size", ["source"], [F.col("shard")])
    luck = lambda b: F.xxhash64(F.lit(seed), F.col("source"), F.col("shard"), b)
    blocks = F.ceil(F.col("shard_size") / F.col("block")).cast("long")
    quotas = quotas.withColumn("blocks", blocks).withColumn("quota", F.least(F.col("quota"), most_times * F.col("blocks")))
    quotas = quotas.withColumn("times", F.floor(F.col("quota") / F.col("blocks")).cast("long")).withColumn("more", (F.col("quota") % F.col("blocks")).cast("int"))
    cutoff = F.when(F.col("more") > 0, F.element_at(F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), luck)), F.col("more")))
    quotas = quotas.select(F.col("source").alias("name"), F.col("shard").alias("part"), "times", cutoff.alias("cutoff"))

    lined = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("draw")), "doc_id", "size")
    ends = placed.withColumn("end", F.sum("size").over(lined.rowsBetween(W.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    joined = ends.join(quotas, F.col("source").eqNullSafe(F.col("name")) & (F.col("shard") == F.col("part")), "left")
    span = F.sequence(F.floor(F.col("start") / F.col("block")).cast("long"), F.floor((F.col("end") - 1) / F.col("block")).cast("long"))
    extra = F.aggregate(
        span,
        F.lit(0).cast("long"),
        lambda acc, b: acc + F.when(luck(b) <= F.col("cutoff"), F.least(F.col("end"), (b + 1) * F.col("block")) - F.greatest(F.col("start"), b * F.col("block"))).otherwise(F.lit(0)).cast("long"),
    )
    taken = F.when(F.col("size") > 0, F.col("times") * F.col("size") + F.when(F.col("cutoff").isNotNull(), extra).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", "shard", taken.alias("taken"))
