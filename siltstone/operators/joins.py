"""Merges, patches, interval joins and small table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of ``over`` replace those of ``base`` column by column where they say something; new ones are added."""
    o = over.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_o_{c}") for c in over.columns if c != key))
    joined = base.join(o, base[key] == o["_k"], "full_outer")
    return joined.select(F.coalesce(F.col(key), F.col("_k")).alias(key), *(F.coalesce(F.col(f"_o_{c}"), F.col(c)).alias(c) if c in over.columns else F.col(c) for c in base.columns if c != key))


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of ``changes`` by key; rows without a change stay."""
    c = changes.select(F.col(key).alias("_k"), *(F.col(x).alias(f"_c_{x}") for x in changes.columns if x != key))
    joined = base.join(c, base[key] == c["_k"], "left")
    return joined.select(*(F.coalesce(F.col(f"_c_{x}"), F.col(x)).alias(x) if x != key and x in changes.columns else F.col(x) for x in base.columns))


def upsert_issues(old: DataFrame, new: DataFrame) -> DataFrame:
    """Issues by fingerprint: the first sight stays, the last one moves, what is not found again is closed."""
    n = new.withColumnRenamed("fp", "_fp")
    j = old.join(n, old["fp"] == n["_fp"], "full_outer")
    return j.select(F.coalesce("fp", "_fp").alias("fp"), F.coalesce("first_seen", "run").alias("first_seen"), F.coalesce("run", "last_seen").alias("last_seen"), F.when(F.col("_fp").isNull(), "closed").otherwise("open").alias("status"))


def daily_spine(counts: DataFrame, last: DataFrame, days: int, values: list[str]) -> DataFrame:
    """The last ``days`` days with zeros where nothing happened; ``last`` is one row with the newest day."""
    spine = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return spine.join(counts, "day", "left").select("day", *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def bucket_deltas(events: DataFrame, key: str) -> DataFrame:
    """+1 for the bucket that a key enters and -1 for the one that it leaves, at every event."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    d = events.withColumn("_before", F.lag("bucket").over(w))
    both = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(1).alias("delta")), F.struct(F.col("_before").alias("bucket"), F.lit(-1).alias("delta")))
    return d.select(F.explode(both).alias("x")).select("x.bucket", "x.delta").where("bucket is not null")


def stuck_jobs(jobs: DataFrame) -> DataFrame:
    """Failed jobs, those running for over an hour, and those pending for over a day, seen from the newest job."""
    now = jobs.agg(F.max("ts").alias("now"))
    running = (F.col("status") == "running") & (F.col("ts") < F.expr("now - INTERVAL 1 HOUR"))
    pending = (F.col("status") == "pending") & (F.col("ts") < F.expr("now - INTERVAL 1 DAY"))
    return jobs.crossJoin(F.broadcast(now)).withColumn("stuck", (F.col("status") == "failed") | running | pending).drop("now")


def retention(rows: DataFrame, days: int, spared: Column) -> DataFrame:
    """``due``: older than so many days before the newest row, and not spared."""
    now = rows.agg(F.max("ts").alias("now"))
    return rows.crossJoin(F.broadcast(now)).withColumn("due", (F.col("ts") < F.col("now") - F.make_interval(days=F.lit(days))) & ~spared).drop("now")


def version_hash(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """A hash of each group's rows in the order of their first field; a group is a rule set."""
    row = F.concat_ws("|", *(F.col(f).cast("string") for f in fields))
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(fields[0]).alias("k"), row.alias("v")))).alias("x"))
    return g.select(*by, F.substring(F.sha2(F.array_join(F.transform("x", lambda r: r["v"]), "\n"), 256), 1, 24).alias("version"))


def resolve_ids(refs: DataFrame, catalogue: DataFrame, prefix: str) -> DataFrame:
    """Catalogue id of each reference: exact, else by the repository prefix; external ids stay as they are."""
    own = ~F.col("id").startswith("EXT:")
    exact = catalogue.select(F.col("rule_id").alias("_exact"))
    tail = catalogue.select(F.col("rule_id").alias("_tail"), F.concat(F.lit(prefix), "rule_id").alias("_with"))
    j = refs.join(exact, own & (F.col("id") == F.col("_exact")), "left").join(tail, own & (F.col("id") == F.col("_with")), "left")
    return j.select(*refs.columns, F.coalesce("_exact", "_tail", "id").alias("resolved"))


def drift(stored: DataFrame, rebuilt: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Ids whose rows differ, with the first field that does."""
    b = rebuilt.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_b_{f}") for f in fields))
    j = stored.join(b, stored[key] == b["_k"], "full_outer")
    first = F.when(F.col("_k").isNull(), "missing").when(F.col(key).isNull(), "extra")
    for f in fields:
        first = first.when(~F.col(f).eqNullSafe(F.col(f"_b_{f}")), f)
    return j.select(F.coalesce(F.col(key), F.col("_k")).alias(key), first.alias("first_difference")).where("first_difference is not null")


def global_place(rows: DataFrame, key: str, descending: bool = False, buckets: int = 1 << 10) -> DataFrame:
    """Place of every row in the order of an integer key without one task for all: ranges of the key, then inside."""
    span = rows.agg(F.min(key).alias("_a"), F.max(key).alias("_b"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_b") - F.col("_a") + 1) / buckets))
    order = F.desc if descending else F.asc
    part = rows.crossJoin(F.broadcast(span)).withColumn("_p", F.floor((F.col(key) - F.col("_a")) / width)).drop("_a", "_b")
    counts = part.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(W.orderBy(order("_p"))) - F.col("_n")).alias("_before"))
    inside = part.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(order(key))))
    return inside.join(F.broadcast(before), "_p").withColumn("place", (F.col("_before") + F.col("_i")).cast("long")).drop("_p", "_i", "_before")


def place_in_group(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Adds ``place`` (from 1) of every row in the order of its group, and ``group_size``, however large a group is.

    Rows are sorted in ranges of group and order together; what is summed over all is one count for each range and each
    group. Null groups are a group.
    """
    from siltstone.operators.graph import cut

    keys = [F.col(by).asc_nulls_first(), *order]
    kept = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_r", F.monotonically_increasing_id()))
    part = F.shiftright("_r", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = kept.join(F.broadcast(before), part == F.col("_part")).withColumn("_at", F.col("_before") + F.col("_r").bitwiseAND((1 << 33) - 1))
    groups = numbered.groupBy(F.col(by).alias("_by")).agg(F.min("_at").alias("_first"), F.count("*").alias("group_size"))
    out = numbered.join(groups, F.col(by).eqNullSafe(F.col("_by")))
    return out.withColumn("place", F.col("_at") - F.col("_first") + 1).select(*rows.columns, "place", "group_size")


def innermost(points: DataFrame, units: DataFrame, point_id: str, keep: list[str], first: bool = False) -> DataFrame:
    """The enclosing unit (path, start, end) of each point (path, ln): the latest start, or the first one."""
    u = units.select(F.col("path").alias("_p"), "start", "end", *keep)
    j = points.join(u, (F.col("path") == F.col("_p")) & F.col("ln").between(F.col("start"), F.col("end")))
    pick = (F.min_by if first else F.max_by)(F.struct("start", "end", *keep), F.struct("start", "end"))
    return j.groupBy(point_id).agg(pick.alias("u")).select(point_id, "u.*")


def on_changed_lines(found: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings on changed lines; paths match if either is the other's tail at a slash, by a join on exploded tails."""

    def tails(df: DataFrame) -> DataFrame:
        parts = F.split("path", "/")
        every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        return df.withColumn("_tail", F.explode(every))

    a = tails(found.select("fid", "path", "ln")).join(changed.select(F.col("path").alias("_tail"), "ln"), ["_tail", "ln"]).select("fid")
    b = tails(changed.select("path", "ln")).select(F.col("_tail").alias("path"), "ln").join(found.select("fid", "path", "ln"), ["path", "ln"]).select("fid")
    return found.join(a.union(b).distinct(), "fid", "left_semi")


def changed_coverage(changed: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per path: executable changed lines and covered ones. A path without coverage counts all its lines as uncovered."""
    known = coverage.select("path").distinct().withColumn("_known", F.lit(True))
    j = changed.join(coverage, ["path", "ln"], "left").join(known, "path", "left")
    executable = F.col("hit").isNotNull() | F.col("_known").isNull()
    g = j.groupBy("path").agg(F.count_if(executable).alias("executable"), F.count_if(F.coalesce("hit", F.lit(False))).alias("covered"))
    return g.withColumn("pct", F.when(F.col("executable") > 0, F.round(100 * F.col("covered") / F.col("executable"), 1)).otherwise(100.0))


def covered_complexity(units: DataFrame, coverage: DataFrame) -> DataFrame:
    """Units with any covered line, and their share of the complexity."""
    hit = coverage.where("hit").select(F.col("path").alias("_p"), "ln")
    on = (units["path"] == hit["_p"]) & hit["ln"].between(units["start"], units["end"])
    return units.join(hit, on, "left_semi").withColumn("covered", F.lit(True)).unionByName(units.join(hit, on, "left_anti").withColumn("covered", F.lit(False)))


def curated(generated: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Selected rows with the patch's fields over the generated ones, and ``missing`` where no row was generated.

    Only ids with a patch are selected; an orphan patch (``orphan`` true) stands for itself.
    """
    g = generated.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_g_{c}") for c in generated.columns if c != key))
    j = patches.join(g, patches[key] == g["_k"], "left")
    fields = [c for c in generated.columns if c != key]
    return j.select(key, *(F.coalesce(F.col(c), F.col(f"_g_{c}")).alias(c) for c in fields), (F.col("_k").isNull() & ~F.col("orphan")).alias("missing"))


def coverage_scope(new_code: Column, overall: Column) -> Column:
    """What a gate's coverage is measured on: changed lines if there is a diff, else everything, else nothing."""
    return F.when(new_code.isNotNull(), "new-code").when(overall.isNotNull(), "overall").otherwise("none")


def due_scans(scans: DataFrame, now: DataFrame, shards: int = 24, most: int = 300) -> DataFrame:
    """Enabled repositories whose next run has come (or was never set), by shard, the longest due first.

    ``now`` has one row. A shard takes at most ``most`` at a time; the rest stay due.
    """
    from siltstone.functions.text import shard_of

    due = scans.crossJoin(F.broadcast(now)).where("enabled and (next_run is null or next_run <= now)").withColumn("shard", shard_of(F.col("repo"), shards))
    w = W.partitionBy("shard").orderBy(F.col("next_run").asc_nulls_first(), "repo")
    return due.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
