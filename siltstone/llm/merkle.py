"""Merkle manifest of a dataset: a leaf per row, a tree of eight-fold nodes per language, one root over the languages.

Rows are numbered in the order of (lang, doc_id, leaf) by ranges of that key, so no task sees a whole language. Each
aligned block of 512 nodes keeps its levels as hex strings of 64 characters a node: substrings of 512 characters hash to
the parents, and what stands before and after a node in its substring is that level's segment of its proof. The tops of
all blocks are the nodes of the next round, in which a language has a 512th of its nodes, until each has one node, its
subroot. The subroots are the nodes of one more tree, and its top is the root. Going back down, each block hands its
members the segments that it was given with their own in front. All of it is SQL functions; only leaves, not texts, move.

Defined cases: nulls of any column hash as ``-``; a null lang is a language of its own, before the others; a null doc_id
comes first in its language. Rows that share a doc_id follow their leaves; equal rows are leaves side by side, each with
its own proof. Empty and very long texts are hashed whole. Rows without a doc_id are never tampered with. An empty table
has no rows and no root. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch

#: Hex characters of a node, nodes hashed together, levels inside a block.
HEX, FAN, DEPTH = 64, 8, 3
BLOCK = FAN**DEPTH
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Groups whose first places are broadcast at most (some 60 bytes each); more go through a join.
BROADCAST_GROUPS = 200_000


def leaf_hash(**columns: Column) -> Column:
    """Hash of the columns in order, each as its UTF-8 length, a colon and the value, or ``-``."""
    parts = []
    for value in columns.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The rows with their place (from 0) in the order of some columns, nulls first. Ranges of the key are sorted by
    themselves; what is summed over all is one count for each range."""
    row = F.monotonically_increasing_id()
    kept = scratch.keep(rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order)).withColumn("_row", row), name)
    part = F.shiftright("_row", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row for each range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(before), part == F.col("_part")).withColumn("place", F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_row", "_part", "_before")


def hashed_level(level: Column) -> Column:
    """The hex string of the parents of a level."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (HEX * FAN)).cast("int"))
    raw = level.cast("binary")
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(raw, i * (HEX * FAN) + 1, F.lit(HEX * FAN)), 256)), "")


def segment(level: Column, at: Column) -> Column:
    """The siblings before and after the node at a place of a level."""
    raw = level.cast("binary")
    first = at - at % FAN
    last = first + FAN - 1
    before = F.substring(raw, first * HEX + 1, (at - first) * HEX)
    return F.struct(before.cast("string").alias("before"), F.substring(raw, (at + 1) * HEX + 1, (last - at) * HEX).cast("string").alias("after"))


def fold(nodes: DataFrame) -> DataFrame:
    """One round. From (grp, n, pos, node, own): a row (grp, n, block, members, l0, l1, l2, top) for each block; members
    are (pos, node, own) by pos, n is the number of nodes in the group."""
    blocks = nodes.groupBy("grp", "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "node", "own"))).alias("members"))
    level = F.array_join(F.transform("members", lambda m: m["node"]), "")
    blocks = blocks.withColumn("l0", level)
    for k in range(1, DEPTH + 1):
        blocks = blocks.withColumn(f"l{k}", F.when(F.col("n") > FAN ** (k - 1), hashed_level(F.col(f"l{k - 1}"))))
    return blocks.withColumn("top", F.coalesce(*(f"l{k}" for k in range(DEPTH, -1, -1)))).drop(f"l{DEPTH}")


def handed_down(blocks: DataFrame) -> DataFrame:
    """The members of blocks that were given ``above``: (grp, pos, node, own, path), path being the segments from a
    member up to the root."""
    at = lambda i, k: F.floor(i / FAN**k).cast("int")
    levels = lambda i: F.filter(F.array(*(F.when(F.col("n") > FAN**k, segment(F.col(f"l{k}"), at(i, k))) for k in range(DEPTH))), lambda s: s.isNotNull())
    members = F.transform("members", lambda m, i: F.struct(m["pos"].alias("pos"), m["node"].alias("node"), m["own"].alias("own"), levels(i).alias("steps")))
    rest = [c for c in blocks.columns if c in ("subroot", "root")]
    return blocks.select("grp", "above", *rest, F.inline(members)).select("grp", "pos", "node", "own", *rest, F.concat("steps", "above").alias("path"))


def rounds(nodes: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """Blocks of every round, the last with one block for each group. A round after the first has a 512th of the nodes."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    out = []
    while True:
        out.append(scratch.keep(fold(nodes), f"{name}-{len(out)}"))
        if largest <= BLOCK:
            return out
        largest = -(-largest // BLOCK)
        nodes = out[-1].select("grp", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("pos"), F.col("top").alias("node"), F.lit(None).cast("string").alias("own"))


def down(blocks: list[DataFrame], above: DataFrame) -> DataFrame:
    """Members of the first round with their whole paths. ``above``: what each group is given (grp, above, ...)."""
    given = above.withColumn("block", F.lit(0).cast("long"))
    for k, round_ in enumerate(reversed(blocks)):
        given = handed_down(round_.join(given, ["grp", "block"]))
        if k < len(blocks) - 1:
            given = given.select("grp", F.col("pos").alias("block"), F.col("path").alias("above"), *(c for c in given.columns if c in ("subroot", "root")))
    return given


def grown(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """Proofs of leaves (lang, doc_id, leaf, own): own, leaf, subroot, root and path (before and after of each level)."""
    rows = placed(leaves, ["lang", "doc_id", "leaf"], scratch, "placed")
    groups, seen = scratch.measured(rows.groupBy("lang").agg(F.min("place").alias("grp"), F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "_lang"), "groups")
    side = F.broadcast(groups) if seen["rows"] <= BROADCAST_GROUPS else groups
    nodes = rows.join(side, F.col("lang").eqNullSafe(F.col("_lang"))).select("grp", "n", (F.col("place") - F.col("grp")).alias("pos"), F.col("leaf").alias("node"), F.struct("doc_id", "own").alias("own"))
    trees = rounds(nodes, scratch, "tree")
    # The subroots by lang, as nodes of one group.
    tops = placed(trees[-1].select("grp", F.col("top").alias("node")), ["grp"], scratch, "subroots")
    subroots = tops.select(F.lit(0).cast("long").alias("grp"), F.lit(seen["rows"]).cast("long").alias("n"), F.col("place").alias("pos"), "node", F.col("grp").cast("string").alias("own"))
    crown = rounds(subroots, scratch, "crown")
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    given = down(crown, crown[-1].select("grp", nothing.alias("above"), F.col("top").alias("root")))
    above = given.select(F.col("own").cast("long").alias("grp"), F.col("node").alias("subroot"), "root", F.col("path").alias("above"))
    return down(trees, above).select("own.*", F.col("node").alias("leaf"), "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_text(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame) -> DataFrame:
    """Each row's doc_id with its leaf, subroot, root and path."""
    scratch = Scratch(docs.sparkSession)
    leaves = docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(**{c: F.col(c) for c in COLUMNS}).alias("leaf"), F.lit(None).cast("string").alias("own"))
    return grown(scratch.keep(leaves, "leaves"), scratch).drop("own")


def audit(docs: DataFrame, tampered: Column, changed_text: Column) -> DataFrame:
    """The manifest of all rows held against rows of which some have another text: doc_id, leaf, subroot, root,
    proof_sha256, folded_root (from what the rows hold now) and verified."""
    scratch = Scratch(docs.sparkSession)
    columns = {c: F.col(c) for c in COLUMNS}
    now = F.when(tampered, leaf_hash(**columns | {"text": changed_text}))
    leaves = docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(**columns).alias("leaf"), now.alias("own"))
    found = grown(scratch.keep(leaves, "leaves"), scratch)
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("own", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def digest(docs: DataFrame) -> DataFrame:
    """The audit after letters A-Z of every third text, by crc32 of the id, were made small."""
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return audit(docs, third, ascii_lower(F.col("text")))
