"""Call and import graphs: degrees, hops, cycles, coupling, resolution, reachability.

Graphs are edge tables. Iterative operators keep only a frontier or labels between rounds, cut the plan with
tables written to the cluster's shared folder, and stop on an empty frontier or unchanged labels. Where a number of
rounds is part of the meaning (hops, depth of flows) it is a parameter; elsewhere running out of rounds is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found


def cut(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read from there.

    A written table starts a new plan; a checkpointed one would carry the constraints of all rounds before it along.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of a loop. A name's table of an earlier round is deleted when the next one is written, as nothing reads it
    any more; only the last of each name stays for the result."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.round, self.last = spark, f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}", 0, {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.round += 1
        path = f"{self.top}/{name}-{self.round}"
        df.write.parquet(path)
        self.drop(name)
        self.last[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.last.pop(name, None):
                old = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                old.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)


def priority(fan_in: Column, hops: Column) -> Column:
    from siltstone.functions.quality import reach

    return F.round(0.55 * F.least(F.lit(1.0), fan_in / 20) + 0.45 * reach(hops), 3)


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out; repeated edges count."""
    both = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def hops_from(entries: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """Fewest calls from any entry to each node, up to ``most``: one search from all entries at once."""
    seen = cut(entries.select("node").distinct().withColumn("hops", F.lit(0)))
    frontier, links = seen, cut(edges.select("src", "dst").distinct())
    for step in range(1, most + 1):
        reached = frontier.join(links, frontier["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen, "node", "left_anti").withColumn("hops", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier)) if step % 4 == 0 else seen.unionByName(frontier)
    return seen


def trim(edges: DataFrame, most: int = 3) -> DataFrame:
    """Edges between nodes that have both callers and callees, a few times over: what is left can lie on cycles."""
    steps = Steps(edges.sparkSession)
    now, n = steps.cut(edges.select("src", "dst").where("src != dst").distinct(), "now"), -1
    for _ in range(most):
        n = now.count()
        heads, tails = now.select(F.col("dst").alias("n")).distinct(), now.select(F.col("src").alias("n")).distinct()
        both = heads.intersect(tails)
        now = steps.cut(now.join(both.withColumnRenamed("n", "src"), "src", "left_semi").join(both.withColumnRenamed("n", "dst"), "dst", "left_semi"), "now")
        if now.count() == n:
            break
    return now


def _spread(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(node, label): of the nodes that reach each node along edges src -> dst, the one that comes first.

    Nodes come in the order of their hashes, so a label is (hash, node). A round takes the first label of the nodes
    before and then the label of one's label, which also reaches the node: paths are covered in growing steps, whatever
    the ids along them.
    """
    own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n"))
    steps = Steps(nodes.sparkSession)
    labels = steps.cut(nodes.select("node", own.alias("label")), "labels")
    for _ in range(most):
        incoming = labels.join(edges, labels["node"] == edges["src"]).groupBy("dst").agg(F.min("label").alias("new"))
        near = labels.join(incoming, labels["node"] == incoming["dst"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("new", "label")).alias("label"))
        near = steps.cut(near, "near")
        far = near.select(F.col("node").alias("_n"), F.col("label").alias("_far"))
        nxt = steps.cut(near.join(far, near["label"]["n"] == far["_n"], "left").select("node", "old", F.least("label", F.coalesce("_far", "label")).alias("label")), "labels")
        labels = nxt.select("node", "label")
        if nxt.where("label < old").isEmpty():
            steps.drop("near")
            return labels
    raise RuntimeError(f"labels still change after {most} rounds")


def cycles(edges: DataFrame, most: int = 200) -> DataFrame:
    """Strongly connected components of more than one node: (node, component), named by their least node.

    Each round colours nodes by the first node that reaches them. Of a colour, the nodes whose first reachable node
    inside it is the colour itself reach its root and are one component. They leave, and the rest is coloured again.
    """
    left, out = trim(edges), None
    for _ in range(most):
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colour = _spread(nodes, left, most)
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        back = cut(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        reach_root = _spread(nodes, back, most).select(F.col("node").alias("_n"), F.col("label").alias("_first"))
        found = cut(colour.join(reach_root, (colour["node"] == F.col("_n")) & (colour["label"] == F.col("_first"))).select("node", F.col("label.n").alias("root")))
        out = found if out is None else out.unionByName(found)
        gone = found.select("node")
        left = trim(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    else:
        if not left.isEmpty():
            raise RuntimeError(f"cycles are left after {most} rounds")
    if out is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    names = out.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1")
    return out.join(names, "root").select("node", "component")


def coupling(edges: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """node, ca, ce, instability (null for isolated nodes); imports of oneself don't count."""
    e = edges.where("src != dst").select("src", "dst").distinct()
    both = e.select(F.col("dst").alias("node"), F.lit(1).alias("a"), F.lit(0).alias("e")).unionByName(e.select(F.col("src").alias("node"), F.lit(0).alias("a"), F.lit(1).alias("e")))
    g = both.groupBy("node").agg(F.sum("a").alias("ca"), F.sum("e").alias("ce"))
    if external is not None:
        g = g.join(external, "node", "left")
    return g.withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, F.round(F.col("ce") / (F.col("ca") + F.col("ce")), 3)))


def resolve_calls(sites: DataFrame, definitions: DataFrame) -> DataFrame:
    """Target of each call site (site, file, name): the only definition in its file, else the only one at all."""
    here = definitions.groupBy(F.col("file").alias("_f"), F.col("name").alias("_n")).agg(F.count("*").alias("_k"), F.min("id").alias("_local")).where("_k = 1")
    all_ = definitions.groupBy(F.col("name").alias("_m")).agg(F.count("*").alias("_k2"), F.min("id").alias("_global")).where("_k2 = 1")
    r = sites.join(here, (F.col("file") == F.col("_f")) & (F.col("name") == F.col("_n")), "left").join(all_, F.col("name") == F.col("_m"), "left")
    return r.select("site", F.coalesce("_local", "_global", F.concat(F.lit("unresolved:"), "name")).alias("target"))


def resolve_imports(imports: DataFrame, files: DataFrame, guesses: list[str]) -> DataFrame:
    """File of each import (id, base): the first guess that exists, else ``module:`` and the name."""
    tries = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.concat("base", F.lit(g)).alias("path")) for i, g in enumerate(guesses))))
    hit = imports.select("id", tries.alias("x")).select("id", "x.i", "x.path").join(files.select("path"), "path").groupBy("id").agg(F.min_by("path", "i").alias("target"))
    return imports.join(hit, "id", "left").select("id", F.coalesce("target", F.concat(F.lit("module:"), "base")).alias("target"))


def flows(sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """Simple paths from sources to sinks that meet no sanitizer: (source, sink, path), one shortest path per pair.

    The search goes backwards from the sinks first: a place that no sink can be reached from in the steps that are left
    is never taken, so paths are only drawn where they lead somewhere. Between rounds stay one frontier, the pairs that
    were seen, each written once, and the rows of sinks; the last round, which is the largest, is not written at all. Rows
    hold only the places between both ends of a path; those were all seen, so paths are simple without a look at them.
    """
    clean = edges.join(sanitizers.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst").distinct()
    ends = cut(sinks.select(F.col("node").alias("at")).distinct())
    back = clean.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    useful = cut(hops_from(ends.select(F.col("at").alias("node")), back, most).select(F.col("node").alias("dst"), F.col("hops").alias("left")))
    clean = cut(clean.join(useful, "dst"))
    steps = Steps(edges.sparkSession)
    start = sources.select(F.col("node").alias("source"), F.col("node").alias("at"), F.array_remove(F.array("node"), F.col("node")).alias("via"))
    frontier, out = steps.cut(start, "frontier"), start.limit(0)
    seen = cut(frontier.select("source", "at"))
    for i in range(1, most + 1):
        via = F.concat("via", F.array("at")) if i > 1 else F.col("via")
        step = frontier.join(clean.where(F.col("left") <= most - i), frontier["at"] == clean["src"]).select("source", F.col("dst").alias("at"), via.alias("via"))
        step = step.groupBy("source", "at").agg(F.min("via").alias("via")).join(seen, ["source", "at"], "left_anti")
        if i == most:  # with no step left these are sinks, and nothing reads them but the result
            out = out.unionByName(step)
            break
        frontier = steps.cut(step, "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(cut(frontier.select("source", "at")))
        out = out.unionByName(cut(frontier.join(ends, "at", "left_semi")))
    return out.select("source", F.col("at").alias("sink"), F.concat(F.array("source"), "via", F.array("at")).alias("path"))


def hotspots(edges: DataFrame, k: int = 28) -> DataFrame:
    return degrees(edges).orderBy(F.desc("fan_in"), "node").limit(k)


def expand_includes(lines: DataFrame, most: int = 10) -> DataFrame:
    """Files with their includes in place: (file, place, text, origin, origin_line).

    ``lines`` has (file, ln, text, include, replace_from, replace_to). A row that includes a file gives its lines, with
    the replacement done; a file inside itself, a missing file or a nesting beyond ``most`` leaves the row as it is.
    """
    known = cut(lines.select(F.col("file").alias("_file"), F.col("ln").alias("_ln"), F.col("text").alias("_text"), F.col("include").alias("_include"), F.col("replace_from").alias("_from"), F.col("replace_to").alias("_to")))
    names = known.select(F.col("_file").alias("include")).distinct()
    now = lines.select("file", F.array("ln").alias("place"), "text", F.col("file").alias("origin"), F.col("ln").alias("origin_line"), "include", "replace_from", "replace_to", F.array("file").alias("stack"))
    done = None
    for _ in range(most):
        can = now.join(names.withColumn("_there", F.lit(True)), "include", "left").withColumn("_go", F.coalesce(F.col("_there") & ~F.array_contains("stack", F.col("include")), F.lit(False))).drop("_there")
        can = cut(can)
        rest = can.where("not _go").drop("_go")
        done = rest if done is None else done.unionByName(rest)
        opened = can.where("_go").drop("_go").join(known, F.col("include") == F.col("_file"))
        swapped = F.when(F.col("replace_from").isNotNull(), F.replace(F.col("_text"), F.col("replace_from"), F.coalesce("replace_to", F.lit("")))).otherwise(F.col("_text"))
        now = cut(opened.select("file", F.concat("place", F.array("_ln")).alias("place"), swapped.alias("text"), F.col("_file").alias("origin"), F.col("_ln").alias("origin_line"), F.col("_include").alias("include"), F.col("_from").alias("replace_from"), F.col("_to").alias("replace_to"), F.concat("stack", F.array("_file")).alias("stack")))
        if now.isEmpty():
            break
    return done.unionByName(now, allowMissingColumns=True).select("file", "place", "text", "origin", "origin_line", "include")


def trace_coverage(traces: DataFrame, transitions: DataFrame) -> DataFrame:
    """Share of a state graph's transitions (src, dst) that the traces (trace, step, state) walk."""
    w = W.partitionBy("trace").orderBy("step")
    walked = traces.withColumn("dst", F.lead("state").over(w)).where("dst is not null").select(F.col("state").alias("src"), "dst").distinct()
    known = transitions.select("src", "dst").distinct()
    hit = known.join(walked, ["src", "dst"], "left_semi").agg(F.count("*").alias("hit"))
    return known.agg(F.count("*").alias("total")).crossJoin(hit).withColumn("share", F.round(F.col("hit") / F.col("total"), 4))
