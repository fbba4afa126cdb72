"""The code graph: built from definitions, call sites and imports, and read by findings and reports.

A graph is two tables: nodes (id, kind, file, name, start, end, entry) and edges (src, dst, kind, line, resolved). Names
are resolved by equi joins with counts, lines by an equi join on the lines that each function covers, so a file with many
functions and call sites is never compared with itself. What a finding shows of its neighbours is cut to a few per node
by a rank whose limit is applied in every task before the shuffle; nothing gathers a hub's neighbours.

Joins with a row for each line or function carry a merge hint: Spark guesses a table's size from the bytes of its files,
which says little about exploded or packed rows, and would send millions of them through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.graph import cut, cycles, hops_from, priority

#: Endings that are tried for an import, in this order, and neighbours that a finding shows.
GUESSES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts")
SHOWN = 8
#: Fixed values of reports: repositories, hotspots, risky modules, cycles, and hotspots and links of a drawing.
TOP_REPOS, TOP_HOTSPOTS, TOP_RISK, TOP_CYCLES, DRAWN, LINKS = 10, 12, 15, 8, 28, 90


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def function_id(file: Column, name: Column, start: Column) -> Column:
    return F.concat(file, F.lit("#"), name, F.lit("@"), start.cast("string"))


def line_owners(functions: DataFrame) -> DataFrame:
    """(file, line, owner): of the functions (id, file, start, end) that cover a line, the one that starts last; of
    equal starts the one that ends first, then the greater id."""
    lines = functions.where("start is not null and end >= start").select("file", F.explode(F.sequence("start", "end")).alias("line"), F.struct("start", (-F.col("end")).alias("less"), "id").alias("k"))
    return lines.groupBy("file", "line").agg(F.max("k")["id"].alias("owner"))


def build(files: DataFrame, definitions: DataFrame, sites: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of files (path), definitions (file, name, start, end, entry), call sites (file, line, name) and
    imports (file, line, spec, base).

    First pass: a node for each file and function. Second pass: a call goes from the innermost function around its line,
    or from the file, to the only function of that name in the file, else to the only one at all, else to a placeholder;
    calls of oneself are no edges. An import with a base (the path that a relative one means) goes to the first file of
    GUESSES that exists, any other to a placeholder for its module. Rows of unknown files, and those with null names,
    give no edges; functions without a name are ``anonymous``. Repeated edges stay, repeated nodes are one.
    """
    name = F.coalesce("name", F.lit("anonymous"))
    functions = cut(definitions.select(function_id(F.col("file"), name, F.col("start")).alias("id"), "file", name.alias("name"), "start", "end", F.coalesce("entry", F.lit(False)).alias("entry")).dropDuplicates(["id"]))
    known = files.select("path").where("path is not null").distinct()
    nodes = known.select(file_id(F.col("path")).alias("id"), F.lit("file").alias("kind"), F.col("path").alias("file"), F.col("path").alias("name"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(False).alias("entry"))
    nodes = nodes.unionByName(functions.select("id", F.lit("function").alias("kind"), "file", "name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "entry"))

    at = sites.where("name is not null").join(known.select(F.col("path").alias("file")), "file", "left_semi")
    at = at.join(line_owners(functions).hint("merge"), ["file", "line"], "left").select(F.coalesce("owner", file_id(F.col("file"))).alias("src"), "file", "line", "name")
    here = functions.groupBy("file", "name").agg(F.count(F.lit(1)).alias("_k"), F.min("id").alias("_local")).where("_k = 1").drop("_k")
    anywhere = functions.groupBy("name").agg(F.count(F.lit(1)).alias("_k"), F.min("id").alias("_global")).where("_k = 1").drop("_k")
    at = at.join(here, ["file", "name"], "left").join(anywhere, "name", "left").withColumn("_to", F.coalesce("_local", "_global"))
    calls = at.select("src", F.coalesce("_to", F.concat(F.lit("unresolved:"), "name")).alias("dst"), F.lit("calls").alias("kind"), F.col("line").cast("long").alias("line"), F.when(F.col("_to").isNotNull(), "user").otherwise("unknown").alias("resolved"), "name")

    said = imports.where("spec is not null").join(known.select(F.col("path").alias("file")), "file", "left_semi")
    bases = said.select("base").where("base is not null").distinct()
    guess = F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.concat("base", F.lit(g)).alias("path")) for i, g in enumerate(GUESSES))))
    there = bases.select("base", guess).join(known, "path").groupBy("base").agg(F.min_by("path", "i").alias("_file"))
    said = said.join(there, "base", "left")
    used = said.select(file_id(F.col("file")).alias("src"), F.coalesce(file_id(F.col("_file")), F.concat(F.lit("module:"), "spec")).alias("dst"), F.lit("imports").alias("kind"), F.col("line").cast("long").alias("line"), F.when(F.col("_file").isNotNull(), "user").otherwise("unknown").alias("resolved"), F.col("spec").alias("name"))

    edges = cut(calls.where("src != dst").unionByName(used))
    stubs = edges.where("resolved = 'unknown'").select(F.col("dst").alias("id"), F.when(F.col("kind") == "calls", "function").otherwise("file").alias("kind"), F.lit("").alias("file"), "name").distinct()
    nodes = nodes.unionByName(stubs, allowMissingColumns=True).withColumn("entry", F.coalesce("entry", F.lit(False)))
    return cut(nodes), edges.drop("name")


def first_neighbours(edges: DataFrame, of: str, other: str, most: int = SHOWN) -> DataFrame:
    """(node, near): the first ``most`` distinct neighbours of each node, by id, as one string array."""
    pairs = edges.where("kind = 'calls'").select(F.col(of).alias("node"), F.col(other).alias("n"))
    # Ties share a rank, so copies of an edge never push another neighbour out.
    few = pairs.withColumn("_r", F.dense_rank().over(W.partitionBy("node").orderBy("n"))).where(F.col("_r") <= most)
    return few.select("node", "n").distinct().groupBy("node").agg(F.array_sort(F.collect_list("n")).alias("near"))


def degrees_of_calls(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out over call edges, repeated ones counted."""
    both = edges.where("kind = 'calls'").select(F.inline(F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def enrich(findings: DataFrame, nodes: DataFrame, edges: DataFrame, most_hops: int = 12) -> DataFrame:
    """Findings (fid, file, line) with function, name, fan_in, fan_out, hops, callers, callees, imports, priority.

    hops are calls from the nearest entry, null beyond ``most_hops``. Callers and callees are the first SHOWN by id;
    imports are the distinct names that the file imports. A finding outside all functions has none, fans of 0 and the
    least priority; arrays are empty, not null.
    """
    functions = nodes.where("kind = 'function' and start is not null")
    calls = edges.where("kind = 'calls'")
    at = findings.join(line_owners(functions).hint("merge"), ["file", "line"], "left").withColumnRenamed("owner", "node")
    hops = hops_from(nodes.where("entry").select(F.col("id").alias("node")), calls, most_hops)
    names = nodes.select(F.col("id").alias("dst"), F.col("name").alias("_name"))
    used = edges.where("kind = 'imports'").select("src", "dst").distinct().join(names.hint("merge"), "dst").select(F.substring("src", 6, 1 << 30).alias("file"), "_name")
    used = used.groupBy("file").agg(F.array_sort(F.collect_set("_name")).alias("imports"))
    # Findings outside all functions have nothing to look up and don't meet under one key.
    inside, outside = at.where("node is not null"), at.where("node is null")
    j = inside.join(names.select(F.col("dst").alias("node"), F.col("_name").alias("name")).hint("merge"), "node", "left")
    for side in (degrees_of_calls(edges), hops, first_neighbours(edges, "dst", "src").withColumnRenamed("near", "callers"), first_neighbours(edges, "src", "dst").withColumnRenamed("near", "callees")):
        j = j.join(side.hint("merge"), "node", "left")
    j = j.unionByName(outside, allowMissingColumns=True).join(used, "file", "left")
    none = F.array().cast("array<string>")
    fans = {c: F.coalesce(c, F.lit(0)) for c in ("fan_in", "fan_out")}
    return j.select("fid", F.col("node").alias("function"), "name", *(c.alias(n) for n, c in fans.items()), "hops", *(F.coalesce(c, none).alias(c) for c in ("callers", "callees", "imports")), priority(fans["fan_in"], F.col("hops")).alias("priority"))


def graph_totals(nodes: DataFrame, edges: DataFrame, repo_of: Column, repo_of_src: Column) -> DataFrame:
    """Per repository: nodes, edges, functions, calls, imports, entries. The columns say whose a node and an edge is."""
    n = nodes.groupBy(repo_of.alias("repo")).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("kind") == "function").alias("functions"), F.count_if("entry").alias("entries"))
    e = edges.groupBy(repo_of_src.alias("repo")).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("kind") == "calls").alias("calls"), F.count_if(F.col("kind") == "imports").alias("imports"))
    return n.join(e, "repo", "left").na.fill(0, ["edges", "calls", "imports"])


def hotspots_of(nodes: DataFrame, edges: DataFrame, repo_of: Column, most: int = DRAWN) -> DataFrame:
    """Per repository its nodes with the most calls: (repo, node, name, file, fan_in, fan_out, hops)."""
    hops = hops_from(nodes.where("entry").select(F.col("id").alias("node")), edges.where("kind = 'calls'"))
    j = nodes.where("kind = 'function' and file != ''").select(repo_of.alias("repo"), F.col("id").alias("node"), "name", "file").join(degrees_of_calls(edges), "node")
    top = j.withColumn("_n", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("fan_in"), "name", "node"))).where(F.col("_n") <= most).drop("_n")
    return top.join(hops, "node", "left").select("repo", "node", "name", "file", "fan_in", "fan_out", "hops")


def hop_buckets(hotspots: DataFrame) -> DataFrame:
    """One row: hotspots that are entries, one, two, three or more calls away, or out of reach."""
    h = F.col("hops")
    return hotspots.agg(F.count_if(h == 0).alias("entry"), F.count_if(h == 1).alias("hop1"), F.count_if(h == 2).alias("hop2"), F.count_if(h >= 3).alias("hop3plus"), F.count_if(h.isNull()).alias("unknown"))


def portfolio_graph(totals: DataFrame, hotspots: DataFrame) -> DataFrame:
    """One row over all repositories: their sums, and the hop buckets of their hotspots."""
    sums = totals.agg(F.count(F.lit(1)).alias("repos"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("functions", "calls", "imports", "entries", "nodes", "edges")))
    return sums.crossJoin(F.broadcast(hop_buckets(hotspots)))  # one row each


def top_repositories(totals: DataFrame, hotspots: DataFrame) -> DataFrame:
    most = hotspots.groupBy("repo").agg(F.max("fan_in").alias("max_fan_in"))
    return totals.join(most, "repo", "left").withColumn("max_fan_in", F.coalesce("max_fan_in", F.lit(0))).orderBy(F.desc("functions"), "repo").limit(TOP_REPOS)


def drawing(enriched: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hotspots and links from what findings show: (hotspots, links).

    A function that several findings show is one node with the largest figures, a neighbour is one with what is known of
    it, and a link is drawn once. Hotspots are the first DRAWN by fan_in, then name and id; links touch a hotspot, the
    first LINKS by ends.
    """
    # A function's findings all show the same, so what is drawn from is written once, a row for each function.
    shown = cut(enriched.where("function is not null").select("function", "fan_in", "fan_out", "hops", "callers", "callees").distinct())
    own = shown.select(F.col("function").alias("id"), "fan_in", "fan_out", "hops")
    zero = (F.lit(0).cast("long").alias("fan_in"), F.lit(0).cast("long").alias("fan_out"), F.lit(None).cast("int").alias("hops"))
    near = shown.select(F.explode(F.concat("callers", "callees")).alias("id")).select("id", *zero)
    merged = own.unionByName(near).groupBy("id").agg(F.max("fan_in").alias("fan_in"), F.max("fan_out").alias("fan_out"), F.min("hops").alias("hops"))
    named = merged.join(nodes.select("id", "name", "file").hint("merge"), "id")
    hot = named.orderBy(F.desc("fan_in"), "name", "id").limit(DRAWN)
    ends = shown.select(F.explode(F.concat(F.transform("callers", lambda c: F.struct(c.alias("src"), F.col("function").alias("dst"))), F.transform("callees", lambda c: F.struct(F.col("function").alias("src"), c.alias("dst"))))).alias("x")).select("x.*").distinct()
    top = F.broadcast(hot.select("id"))
    touching = ends.join(top, ends["src"] == F.col("id"), "left_semi").unionByName(ends.join(top, ends["dst"] == F.col("id"), "left_semi")).distinct()
    return hot, touching.orderBy("src", "dst").limit(LINKS)


def modules(nodes: DataFrame, edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per file with its metrics (file, loc, cyclomatic, cognitive, functions): ca, ce, external, instability, risk, entry.

    Imports of oneself and repeated imports don't count; ``external`` are modules without a file; risk is the cognitive
    complexity times one more than ca.
    """
    file_of = lambda c: F.substring(c, 6, 1 << 30)
    inner, outer = internal_imports(edges), edges.where("kind = 'imports' and resolved = 'unknown'").select(file_of("src").alias("file"), "dst").distinct()
    ca = inner.groupBy(F.col("dst").alias("file")).agg(F.count(F.lit(1)).alias("ca"))
    ce = inner.groupBy(F.col("src").alias("file")).agg(F.count(F.lit(1)).alias("ce"))
    out = outer.groupBy("file").agg(F.count(F.lit(1)).alias("external"))
    entries = nodes.where("entry").select("file").distinct().withColumn("entry", F.lit(True))
    every = nodes.where("kind = 'file' and file != ''").select("file").unionByName(metrics.select("file")).distinct()
    for side in (metrics, ca, ce, out, entries):
        every = every.join(side, "file", "left")
    every = every.na.fill(0, ["loc", "cyclomatic", "cognitive", "functions", "ca", "ce", "external"]).na.fill(False, ["entry"])
    both = F.col("ca") + F.col("ce")
    return every.withColumn("instability", F.when(both > 0, F.round(F.col("ce") / both, 3))).withColumn("risk", F.col("cognitive") * (1 + F.col("ca")))


def internal_imports(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) of files that import another file."""
    file_of = lambda c: F.substring(c, 6, 1 << 30)
    return edges.where("kind = 'imports' and resolved = 'user' and src != dst").select(file_of("src").alias("src"), file_of("dst").alias("dst")).distinct()


def architecture(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, repo_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, modules, cycles) of each repository, ``repo_of`` being that of a column ``file``.

    totals: repo, modules, loc, functions, cyclomatic_mean, cognitive_mean (over functions, one decimal), internal_edges,
    external (distinct modules), in_cycle, orphans (with code, imported by none, no entry). cycles: repo, component, size.
    """
    inner = cut(internal_imports(edges))
    mods = cut(modules(nodes, edges, metrics).withColumn("repo", repo_of))
    ring = cut(cycles(inner))
    in_ring = ring.select(F.col("node").alias("file"), "component")
    placed = mods.join(in_ring, "file", "left")
    mean = lambda c: F.when(F.sum("functions") > 0, F.round(F.sum(c) / F.sum("functions"), 1)).otherwise(0.0)
    orphan = (F.col("ca") == 0) & ~F.col("entry") & (F.col("loc") > 0)
    totals = placed.groupBy("repo").agg(
        F.count(F.lit(1)).alias("modules"), F.sum("loc").alias("loc"), F.sum("functions").alias("functions"), mean("cyclomatic").alias("cyclomatic_mean"), mean("cognitive").alias("cognitive_mean"),
        F.sum("ce").alias("internal_edges"), F.count_if(F.col("component").isNotNull()).alias("in_cycle"), F.count_if(orphan).alias("orphans"),
    )
    outer = edges.where("kind = 'imports' and resolved = 'unknown'").select(F.substring("src", 6, 1 << 30).alias("file"), "dst").withColumn("repo", repo_of).groupBy("repo").agg(F.count_distinct("dst").alias("external"))
    totals = totals.join(outer, "repo", "left").na.fill(0, ["external"])
    named = in_ring.withColumn("repo", repo_of).groupBy("repo", "component").agg(F.count(F.lit(1)).alias("size"))
    return totals, placed, named


def portfolio_architecture(totals: DataFrame) -> DataFrame:
    """One row over all repositories with modules: sums, and means weighted by functions."""
    weighted = lambda c: F.when(F.sum("functions") > 0, F.round(F.sum(F.col(c) * F.col("functions")) / F.sum("functions"), 1)).otherwise(0.0)
    sums = ("modules", "functions", "loc", "internal_edges", "external", "in_cycle", "orphans")
    return totals.where("modules > 0").agg(F.count(F.lit(1)).alias("repos"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), weighted("cognitive_mean").alias("cognitive_mean"), weighted("cyclomatic_mean").alias("cyclomatic_mean"))


def top_risk(mods: DataFrame) -> DataFrame:
    return mods.orderBy(F.desc("risk"), "repo", "file").limit(TOP_RISK).select("repo", "file", "ca", "ce", "cognitive", "risk", "component")


def top_cycles(named: DataFrame) -> DataFrame:
    return named.orderBy("repo", "component").limit(TOP_CYCLES)
