"""The code graph against plain Python: both passes, what findings show, reports of architecture."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.operators import codegraph as cg

DEF, SITE, IMPORT = "file string, name string, start int, end int, entry boolean", "file string, line int, name string", "file string, line int, spec string, base string"


def case(seed):
    rng = random.Random(seed)
    files = [f"r{i % 3}/f{i}{rng.choice(['.ts', '.js', '/index.ts', ''])}" for i in range(9)]
    defs = []
    for f in files:
        for _ in range(rng.randint(0, 5)):
            start = rng.randint(1, 30)
            defs.append((f, rng.choice(["a", "b", "c", "d", None, "only" + f]), start, start + rng.choice([0, 3, 15]), rng.random() < 0.2))
    defs = list({(d[0], d[1], d[2]): d for d in defs}.values())
    sites = [(rng.choice(files + ["gone"]), rng.randint(1, 40), rng.choice(["a", "b", "c", "d", "anonymous", "nowhere", None, "only" + files[0]])) for _ in range(150)]
    imports = [(rng.choice(files), rng.randint(1, 5), "./x", f"r{i % 3}/f{rng.randint(0, 11)}") if rng.random() < 0.7 else (rng.choice(files + [None]), 1, rng.choice(["lib", "std", None]), None) for i in range(60)]
    return files, defs, sites, imports


def plain_build(files, defs, sites, imports):
    functions = [(f"{f}#{n or 'anonymous'}@{s}", f, n or "anonymous", s, e, en) for f, n, s, e, en in defs]
    edges = []
    for f, line, name in sites:
        if f not in files or name is None:
            continue
        around = [x for x in functions if x[1] == f and x[3] <= line <= x[4]]
        src = max(around, key=lambda x: (x[3], -x[4], x[0]))[0] if around else f"file:{f}"
        same, all_ = [x[0] for x in functions if x[1] == f and x[2] == name], [x[0] for x in functions if x[2] == name]
        dst = same[0] if len(same) == 1 else all_[0] if len(all_) == 1 else f"unresolved:{name}"
        if src != dst:
            edges.append((src, dst, "calls", line, "unknown" if dst.startswith("unresolved:") else "user"))
    for f, line, spec, base in imports:
        if f is None or spec is None:
            continue
        hit = next((base + g for g in cg.GUESSES if base is not None and base + g in files), None)
        edges.append((f"file:{f}", f"file:{hit}" if hit else f"module:{spec}", "imports", line, "user" if hit else "unknown"))
    nodes = {f"file:{f}" for f in files} | {x[0] for x in functions} | {e[1] for e in edges}
    return functions, nodes, edges


@pytest.fixture(params=[1, 2, 3])
def built(spark, request):
    files, defs, sites, imports = case(request.param)
    nodes, edges = cg.build(spark.createDataFrame([(f,) for f in files] * 2, "path string"), spark.createDataFrame(defs, DEF), spark.createDataFrame(sites, SITE), spark.createDataFrame(imports, IMPORT))
    return (files, defs, sites, imports), nodes, edges


def test_build(built):
    case_, nodes, edges = built
    functions, want_nodes, want_edges = plain_build(*case_)
    assert Counter(map(tuple, edges.collect())) == Counter(want_edges)
    assert Counter(r.id for r in nodes.collect()) == Counter(want_nodes)
    assert {(r.id, r.entry) for r in nodes.where("entry").collect()} == {(x[0], True) for x in functions if x[5]}


def test_enrichment_and_drawing(spark, built):
    case_, nodes, edges = built
    functions, _, want_edges = plain_build(*case_)
    calls = [e for e in want_edges if e[2] == "calls"]
    hops, now = {x[0]: 0 for x in functions if x[5]}, [x[0] for x in functions if x[5]]
    for step in range(1, 13):
        now = sorted({e[1] for e in calls if e[0] in now} - set(hops))
        hops |= dict.fromkeys(now, step)
    found = [(i, f, line) for i, (f, line) in enumerate((f, line) for f in case_[0] for line in (1, 5, 12, 20, 99))]
    rows = cg.enrich(spark.createDataFrame(found, "fid int, file string, line int"), nodes, edges)
    got = {r.fid: r for r in rows.collect()}
    names = {r.id: r.name for r in nodes.collect()}
    for i, f, line in found:
        around = [x for x in functions if x[1] == f and x[3] <= line <= x[4]]
        own = max(around, key=lambda x: (x[3], -x[4], x[0]))[0] if around else None
        r = got[i]
        assert (r.function, r.fan_in, r.fan_out, r.hops) == (own, sum(e[1] == own for e in calls), sum(e[0] == own for e in calls), hops.get(own))
        assert r.callers == sorted({e[0] for e in calls if e[1] == own})[: cg.SHOWN] and r.callees == sorted({e[1] for e in calls if e[0] == own})[: cg.SHOWN]
        assert r.imports == sorted({names[e[1]] for e in want_edges if e[2] == "imports" and e[0] == f"file:{f}"})
        fan = min(1, r.fan_in / 20)
        assert r.priority == pytest.approx(0.55 * fan + 0.45 * (0.15 if r.hops is None else max(0, 1 - r.hops / 8)), abs=0.0006)
    hot, links = cg.drawing(rows, nodes)
    shown = [r for r in got.values() if r.function]
    want = {(c, r.function) for r in shown for c in r.callers} | {(r.function, c) for r in shown for c in r.callees}
    top = {r.id for r in hot.collect()}
    assert [tuple(r) for r in links.orderBy("src", "dst").collect()] == sorted(x for x in want if x[0] in top or x[1] in top)[: cg.LINKS]


def test_architecture(spark, built):
    case_, nodes, edges = built
    files, defs, *_ = case_
    _, _, want_edges = plain_build(*case_)
    inner = {(e[0][5:], e[1][5:]) for e in want_edges if e[2] == "imports" and e[4] == "user" and e[0] != e[1]}
    outer = {(e[0][5:], e[1]) for e in want_edges if e[2] == "imports" and e[4] == "unknown"}
    reach = defaultdict(set)
    for f in files:
        todo = [f]
        while todo:
            at = todo.pop()
            new = {b for a, b in inner if a == at} - reach[f]
            reach[f] |= new
            todo += new
    ring = {f for f in files if f in reach[f]}
    metrics = [(f, 10 * i, i, 2 * i, i % 4) for i, f in enumerate(files)]
    totals, mods, named = cg.architecture(nodes, edges, spark.createDataFrame(metrics, "file string, loc int, cyclomatic int, cognitive int, functions int"), cg.F.split("file", "/")[0])
    by = {r.file: r for r in mods.collect()}
    entries = {d[0] for d in defs if d[4]}
    for f, _, _, cognitive, _ in metrics:
        ca, ce = sum(b == f for _, b in inner), sum(a == f for a, _ in inner)
        assert (by[f].ca, by[f].ce, by[f].external, by[f].risk, by[f].entry, by[f].component is not None) == (ca, ce, sum(a == f for a, _ in outer), cognitive * (1 + ca), f in entries, f in ring)
    for r in totals.collect():
        own = [m for m in metrics if m[0].startswith(r.repo + "/")]
        n = sum(m[4] for m in own)
        assert (r.modules, r["loc"], r.functions, r.internal_edges, r.in_cycle) == (len(own), sum(m[1] for m in own), n, sum(by[m[0]].ce for m in own), sum(m[0] in ring for m in own))
        assert r.cognitive_mean == (round(sum(m[3] for m in own) / n + 1e-9, 1) if n else 0.0)
        assert r.orphans == sum(by[m[0]].ca == 0 and m[0] not in entries and m[1] > 0 for m in own)
        assert r.external == len({x for a, x in outer if a.startswith(r.repo + "/")})
    assert sum(r["size"] for r in named.collect()) == len(ring)
    assert cg.portfolio_architecture(totals).first().modules == len(files)


def test_empty(spark):
    nodes, edges = cg.build(*(spark.createDataFrame([], s) for s in ("path string", DEF, SITE, IMPORT)))
    assert nodes.count() == edges.count() == 0
    assert cg.enrich(spark.createDataFrame([(1, "f", 1)], "fid int, file string, line int"), nodes, edges).first().callers == []


@pytest.fixture
def long_functions(spark):
    """A few functions of 150,000 lines each, whose table is a few kB; at most 40 MB may be broadcast."""
    files = [f"r{i % 3}/f{i}" for i in range(4)]
    defs = [(f, f"n{i}", 1, 150_000, i == 0) for i, f in enumerate(files)]
    sites = [(f, line, f"n{(i + 1) % 4}") for i, f in enumerate(files) for line in (1, 75_000, 150_000)]
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.maxBroadcastTableSize", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "40m")
    yield spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame(defs, DEF), spark.createDataFrame(sites, SITE), spark.createDataFrame([], IMPORT)
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def found_in(case_, spark):
    nodes, edges = cg.build(*case_)
    return cg.enrich(case_[2].select(F.concat("file", F.lit(":"), "line").alias("fid"), "file", "line"), nodes, edges), nodes


def test_drawn_hotspots_send_no_lines_through_the_driver(spark, long_functions):
    hot, _ = cg.drawing(*found_in(long_functions, spark))
    assert [(r.name, r.file, r.fan_in, r.fan_out, r.hops) for r in hot.collect()] == [(f"n{i}", f"r{i % 3}/f{i}", 3, 3, i) for i in range(4)]


def test_evidence_sends_no_lines_through_the_driver(spark, long_functions):
    rows, _ = found_in(long_functions, spark)
    ids = [f"r{i % 3}/f{i}#n{i}@1" for i in range(4)]
    got = {r.fid: (r.function, r.hops, r.callers, r.callees) for r in rows.collect()}
    assert got == {f"r{i % 3}/f{i}:{line}": (ids[i], i, [ids[i - 1]], [ids[(i + 1) % 4]]) for i in range(4) for line in (1, 75_000, 150_000)}


def test_drawn_links_send_no_lines_through_the_driver(spark, long_functions):
    _, links = cg.drawing(*found_in(long_functions, spark))
    assert [tuple(r) for r in links.collect()] == [(f"r{i % 3}/f{i}#n{i}@1", f"r{(i + 1) % 4 % 3}/f{(i + 1) % 4}#n{(i + 1) % 4}@1") for i in (0, 3, 1, 2)]
