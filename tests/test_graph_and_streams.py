"""Long cycles, components that never end early, and streams that stop and go on."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import graph as g
from siltstone.streaming import events as ev


def test_long_ring_is_found(spark):
    ring = [(i, (i + 1) % 300) for i in range(300)] + [(5, 2000), (2000, 2001), (3000, 7)]
    got = {r.node: r.component for r in g.cycles(spark.createDataFrame(ring, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(300)}


def test_too_few_rounds_are_an_error(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 100) for i in range(100)], "src long, dst long")
    with pytest.raises(RuntimeError):
        g.cycles(ring, most=2)


def plain_components(edges):
    reach = {}
    for s in {x for e in edges for x in e}:
        seen, front = {s}, [s]
        while front:
            front = [b for a, b in edges if a in front and b not in seen]
            seen |= set(front)
        reach[s] = seen
    out = {}
    for a in reach:
        same = {b for b in reach[a] if a in reach[b]}
        if len(same) > 1:
            out[a] = min(same)
    return out


def test_random_graphs(spark):
    rng = random.Random(4)
    edges = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(55)} | {(50, 51), (51, 52), (52, 50), (60, 61), (61, 60), (52, 60)}
    got = {r.node: r.component for r in g.cycles(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
    assert got == plain_components([e for e in edges if e[0] != e[1]])


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_voters_after_a_restart(spark, tmp_path):
    schema = "voter int, right int"
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    read = lambda: spark.readStream.schema(schema).parquet(source)
    add(spark, source, [(1, 1), (1, 0), (2, 1)], schema)
    ev.carry_voters(read(), folder)
    add(spark, source, [(1, 1)], schema)
    got = {r.voter: (r.right, r.mass) for r in ev.carry_voters(read(), folder).collect()}
    assert got == {1: (pytest.approx(1.95), pytest.approx(2.9)), 2: (pytest.approx(0.95), pytest.approx(0.95))}


def test_replayed_batches_count_once(spark, tmp_path):
    """A batch that ran but was not marked as done runs again and replaces what it wrote."""
    import os

    schema = "k string"
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    read = lambda: spark.readStream.schema(schema).parquet(source)
    count = lambda b: b.groupBy("k").agg(F.count("*").alias("n"))
    add(spark, source, [("a",), ("a",), ("b",)], schema)
    ev.keep_batches(read(), count, folder)
    commits = f"{folder}/run/checkpoint/commits"
    for name in os.listdir(commits):
        if name.endswith("0") or name.startswith(".0"):
            os.remove(f"{commits}/{name}")
    add(spark, source, [("b",)], schema)
    got = {r.k: r.n for r in ev.keep_batches(read(), count, folder).groupBy("k").agg(F.sum("n").alias("n")).collect()}
    assert got == {"a": 2, "b": 2}


def test_buckets_over_batches(spark, tmp_path):
    schema = "repo int, ts timestamp, event_id long, bucket string"
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    from datetime import datetime

    at = lambda d: datetime(2024, 1, d)
    read = lambda: spark.readStream.schema(schema).parquet(source)
    run = lambda: {r.bucket: r.n for r in ev.keep_batches(ev.bucket_transitions(read(), "repo", "bucket"), lambda b: b, folder).groupBy("bucket").agg(F.sum("delta").alias("n")).where("n != 0").collect()}
    add(spark, source, [(1, at(2), 2, "low"), (1, at(1), 1, "high"), (2, at(1), 3, "low")], schema)
    assert run() == {"low": 2}
    add(spark, source, [(1, at(3), 4, "mid"), (2, at(3), 5, "low"), (3, at(3), 6, "mid")], schema)
    assert run() == {"low": 1, "mid": 2}


def test_no_shared_folder_is_an_error(spark):
    from siltstone.operators.graph import shared_dir

    class Bare:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getConf": staticmethod(lambda: type("G", (), {"get": staticmethod(lambda *a: None)}))})

    with pytest.raises(ValueError):
        shared_dir(Bare)
