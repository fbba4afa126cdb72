"""Queries read whole tables, not a share of the ids."""

from types import SimpleNamespace

from siltstone.plans import graph_plans, report_plans


def test_flows_use_every_order(spark):
    """Customers 1 to 100; call 50 -> 55 -> ... as the orders' keys give it, against a plain search."""
    orders = [(k, 1 + (k * 37) % 100) for k in range(1, 400)]
    t = SimpleNamespace(
        spark=spark, customer=spark.createDataFrame([(i,) for i in range(1, 101)], "c_custkey int"), orders=spark.createDataFrame(orders, "o_orderkey int, o_custkey int")
    )
    edges = {(c, (7 * c + 13 * k) % 100) for k, c in orders}
    edges = {(a, b) for a, b in edges if a != b and not (1 <= b <= 100 and b % 11 == 5)}
    want = {}
    for s in (50, 100):
        paths = {s: [s]}
        front = paths
        for _ in range(6):
            new = {}
            for at, path in front.items():
                for a, b in edges:
                    if a == at and b not in paths:
                        new[b] = min(new.get(b, [*path, b]), [*path, b])
            paths = paths | new
            front = new
        want |= {(s, b): ">".join(map(str, p)) for b, p in paths.items() if b != s and 1 <= b <= 100 and b % 7 == 3}
    assert want and {(r.source, r.sink): r.path for r in graph_plans.g11(t).collect()} == want


def test_includes_of_every_document(spark):
    docs = [(i, f"one {i}\ntwo\nthree", "en", "s", 10) for i in range(1, 41)]
    t = SimpleNamespace(spark=spark, documents=spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    got = {r.file: (r.rows, r.files, r.open) for r in report_plans.s23(t).collect()}
    want = {}
    for i in range(1, 41):
        inside = min(10, 40 - i)
        want[f"s/{i}"] = (2 * inside + 3, inside + 1, 1)
    assert got == want
