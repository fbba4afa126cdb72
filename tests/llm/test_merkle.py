"""The manifest against plain Python, and its query against SQL."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from siltstone.llm import merkle
from siltstone.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.cases import DOCS, documents

SF = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The top, and the siblings (before, after) of each node level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        at, level = [p // 8 for p in at], [H(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def brute(rows):
    small = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by_lang = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        leaf = lambda t: H(*map(shown, (doc_id, source, lang, n_chars, t)))  # noqa: E731, B023
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        by_lang.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, leaf(text)), doc_id, leaf(text), leaf(small(text) if hit else text)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(by_lang[x])]) for x in langs}
    root, above = tree([trees[x][0] for x in langs])
    out = []
    for x, up in zip(langs, above, strict=True):
        for (_, doc_id, leaf, own), path in zip(sorted(by_lang[x]), trees[x][1], strict=True):
            node = own
            for before, after in path + up:
                node = H(before, node, after)
            out.append((doc_id, leaf, trees[x][0], root, H(*(b + a for b, a in path + up)), node, node == root))
    return Counter(out)


def many(n, langs, seed=1):
    rng = random.Random(seed)
    return [(i, f"Text {i} É", rng.choice(langs), f"s{i % 3}", i, None, None) for i in rng.sample(range(-n, 5 * n), n)]


CASES = {
    "mixed": documents() + [(None, "A", None, None, None, None, None)] * 3 + [(-5, "X", "", "", -1, None, None), (None, None, "en", None, None, None, None)],
    "one": [(3, "Only", "en", "s", 4, None, None)],
    "two langs": [(3, "Only", "en", "s", 4, None, None), (6, "Other", None, "s", 4, None, None)],
    "more than a block": many(1300, ["hot", "hot", "hot", "é", "z"]),
    "three rounds": [(i, "T", "hot", None, None, None, None) for i in range(4300)],
    "many langs": many(700, [f"l{i}" for i in range(600)]),
    "copies": [(7, "Copy", "en", "s", 4, None, None)] * 600 + many(30, ["en", "de"]),
}


@pytest.mark.parametrize("name", CASES)
def test_manifest(spark, name, monkeypatch):
    if name == "many langs":
        monkeypatch.setattr(merkle, "BROADCAST_GROUPS", 10)
    got = merkle.digest(spark.createDataFrame(CASES[name], DOCS).repartition(3))
    assert Counter(map(tuple, got.collect())) == brute(CASES[name])


def test_empty_and_long(spark):
    assert merkle.digest(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "Long " * 200_000, "en", "s", 1, None, None), (2, "b", "en", "s", 1, None, None)]
    assert Counter(map(tuple, merkle.digest(spark.createDataFrame(rows, DOCS)).collect())) == brute(rows)


def test_a_change_is_found_where_it_was_made(spark):
    rows = many(40, ["en", "de"])
    df = spark.createDataFrame(rows, DOCS)
    paths = {r.doc_id: r for r in merkle.manifest(df).collect()}
    assert {len(r.path) for r in paths.values()} == {3}  # two levels of a language, one of the languages
    for row in merkle.audit(df, df.doc_id == rows[0][0], merkle.F.lit("other")).collect():
        assert row.verified == (row.doc_id != rows[0][0]) and row.root == paths[row.doc_id].root


def test_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES["op13_merkle_manifest"](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['op13_merkle_manifest']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and len(want) == 200
