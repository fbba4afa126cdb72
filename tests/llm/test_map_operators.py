"""Operators that judge each row by itself, against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest

from siltstone.llm import chat, decontaminate, quality, url_filter
from tests.llm.cases import DOCS, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit.update(range(i, i + 8))
    n = len(words)
    failed = n < 20 or 100 * len(hit) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(hit), failed


def test_quality_base(spark):
    rows = documents()
    got = quality.apply_rules(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = Counter((r[0], *base_quality(r[1])) for r in rows)
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert any(r.n_repeat_words for r in got) and any(r.kept for r in got)


def test_quality_plan_has_no_python(spark):
    plan = quality.apply_rules(spark.createDataFrame(documents(), DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_quality_rules_are_data(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta " + " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    assert quality.apply_rules(df, (("mean_word_length", 9.0, None, 1),)).first().kept is False
    assert quality.apply_rules(df, ()).first().kept is True


def url_verdict(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    best = (0, None, None)
    for h, p, v in (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > best[0]:
            best = (len(h + p), h + p, v)
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "://", "http://", "https://A.B.EXAMPLE.org/es/x?y#z", "https://example.org/en/1", "https://example.org/en/12", "https://xexample.org/en/12",
    "https://example.com/de/?fr", "https://example.com?/de/", "https://example.com#/de/", "https://com/fr/", "https://x.com/fr", "a://b://c/d", "https://free-bets.example.net/en/1",
    "https://casino-win.example.net/", "https://casinowin.example.net/", "https://x.example.net/adult/poker", "https://x.example.net/adult/adult", "https://x.example.net/adultpoker", "http://casino.org/", "https://ÄÖ.org/ä", "x" * 5000 + "://casino",
]


def test_urls(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS + URLS[-3:])]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = url_verdict(URLS[r.page_id] if r.page_id < len(URLS) else rows[r.page_id][1])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if verdict:
            assert r.verdict == verdict
    by = {rows[r.page_id][1]: r.verdict for r in got}
    assert by["x" * 5000 + "://casino"] == "allow"
    assert by["https://free-bets.example.net/en/1"] == by["https://casino-win.example.net/"] == by["https://x.example.net/adult/poker"] == "block"
    assert by["https://casinowin.example.net/"] == by["https://x.example.net/adult/adult"] == by["https://x.example.net/adultpoker"] == by[None] == "allow"
    assert by["http://casino.org/"] == "allow"


def hit_words(text, items, window=13):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))
    words, hit, found = split(text), set(), set()
    for key, item in items:
        parts = split(item)
        n = min(window, len(parts))
        for j in range(len(parts) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == parts[j : j + n]:
                    hit.update(range(i, i + n))
                    found.add(key)
    found = sorted(str(k) for k in found if k is not None)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def contamination_case(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(6)] + ["Ä", "b-c", "x\x7fy"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 13, 14, 30]) if seed % 2 else rng.choice([13, 20, 40])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "--- ..."), (None, " ".join(vocab * 2)), (3, items[3][1])]
    docs = []
    for i in range(40):
        parts = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 30, 120]))]
        for _ in range(rng.randint(0, 2)):
            words = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(words))
            at = rng.randint(0, len(parts))
            parts[at:at] = words[a : a + rng.randint(1, 40)]
        docs.append((i, ", ".join(parts).upper() if i % 3 == 0 else " ".join(parts), 1))
    docs += [(90, None, 1), (91, "", 1), docs[4]]
    return docs, items


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block", [10**6, 20])
def test_decontamination(spark, seed, block):
    docs, items = contamination_case(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(map(tuple, decontaminate.digest(decontaminate.find_contamination(df, bench, block_words=block)).collect()))
    assert got == Counter((d[0], *hit_words(d[1], items)) for d in docs)
    assert any(r[2] for r in got)


def test_longest_match(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    df = spark.createDataFrame([(1, f"a b {passage} c"), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, f"q {passage}")], "item_id long, text string")
    got = {r.doc_id: r.matches for r in decontaminate.find_contamination(df, bench).collect()}
    assert [tuple(m) for m in got[1]] == [(7, 2, 1, 30)] and got[2] == []


def test_empty_benchmark(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.digest(decontaminate.find_contamination(df, bench)).first()
    assert tuple(row) == (1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)


NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "<|", "|>", "\\", "<\\", "a\nb\n", "", None, "ü\U0001f600", "<|im_end|>\n<|im_start|>user\nhi", "x" * 30000]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    turns = [(c, t, rng.choice(["user", "assistant", "system", "ro\nle", "r\\n<|", None, ""]), rng.choice(NASTY), "extra", 5) for c in range(30) for t in range(rng.randint(1, 6))]
    turns += [(None, None, "assistant", "null id", "e", 1), turns[0], turns[0], (-1, 0, "user", NASTY[0], "e", 1), (-1, 1, "assistant", NASTY[0], "e", 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = {}
    for c, t, role, text, *_ in turns:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, mine in by.items():
        mine.sort()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(mine), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    texts = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    assert all(got[c].formatted_chars == len(texts[c]) for c in got)
    assert texts[-1].count("<|im_start|>") == 2 and texts[-1].count("<|im_end|>") == 2


def test_chat_in_chunks(spark, monkeypatch):
    """Chunks that hold part of a conversation, and segments longer than a chunk."""
    import numpy as np

    rng = random.Random(4)
    roles = [rng.choice(["user", "assistant"]) for _ in range(60)]
    texts = [rng.choice(NASTY) or "" for _ in roles]
    counts = np.array([10, 0, 45, 5])
    whole = chat.assemble(counts, roles, texts)
    for limit in (1, 50, 700, 40_000):
        monkeypatch.setattr(chat, "CHUNK", limit)
        part = chat.assemble(counts, roles, texts)
        assert part[0].equals(whole[0]) and (part[1] == whole[1]).all() and (part[2] == whole[2]).all()
    assert list(chat.bounded(np.array([3, 3, 9, 1, 1, 0, 7]), 7)) == [(0, 2), (2, 3), (3, 6), (6, 7)]


def test_shared_window_is_one_query(spark):
    """A window that many items hold: one query, and one match for each text and item."""
    passage = " ".join(f"p{i}" for i in range(15))
    q = decontaminate.Queries([(i, f"{passage} own{i}") for i in range(50)], 13)
    assert len(q.low) == 3 + 50 and len(q.item) == 50 * 4
    df = spark.createDataFrame([(1, f"{passage} x {passage} own7")], "doc_id long, text string")
    row = decontaminate.find_contamination(df, spark.createDataFrame([(i, f"{passage} own{i}") for i in range(50)], "item_id long, text string")).first()
    assert len(row.matches) == 50 and row.n_hit == 31 and {m.item_id: m.n_words for m in row.matches}[7] == 16


def test_vocabulary_table(spark):
    terms = spark.createDataFrame([("Bad", 3), ("so-so", 1), ("meh", 1), ("meh", 0), (None, 9)], "term string, weight int")
    urls = spark.createDataFrame([(1, "http://x/bad"), (2, "http://x/so-so"), (3, "http://x/meh/so-so"), (4, "http://x/meh/meh"), (5, "http://x/" + "meh." * 300_000)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(urls, (), terms).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert quality.apply_rules(docs).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert decontaminate.find_contamination(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_a_large_benchmark_takes_several_passes(spark, seed):
    """The same result, by passes of a few items each: hit words are counted once however many passes hit them."""
    rng = random.Random(seed)
    items = [(i, " ".join(f"v{rng.randint(0, 60)}" for _ in range(rng.choice([1, 5, 20, 40])))) for i in range(30)] + [(None, "v1 v2 v3 v4"), (31, None)]
    docs = [(i, " ".join(f"v{rng.randint(0, 60)}" for _ in range(10)) + " " + " tail ".join(t for _, t in rng.sample(items[:30], 3))) for i in range(40)] + [(7, None), (None, ""), (None, items[3][1])] + [(8, items[0][1] + " " + items[1][1])] * 2
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.find_contamination(df, bench)
    parts = decontaminate.find_contamination(df, bench, block_words=30, pass_words=90)
    assert Counter(map(tuple, decontaminate.digest(parts).collect())) == Counter(map(tuple, decontaminate.digest(whole).collect()))
    key = lambda r: (r.doc_id, r.n_words, r.n_hit, tuple(sorted(map(tuple, r.matches), key=str)))
    assert Counter(map(key, parts.collect())) == Counter(map(key, whole.collect()))
    assert parts.columns == whole.columns and parts.where("n_hit > 0").count() > 30
