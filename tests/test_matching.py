"""What patterns need, and the limit of matches of a file."""

import random
import re

import pytest

from siltstone.operators import matching as m


@pytest.mark.parametrize(("regex", "literal"), [("a+b", "a"), ("(ab|cd)e", "e"), ("abc?d", "ab"), ("(?:xy){2}z", "xy"), ("^foo$", "foo"), ("(?i)abc", ""), ("(?i:abc)d", "d"), ("a{0,3}bcd", "bcd"), ("[ab]c", "c"), ("(a(bc)d)e", "abcde"), ("x*", ""), ("ab(?!cd)", "ab"), (r"[0-9]+[.][0-9]", "."), ("(((", "")])
def test_required_literals(regex, literal):
    assert m.required_literal(regex) == literal


@pytest.mark.parametrize("seed", range(20))
def test_matches_hold_the_literal(seed):
    rng = random.Random(seed)

    def part(depth=0):
        return rng.choice([lambda: rng.choice("abc"), lambda: f"[{rng.choice('abc')}]", lambda: "[ab]", lambda: f"({part(1)}|{part(1)})" if depth < 1 else "b", lambda: f"({part(1)}{part(1)})" if depth < 1 else "c", lambda: rng.choice("abc") + rng.choice(["*", "+", "?", "{2}"])])()

    for _ in range(200):
        regex = "".join(part() for _ in range(rng.randint(1, 5)))
        literal = m.required_literal(regex)
        for _ in range(20):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
            assert literal in text or not re.search(regex, text), (regex, literal, text)


def test_limit_of_a_file(spark, monkeypatch):
    monkeypatch.setattr(m, "MOST_MATCHES", 3)
    text = "\n".join(["me@x.org idiot"] * 5 + ["", "idiot noreply@x.org", "no at sign"])
    df = spark.createDataFrame([("long", "en", text), ("short", "en", "a@b.c"), ("none", "en", None)], "path string, lang string, text string")
    for rules in (m.PACK, m.rule_table(spark, m.PACK)):
        got = {(r.path, r.rule_id, r.ln) for r in m.findings(df, rules).collect()}
        assert {g for g in got if g[1] == "PII-EMAIL"} == {("long", "PII-EMAIL", 1), ("long", "PII-EMAIL", 2), ("long", "PII-EMAIL", 3), ("short", "PII-EMAIL", 1)}
        assert {g[2] for g in got if g[1] == "TOX-WORD"} == {1, 2, 3}
