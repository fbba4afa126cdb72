"""URL filters: a weighted vocabulary of URL terms found with Aho-Corasick, under allow and block rules.

One pass over the url finds all strict and soft terms at once. A term counts only between boundaries (no ASCII
letter or digit right before or after it). One strict term, or ``SOFT_HITS`` distinct soft terms, blocks the url,
unless a rule decides first. The automaton and the rules are parameters of fixed size; no row meets another row,
so nothing is shuffled.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, and is judged by its
terms alone (none: allow). A rule fits its host and all subdomains where the path starts with the rule's path; the
longest rule wins, block before allow on a tie. A very long url is read once and whole, in linear time; repeated rows
each get a result; an empty table gives no rows; only the id and the url are read, so other columns may have any
names. The default vocabulary lists terms by topic (``url_terms``); a table of one's own takes its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.url_terms import STRICT_WEIGHT, vocabulary

VOCABULARY = vocabulary()
#: Terms of a vocabulary table at most; the automaton goes to every task.
MOST_TERMS = 1_000_000
SOFT_HITS = 2

#: The rules of the contract as (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path = rest[end:]
    stop = min((k for k in map(path.find, "?#") if k >= 0), default=len(path))
    return rest[:end].translate(LOWER), path[:stop]


class Rules:
    def __init__(self, rules: tuple[tuple[str, str, str], ...]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def best(self, host: str, path: str) -> tuple[str | None, str | None]:
        found = []
        at = 0
        while host and at >= 0:
            part = host[at:]
            found += [(len(part) + len(p), v == "block", part + p, v) for p, v in self.by_host.get(part, ()) if path.startswith(p)]
            at = host.find(".", at) + 1 or -1
        return max(found)[2:] if found else (None, None)


def terms_of(table: DataFrame) -> dict[str, int]:
    """A vocabulary from a table (term, weight) of at most MOST_TERMS rows; repeated terms take the greatest weight."""
    rows = table.where("term is not null and term != ''").groupBy("term").agg(F.max(F.coalesce(F.col("weight"), F.lit(1))).alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return {r.term: int(r.weight) for r in rows}


def automaton(vocabulary: dict[str, int]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        out.add_word(term.translate(LOWER), (term.translate(LOWER), weight))
    if vocabulary:
        out.make_automaton()
    return out


def term_hits(url: str, terms: ahocorasick.Automaton) -> tuple[list[str], list[str]]:
    """Distinct strict and soft terms of the url that stand between boundaries."""
    low = url.translate(LOWER)
    strict, soft = set(), set()
    for end, (term, weight) in terms.iter(low) if len(terms) else ():
        start = end - len(term) + 1
        if (start == 0 or low[start - 1] not in WORD) and (end + 1 == len(low) or low[end + 1] not in WORD):
            (strict if weight >= STRICT_WEIGHT else soft).add(term)
    return sorted(strict), sorted(soft)


SCHEMA = "host string, path string, rule string, verdict string, strict array<string>, soft array<string>"


def judge_urls(urls: DataFrame, rules=RULES, vocabulary=VOCABULARY, soft_hits: int = SOFT_HITS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: host, path, the rule that decides (null: none), the verdict, and the distinct terms found.

    ``vocabulary`` is a dict of weights or a table (term, weight).
    """
    vocabulary = terms_of(vocabulary) if isinstance(vocabulary, DataFrame) else vocabulary

    @F.pandas_udf(SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ruled, terms = Rules(rules), automaton(vocabulary)
        for batch in batches:
            rows = []
            for url in batch:
                url = url if isinstance(url, str) else ""
                host, path = split_url(url)
                rule, verdict = ruled.best(host, path)
                strict, soft = term_hits(url, terms)
                rows.append((host, path, rule, verdict or ("block" if strict or len(soft) >= soft_hits else "allow"), strict, soft))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "strict", "soft"])

    return urls.select(F.col(id_col).alias("page_id"), judge(F.col(url_col)).alias("j")).select("page_id", "j.*")
