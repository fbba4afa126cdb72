"""Severities, levels and ratings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from worst to least, ratings from best to worst.
SEVERITIES = ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO")
RATINGS = ("A", "B", "C", "D", "E")


def lookup(value: Column, pairs: dict, default=None) -> Column:
    """The value's entry in a small fixed table."""
    out = F.lit(default)
    for k, v in reversed(list(pairs.items())):
        out = F.when(value == F.lit(k), F.lit(v)).otherwise(out)
    return out


def severity_rank(s: Column) -> Column:
    """5 for BLOCKER down to 1 for INFO; 0 for others."""
    return lookup(s, {x: len(SEVERITIES) - i for i, x in enumerate(SEVERITIES)}, 0)


#: Fixed values below: levels of severities, severities of levels and of scores, and ratings.
def severity_level(s: Column) -> Column:
    return lookup(s, {"BLOCKER": "error", "CRITICAL": "error", "MAJOR": "warning", "MINOR": "warning", "INFO": "note"})


def severity_of_level(level: Column) -> Column:
    return lookup(level, {"error": "CRITICAL", "warning": "MAJOR", "note": "MINOR"}, "INFO")


def severity_of_cvss(score: Column) -> Column:
    return F.when(score >= 9, "BLOCKER").when(score >= 7, "CRITICAL").when(score >= 4, "MAJOR").when(score > 0, "MINOR").otherwise("INFO")


def rating_of_rank(rank: Column) -> Column:
    """Security or reliability rating from the worst severity's rank; none is A."""
    return lookup(F.coalesce(rank, F.lit(0)), {5: "E", 4: "D", 3: "C", 2: "B"}, "A")


def rating_of_debt(ratio: Column) -> Column:
    return F.when(ratio <= 0.05, "A").when(ratio <= 0.1, "B").when(ratio <= 0.2, "C").when(ratio <= 0.5, "D").otherwise("E")


def rating_score(r: Column) -> Column:
    return lookup(r, {x: 5 - i for i, x in enumerate(RATINGS)})


def worse_rating(a: Column, b: Column) -> Column:
    """The letters sort from best to worst."""
    return F.greatest(a, b)
