"""Large groups, many rules and long lines lose nothing."""

import json
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from siltstone.operators import matching
from siltstone.sources import reports


def test_logs_of_a_hot_source_are_bounded(spark):
    rows = [("hot", f"p{i % 7}", i, 1, f"R{i % 3}", "MAJOR", f"text {i}") for i in range(2000)] + [("cold", "q", 1, 1, "R9", "INFO", "x")]
    rows += rows[:5]
    found = spark.createDataFrame(rows, "source string, path string, ln int, col int, rule_id string, severity string, snippet string")
    logs = reports.sarif_rows(found, ["source"], "t", most=50).collect()
    runs = defaultdict(list)
    for r in logs:
        runs[r.source] += json.loads(r.value)["runs"]
    assert all(len(run["results"]) <= 50 for of in runs.values() for run in of) and len(runs["hot"]) >= 41 and len(runs["cold"]) == 1
    place = lambda x: x["locations"][0]["physicalLocation"]
    got = Counter((s, place(x)["artifactLocation"]["uri"], place(x)["region"]["startLine"], x["ruleId"]) for s, of in runs.items() for run in of for x in run["results"])
    assert got == Counter((r[0], r[1], r[2], r[4]) for r in rows)
    for of in runs.values():
        for run in of:
            assert {x["ruleId"] for x in run["results"]} == {x["id"] for x in run["tool"]["driver"]["rules"]}


def test_every_rule_of_a_large_table(spark):
    n = matching.MOST_RULES + 50
    rules = spark.range(n).select(
        F.format_string("R%05d", "id").alias("rule_id"), F.format_string("x%05d", "id").alias("regex"), F.lit(None).cast("string").alias("unless"), F.lit("MAJOR").alias("severity"), F.lit("BUG").alias("type"),
        F.lit(1).alias("effort"), F.lit("p").alias("pack"), F.array(F.lit("any")).alias("languages"), F.array(F.lit("CWE-1")).alias("cwe"), F.col("id").cast("int").alias("seq"),
    )
    hit = [0, 7, matching.MOST_RULES - 1, *range(matching.MOST_RULES, n)]
    files = spark.createDataFrame([("f", "en", "\n".join(f"x{i:05d}" for i in hit))], "path string, lang string, text string")
    assert sorted(r.rule_id for r in matching.findings(files, rules).collect()) == [f"R{i:05d}" for i in hit]


def test_long_lines_of_diffs_are_whole(spark):
    old, new = "word " * 30_000 + "end", "wörd " * 25_000 + "end"
    df = spark.createDataFrame([(1, f"--- a\n+++ b\n-{old}\n+{new}\n+two")], "id int, diff string")
    assert {r.side: r.text for r in reports.patch_cases(df).collect()} == {"before": old, "after": new + "\ntwo"}


def test_long_path_of_coverage_is_whole(spark, tmp_path):
    path = "d/" * 60_000 + "a.py"
    (tmp_path / "x.info").write_text(f"SF:{path}\nDA:1,1\nend_of_record\n")
    assert [(r.path, r.ln, r.hit) for r in reports.read_lcov(spark, str(tmp_path / "x.info")).collect()] == [(path, 1, True)]


def test_places_in_large_and_null_groups(spark):
    """Places are those of one sort, whatever the ranges: a hot group, a null group, ties, an empty table."""
    import random

    from pyspark.sql import functions as F

    from siltstone.operators.joins import place_in_group

    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(0, 50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(7)
    got = {r.i: (r.place, r.group_size) for r in place_in_group(df, "g", [F.desc("k"), F.asc("i")]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        want |= {r[2]: (n + 1, len(own)) for n, r in enumerate(own)}
    assert got == want and place_in_group(df.limit(0), "g", [F.asc("k")]).count() == 0
