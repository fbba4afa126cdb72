"""Debt, gate and scoring arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.severity import RATINGS, lookup

COST_PER_LINE_MIN = 30
#: The default gate.
GATE = {"min_cov": 80.0, "min_branch": 0.0, "max_dup": 3.0, "max_blockers": 0, "max_security": "A", "max_maintainability": "A"}


def development_cost(loc: Column) -> Column:
    return F.greatest(F.lit(1), loc) * COST_PER_LINE_MIN


def debt_ratio(debt_min: Column, loc: Column) -> Column:
    return debt_min / development_cost(loc)


def format_debt(minutes: Column) -> Column:
    """Days of eight hours, hours and minutes; parts that are 0 are left out."""
    days, hours, mins = F.floor(minutes / 480), F.floor((minutes % 480) / 60), minutes % 60
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("bigint").cast("string"), F.lit(unit)))
    return F.when(minutes <= 0, "0min").otherwise(F.concat_ws(" ", part(days, "d"), part(hours, "h"), part(mins, "min")))


def failed_conditions(coverage: Column, branch: Column, duplication: Column, blockers: Column, security: Column, maintainability: Column, gate=GATE) -> Column:
    """Codes of the gate's conditions that fail; what was not measured is not evaluated."""
    worse = lambda r, limit: F.array_position(F.array(*map(F.lit, RATINGS)), r) > RATINGS.index(limit) + 1
    tests = (
        F.when(coverage < gate["min_cov"], "coverage"),
        F.when((F.lit(gate["min_branch"]) > 0) & (branch < gate["min_branch"]), "branch"),
        F.when(duplication > gate["max_dup"], "duplication"),
        F.when(blockers > gate["max_blockers"], "blockers"),
        F.when(worse(security, gate["max_security"]), "security"),
        F.when(worse(maintainability, gate["max_maintainability"]), "maintainability"),
    )
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def gate_status(failed: Column) -> Column:
    return F.when(F.size(failed) == 0, "PASSED").otherwise("FAILED")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def norm(x: Column, cap: float) -> Column:
    return F.coalesce(clamp(x / cap), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.when(x > 20, 1.0).when(x < -20, 0.0).otherwise(1 / (1 + F.exp(-x)))


#: Prior of a tool's depth.
TOOL_DEPTH = {
    "": 0.55, "native": 0.55, "codeql": 1.0, "joern": 1.0, "semgrep": 0.75, "opengrep": 0.75, "trivy": 0.7, "osv": 0.7, "osv-scanner": 0.7, "grype": 0.7,
    "spotbugs": 0.65, "pmd": 0.65, "findsecbugs": 0.65, "oxlint": 0.4, "eslint": 0.4,
}


def tool_depth(tool: Column, rule_id: Column) -> Column:
    """From the tool's name, or else from an ``EXT:tool:`` rule id."""
    name = F.lower(F.coalesce(F.when(tool != "", tool), F.when(rule_id.startswith("EXT:"), F.split_part(rule_id, F.lit(":"), F.lit(2))), F.lit("")))
    return lookup(name, TOOL_DEPTH, 0.5)


def maintainability_index(volume: Column, cyclomatic: Column, loc: Column) -> Column:
    v, n = F.greatest(volume, F.lit(1.0)), F.greatest(loc, F.lit(1))
    return F.round(F.greatest(F.lit(0.0), (171 - 5.2 * F.log(v) - 0.23 * cyclomatic - 16.2 * F.log(n)) * 100 / 171), 1)


#: Weights of severities and the prior stumps (feature, threshold, below, from there on), base score and rate.
SEVERITY_WEIGHT = {"INFO": 0.1, "MINOR": 0.3, "MAJOR": 0.5, "CRITICAL": 0.8, "BLOCKER": 1.0}
PRIOR_BASE, PRIOR_RATE = 0.4, 1.0
PRIOR_STUMPS = (
    ("is_test", 0.5, 0.15, -0.9), ("is_dist", 0.5, 0.1, -1.2), ("is_generated", 0.5, 0.1, -0.8), ("fp_rate", 0.4, 0.2, -0.7), ("severity", 0.6, -0.1, 0.35),
    ("is_imported", 0.5, 0.05, 0.15), ("path_length", 0.25, -0.05, 0.25), ("tool_depth", 0.7, -0.1, 0.2), ("outlier", 0.6, 0.05, -0.25), ("family", 0.15, -0.1, 0.12),
    ("cognitive", 0.25, -0.15, 0.2), ("nesting", 0.4, -0.05, 0.15), ("churn", 0.1, -0.2, 0.2), ("fan_in", 0.2, -0.05, 0.18), ("reach", 0.5, -0.08, 0.16),
)


#: Paths of tests and of generated files.
TEST, GENERATED = r"\b(test|tests|__tests__|spec)\b|\.(test|spec)\.", r"\b(generated|gen/)\b"


def path_features(path: Column) -> dict[str, Column]:
    p = F.lower(F.translate(path, "\\", "/"))
    flag = lambda c: c.cast("double")
    return {
        "is_test": flag(p.rlike(TEST)),
        "is_generated": flag(p.rlike(GENERATED) | p.contains(".g.")),
        "is_dist": flag(p.rlike(r"(^|/)(dist|build|out|target|node_modules)/")),
    }


def reach(hops: Column) -> Column:
    """1 at an entry, less with every hop; what is never reached counts as far."""
    return F.when(hops.isNull(), 0.15).otherwise(clamp(1 - hops / 8))


def stump_score(features: dict[str, Column], stumps=PRIOR_STUMPS, base: float = PRIOR_BASE, rate: float = PRIOR_RATE) -> Column:
    """The whole ensemble as one expression."""
    out = F.lit(base)
    for name, threshold, below, above in stumps:
        out = out + rate * F.when(features[name] < threshold, below).otherwise(above)
    return out
