"""Registered queries over the given tables, each with the SQL that it is checked against."""


def all_plans() -> tuple[dict, dict]:
    from siltstone.plans import catalogue_plans, finding_plans, graph_plans, induction_plans, learning_plans, quality_plans, report_plans, stream_plans, text_plans  # noqa: F401
    from siltstone.plans.registry import ORACLE_SQL, QUERIES

    return dict(QUERIES), dict(ORACLE_SQL)
