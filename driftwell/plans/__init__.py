"""Registered queries, by family."""


def all_queries() -> tuple[dict, dict]:
    """(queries, DuckDB equivalents) of all families."""
    from driftwell.plans import changes, fileindex, pathpolicy, telemetry  # noqa: F401
    from driftwell.plans.catalog import ORACLES, QUERIES

    return QUERIES, ORACLES
