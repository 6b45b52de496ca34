"""The operators applied to the given tables, each with its SQL counterpart."""

from __future__ import annotations

MODULES = (
    "catalog_queries", "ranking_queries", "interaction_queries", "feedback_queries", "experiment_queries", "recommend_queries", "report_queries",
    "explain_queries", "source_queries",
)


def load():
    """(queries, SQL) with every module of this package registered."""
    from rankforge.workload import registry
    from importlib import import_module

    for name in MODULES:
        import_module(f"rankforge.workload.{name}")

    return registry.QUERIES, registry.SQL
