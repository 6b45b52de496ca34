"""Named queries, their SQL counterparts, and views shared between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}
_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def with_ctes(body: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for n in CTES[name][0]:
            visit(n)
        ordered.append(name)

    for n in needs:
        visit(n)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + body


def query(name: str, covers: str, sql: str | None = None, needs: str = ""):
    """Register a query. ``covers`` lists the operator ids it exercises."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            SQL[name] = with_ctes(sql, *needs.split())
        return fn

    return register


def shared(fn: Callable[[SparkSession, str], DataFrame]):
    """A view that is written once per application and read by later queries, the
    way a pipeline hands tables from one job to the next."""
    from rankforge.session import materialize

    def view(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, fn.__name__)
        if key not in _TABLES:
            _TABLES[key] = materialize(fn(spark, sf_dir))
        return _TABLES[key]

    view.__name__ = fn.__name__
    view.__wrapped__ = fn  # the plan without the written table
    return view


def forget_tables() -> None:
    _TABLES.clear()
