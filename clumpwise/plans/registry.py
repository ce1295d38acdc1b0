"""All queries of the structure operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from clumpwise.sources.fixtures import view, with_views

FLAGSHIP = "d18_half_mass_radius"

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

#: Modules whose queries are registered when they are imported.
MODULES = ("queries_members", "queries_gas", "queries_groups", "queries_tables", "queries_scalars")


def query(name: str, views: tuple[str, ...], sql: str | None = None) -> Callable:
    """Register a function of the named views' DataFrames, with its DuckDB SQL over the same views."""

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _FOUND:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*(view(spark, sf_dir, v) for v in views))

        run.__doc__ = fn.__doc__
        _FOUND[name] = run, None if sql is None else with_views(views, sql)
        return fn

    return register


def _load() -> None:
    for m in MODULES:
        import_module(f"clumpwise.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _FOUND.items() if s is not None}
