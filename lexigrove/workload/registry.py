"""Registration of queries next to the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lexigrove.plans.workspace import Workspace
from lexigrove.workload.views import with_views

Query = Callable[[Workspace], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Registers a query; ``views`` names the derived tables its SQL reads."""
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(views.split(), sql)
        return build

    return register
