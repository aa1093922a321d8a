"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.sources.tables import MEMORY_VIEWS, VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SETS = {"graph": VIEWS, "memory": MEMORY_VIEWS, "both": VIEWS.rstrip() + "," + MEMORY_VIEWS}


def query(sql: str | None = None, views: str | bool = "graph", recursive: bool = False) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL behind the named set of views ('graph', 'memory', 'both'; False: none). SQL that begins with + has views of its own."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            own = sql.lstrip()
            ORACLES[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{SETS['graph' if views is True else views]}{',' if own[:1] == '+' else ''} {own.removeprefix('+')}") if views else sql
        return f

    return put
