"""Registry of the named queries: the Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Named:
    name: str
    run: Run
    covers: tuple[str, ...]
    sql: str | None


CATALOG: dict[str, Named] = {}


def query(covers: str, sql: str | None = None, name: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        key = name or run.__name__
        if key in CATALOG:
            raise ValueError(f"query '{key}' is registered twice")
        CATALOG[key] = Named(key, run, tuple(covers.split()), sql)
        return run

    return add
