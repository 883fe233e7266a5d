"""The registry: name -> (Spark query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


QUERIES: dict[str, Entry] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = Entry(run, sql)
        return run

    return register


# Importing the modules fills the registry.
from cardwatch.workload import (  # noqa: E402, F401
    columns,
    dimensions,
    files,
    governance,
    risk,
    rollups,
    streams,
)
