"""Every registered query with its SQL, by area."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import counting, detection, history, parsing, ranks, scalars, scoring, shapes, streams

Query = Callable[[SparkSession, str], DataFrame]

_AREAS = (scalars, parsing, detection, shapes, counting, history, ranks, scoring, streams)


def queries() -> dict[str, Query]:
    return {name: run for area in _AREAS for name, run in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in _AREAS for name, sql in area.SQL.items()}
