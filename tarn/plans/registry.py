"""Queries by name, each with its SQL if there is any."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark, sf_dir: str, name: str):  # noqa: ANN001, ANN201
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
