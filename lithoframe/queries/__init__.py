"""Registered queries over the driver tables, each beside its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what an independent engine must answer on the same tables."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def load() -> None:
    """Import every module that registers queries."""
    from lithoframe.queries import (  # noqa: F401
        catalog,
        geometry,
        labels,
        metrics,
        patches,
        qc,
        scoring,
        slices,
        sources,
        sticks,
    )
