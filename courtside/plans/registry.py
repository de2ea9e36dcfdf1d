"""Named queries over the marketplace tables, each with an optional DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from courtside.sources.fixtures import Marketplace, with_views

AS_OF = "1998-06-01 14:30:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(m: Marketplace) -> DataFrame``; ``oracle`` may name marketplace views freely."""

    def register(fn: Callable[[Marketplace], DataFrame]):
        def run(spark: SparkSession, path: str) -> DataFrame:
            return fn(Marketplace(spark, path))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register
