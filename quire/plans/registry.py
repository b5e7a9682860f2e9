"""Named queries over the test tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

import importlib
import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AREAS = ["sources", "selection", "assembly", "geometry", "quality", "text", "scalars", "streams", "flows"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` computes the same rows from the same tables."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = textwrap.dedent(sql).strip()
        return fn

    return add


def load() -> None:
    """Import every catalog module once."""
    for area in AREAS:
        importlib.import_module(f"quire.plans.catalog.{area}")
