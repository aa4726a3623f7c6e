"""Name -> (DataFrame builder, oracle SQL) for every registered query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    oracle: str | None = None


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under ``name``; ``oracle`` is DuckDB SQL over the driver tables."""

    def add(build: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(build, oracle)
        return build

    return add
