"""The registered queries: a Spark callable, the inventory ids it shows and,
where SQL can express it over whole tables, an equivalent statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(name)
        REGISTRY[name] = Query(name, ids, fn, sql)
        return fn
    return add


def load() -> dict[str, Query]:
    import importlib
    for part in ("kmers", "stats", "sequences", "joins", "links", "coverage", "graph", "composition", "scaffold", "layout", "repair", "evidence"):
        importlib.import_module(f"{__package__}.q_{part}")
    return REGISTRY
