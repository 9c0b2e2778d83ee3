"""Registered queries: name -> (callable, check SQL, survey ids)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    ids: str
    sql: str | None


# Cut to six digits at a point no plain fraction sits on, so that a last-bit difference between
# two summation orders cannot flip a tie. The same arithmetic serves both engines.
def steady(c):
    return F.floor(c * 1e6 + 0.37) / 1e6


def steady_sql(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.37E0) / 1e6"


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register a query under the survey ids it covers."""

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(name, fn, ids, sql)
        return fn

    return wrap


def load_all() -> dict[str, Query]:
    import importlib
    import pkgutil

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return REGISTRY
