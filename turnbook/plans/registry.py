"""Named queries over the given tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is left out where SQL cannot express the state involved."""

    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return register


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Select and type the output columns.

    Each word is ``name`` or ``name:type``: ``l`` bigint, ``d`` double, ``rN``
    double rounded to N decimals.  ``a=b`` renames column b to a.
    """
    columns = []
    for word in spec.split():
        target, _, kind = word.partition(":")
        target, _, origin = target.partition("=")
        value = F.col(origin or target)
        if kind == "l":
            value = value.cast("bigint")
        elif kind == "d":
            value = value.cast("double")
        elif kind.startswith("r"):
            value = F.round(value.cast("double"), int(kind[1:]))
        columns.append(value.alias(target))
    return df.select(*columns)
