"""Registered queries: a name, the Spark plan, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from partlens.plans.tables import oracle
from partlens.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name; ``sql`` may name derived tables in braces."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = wraps(function)(lambda spark, sf: function(tune(spark), sf))
        if sql is not None:
            ORACLES[function.__name__] = oracle(sql)
        return function

    return add
