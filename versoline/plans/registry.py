"""Queries by survey id, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from versoline.plans.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, tuple[list[str], str]] = {}


def query(name: str, sql: str | None = None, needs: list[str] | None = None):
    """Register ``fn(tables) -> DataFrame`` under a survey id."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = (needs or [], sql)
        return fn

    return register


def oracles() -> dict[str, str]:
    """Every oracle with the views it needs in front."""
    return {name: with_views(needs, sql) for name, (needs, sql) in ORACLES.items()}
