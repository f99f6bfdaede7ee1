"""Registered queries, each a DataFrame plan with its SQL twin for an independent engine."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = ("heuristics", "ranking", "formats", "files", "reports", "filters", "aggregates", "joins", "bias", "texts", "search", "shapes", "stores", "models", "records", "scans", "streams")


@dataclass
class Tables:
    """The tables of a folder, read lazily; columns and rows are pruned by Catalyst."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of Tables under its name, with the equivalent SQL if there is any."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        if f.__name__ in _queries:
            raise ValueError(f"a query of the name {f.__name__} is there already")
        _queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"presswork.plans.{name}")


def queries() -> dict:
    _load()
    return dict(_queries)


def oracle_sql() -> dict:
    _load()
    return dict(_sql)
