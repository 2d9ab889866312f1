"""All queries of the library and their DuckDB oracles, by name.

A query module registers its functions with `query`. Floating-point results are
rounded on both sides, because sums depend on the order of their terms.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The input tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a function of `Tables`; its doubles are rounded to ``digits``."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(Tables(spark, sf_dir))
            return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


for _module in ("ranking", "cleaning", "joining", "series", "statistics", "texts", "modelling", "state", "sources", "composites", "entities", "finance"):
    import_module(f"plover.plans.{_module}")
