"""Query catalog: SURVEY section 2 ID -> Spark query and DuckDB oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame``. Its oracle is a
DuckDB SQL string over the provided tables; fixture views (``v_*``) named in
it are spliced in as CTEs. Queries without a faithful SQL twin register
``sql=None`` and are checked against brute force in ``tests/``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables
from ..sources.views import SPARK_VIEWS, with_views


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


class Ctx:
    """What a query body sees: the tables and fixture views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = Tables(spark, sf_dir)
        # Event time is defined in UTC (day labels, watermarks, NTZ -> TIMESTAMP).
        if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def v(self, name: str) -> DataFrame:
        return SPARK_VIEWS[name](self.t)


def register(key: str, sql: str | None = None):
    """Register ``fn(ctx) -> DataFrame`` under ``key`` with its oracle SQL."""

    def deco(fn: Callable[[Ctx], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Ctx(spark, sf_dir))

        build.__name__ = fn.__name__
        REGISTRY[key] = Query(key, build, with_views(sql) if sql else None)
        return fn

    return deco


_MODULES = (
    "curate", "evaluate", "answers", "vote", "verify", "strategies", "confidence",
    "joins", "web", "context", "privacy", "composition", "streams", "text", "more", "similarity",
)


def load_all() -> dict[str, Query]:
    for m in _MODULES:
        importlib.import_module(f"verity.plans.q_{m}")
    return REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.build for k, q in load_all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in load_all().items() if q.sql}
