"""Queries by name, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (Tables) as a query; sql may use the views of ``views.SQL``."""

    def keep(f: Callable[[views.Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(views.Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = views.with_views(sql)
        return f

    return keep


def r6(c: Column | str) -> Column:
    """Rounded to six digits, as both engines report doubles; minus zero becomes zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
