"""Registry of named queries: key -> (Spark job, DuckDB oracle SQL or None).

Each job takes ``(spark, sf_dir)`` and returns a DataFrame over the given
tables.  ``__spark_entry__.py`` exposes this registry to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storecast.session import apply_conf, ensure_checkpoint_dir, ship_package
from storecast.sources.fixture_sql import with_views
from storecast.sources.tables import Tables

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None, extra: str = ""):
    """Register ``fn(t: Tables) -> DataFrame`` under ``key``; ``sql`` is the
    oracle body (r_* views are added by ``with_views``)."""
    def deco(fn: Callable[[Tables], DataFrame]):
        def job(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_conf(spark)
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return fn(Tables(spark, sf_dir))
        job.__name__ = f"q_{key}"
        job.__doc__ = fn.__doc__
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = job
        if sql is not None:
            ORACLE[key] = with_views(sql, extra)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from storecast.plans import (  # noqa: F401
        q_events, q_features, q_files, q_models, q_records, q_report, q_search, q_stream)
