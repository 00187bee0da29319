"""Named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where the
result is expressible in SQL, the equivalent query over the raw driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return wrap


def md5_hash_sql(*parts: str, seed: int | str | None = None, digits: int = 8) -> str:
    """SQL twin of ``rareflow.functions.columns.hash32`` (8 digits) and ``hash60`` (15)."""
    items = ([f"'{seed}'"] if seed is not None else []) + [f"cast({p} as varchar)" for p in parts]
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(items)})), 1, {digits}))::bigint"


def load_all() -> None:
    """Import every query module (each registers on import)."""
    from rareflow.plans import data_queries, event_queries, io_queries, metric_queries, model_queries, recovery_queries  # noqa: F401
