"""Registry of named queries. A query takes (spark, sf_dir); ``sql`` is its oracle."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str) -> Column:
    """A double rounded for comparison between engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def md5_sql(*parts) -> str:
    """md5 over '|'-joined parts; strings starting with a quote are literals."""
    return "md5(concat_ws('|', " + ", ".join(f"({p})::VARCHAR" for p in parts) + "))"


def draw_sql(*parts) -> str:
    """The keyed draw of ``tallyflow.functions.draw`` in oracle SQL."""
    return f"(('0x' || substr({md5_sql(*parts)}, 1, 8))::UBIGINT / 4294967296::DOUBLE)"


def hash60_sql(*parts) -> str:
    return f"('0x' || substr({md5_sql(*parts)}, 1, 15))::BIGINT"
