"""Registration of runnable queries beside the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its check where SQL can state it."""

    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(df: DataFrame, places: int = 6) -> DataFrame:
    """Comparable output: integers as bigint, floats rounded, booleans as 0/1."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType, T.DecimalType)):
            c = c.cast("bigint") if not isinstance(f.dataType, T.BooleanType) else c.cast("int").cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # Scale, round, scale back: decimal rounding of the printed form would treat
            # values half way between two results differently from other engines.
            c = F.round(c.cast("double") * F.lit(10.0**places), 0) / F.lit(10.0**places) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)
