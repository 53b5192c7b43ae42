"""Duplicate policies. Each is one aggregation with map-side combine, so a key that
holds a large share of the rows shrinks before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDE = (T.ArrayType, T.MapType, T.StructType)


def drop_all_copies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep only rows whose key occurs exactly once."""
    rest = [c for c in df.columns if c not in keys]
    once = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest)).alias("__row"))
        .filter(F.col("__n") == 1)
    )
    return once.select(*keys, "__row.*").select(*df.columns)


def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def keep_first(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """First row per key in source order; ``row_id`` carries that order.

    Narrow rows travel inside the aggregation. Rows with nested columns stay where they
    are: only keys and row ids are aggregated, and the rows are picked by a semi-join.
    """
    if any(isinstance(f.dataType, _WIDE) for f in df.schema.fields):
        first = df.groupBy(*keys).agg(F.min(row_id).alias("__at"))
        first = first.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__at")
        match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
        return df.join(first, match & (F.col(row_id) == F.col("__at")), "left_semi")
    rest = [c for c in df.columns if c not in keys]
    firsts = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(row_id)).alias("__row"))
    return firsts.select(*keys, "__row.*").select(*df.columns)


def first_known(df: DataFrame, keys: Sequence[str], values: Sequence[str], row_id: str) -> DataFrame:
    """Per key, the first non-missing entry of each value column in source order."""
    picks = [F.min_by(v, F.when(F.col(v).isNotNull(), F.col(row_id))).alias(v) for v in values]
    return df.groupBy(*keys).agg(*picks)
