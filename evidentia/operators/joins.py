"""Joins and lookups.

No side is forced to broadcast: sizes decide at run time, and with adaptive
execution on, skewed keys of the large side are split.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Source(NamedTuple):
    """One table to attach: value columns (None = all but the key) and the fill.

    ``fill=None`` keeps unmatched entities missing (not measured); a number states
    that absence is a real value.
    """

    df: DataFrame
    cols: Sequence[str] | None = None
    fill: float | int | None = None
    name: str = ""


def attach_sources(base: DataFrame, sources: Sequence[Source], on: str) -> tuple[DataFrame, DataFrame]:
    """Left-join every source; returns the table and the match counts before filling."""
    joined, fills, probes = base, {}, []
    for i, src in enumerate(sources):
        cols = list(src.cols) if src.cols is not None else [c for c in src.df.columns if c != on]
        joined = joined.join(src.df.select(on, *cols), on, "left")
        probes.append((src.name or f"source_{i}", cols[0]))
        if src.fill is not None:
            fills |= {c: src.fill for c in cols}
    counts = joined.agg(*[F.count(F.col(f"`{c}`")).alias(n) for n, c in probes])
    matched = counts.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("source"), F.col(n).alias("matched")) for n, _ in probes]))
    )
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()}) if fills else joined
    return filled, matched


def attach_checked(base: DataFrame, right: DataFrame, on: str, cols: Sequence[str]) -> DataFrame:
    """Left join that must keep the row count and leave nothing unmatched.

    The guards run with the query: a repeated right key or an unmatched row raises.
    """
    per_key = right.groupBy(on).agg(
        F.count(F.lit(1)).alias("__n"), *[F.any_value(c).alias(c) for c in cols]
    )
    joined = base.join(per_key, on, "left")
    unique = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"{on} repeats in the joined table")))
    present = F.raise_error(F.concat(F.lit("no match for "), F.col(on).cast("string")))
    guarded = {
        c: F.when(F.col("__n") > 1, unique.cast(right.schema[c].dataType))
        .when(F.col(c).isNull(), present.cast(right.schema[c].dataType))
        .otherwise(F.col(c))
        for c in cols
    }
    return joined.withColumns(guarded).drop("__n")


def attach_zero_filled(universe: DataFrame, scores: DataFrame, on: str, score: str) -> DataFrame:
    """Every member of the universe with its score, 0 where it has none."""
    joined = universe.join(scores.select(on, score), on, "left")
    return joined.withColumn(score, F.coalesce(F.col(score), F.lit(0.0)))


def flag_members(df: DataFrame, key: str, members: DataFrame, member_key: str, name: str) -> DataFrame:
    """0/1 membership column; a missing key is never a member."""
    known = members.select(F.col(member_key).alias("__member")).filter("__member is not null").distinct()
    joined = df.join(known, F.col(key) == F.col("__member"), "left")
    return joined.withColumn(name, F.col("__member").isNotNull().cast("int")).drop("__member")


def only_members(df: DataFrame, key: str, members: DataFrame, member_key: str) -> DataFrame:
    return df.join(members.select(F.col(member_key).alias("__m")), F.col(key) == F.col("__m"), "left_semi")


def without_members(df: DataFrame, key: str, members: DataFrame, member_key: str) -> DataFrame:
    return df.join(members.select(F.col(member_key).alias("__m")), F.col(key) == F.col("__m"), "left_anti")


def keyed_values(table: DataFrame, key: str, value: str, row_id: str, wins: str = "last") -> DataFrame:
    """One value per key; the first or the last entry in source order wins."""
    pick = F.max_by if wins == "last" else F.min_by
    return table.groupBy(key).agg(pick(value, row_id).alias(value))


def look_up(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, name: str,
            default: Column | None = None) -> DataFrame:
    """Map lookup with a default (``None`` leaves unknown keys missing).

    ``table`` must hold each key once; see ``keyed_values``.
    """
    dim = table.select(F.col(table_key).alias("__k"), F.col(value).alias("__v"))
    joined = df.join(dim, F.col(key) == F.col("__k"), "left")
    found = F.col("__v") if default is None else F.coalesce(F.col("__v"), default)
    return joined.withColumn(name, found).drop("__k", "__v")


def place_after(df: DataFrame, column: str, anchor: str) -> DataFrame:
    """Move a column right behind another one, keeping the rest in order."""
    order = [c for c in df.columns if c != column]
    order.insert(order.index(anchor) + 1, column)
    return df.select(*[F.col(f"`{c}`") for c in order])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Projection that names every missing column at once."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in columns])
