"""Set algebra over entity lists, computed on one membership table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import percent


def membership(sets: Mapping[str, DataFrame], key: str = "entity") -> DataFrame:
    """One row per entity with a 0/1 column per set.

    Each input is a one-column table. Union-all plus one aggregation replaces a chain
    of full joins, and repeated entries collapse before the shuffle.
    """
    names = list(sets)
    parts = []
    for name, df in sets.items():
        parts.append(
            df.select(
                F.col(df.columns[0]).alias(key),
                *[F.lit(1 if n == name else 0).alias(n) for n in names],
            )
        )
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(n).alias(n) for n in names])


def overlap_counts(table: DataFrame, left: str, right: str) -> DataFrame:
    """Sizes of both sets, their intersection, differences and union, in one pass."""
    a, b = F.col(left) == 1, F.col(right) == 1
    return table.agg(
        F.count_if(a).alias("n_left"),
        F.count_if(b).alias("n_right"),
        F.count_if(a & b).alias("n_both"),
        F.count_if(a & ~b).alias("n_only_left"),
        F.count_if(b & ~a).alias("n_only_right"),
        F.count_if(a | b).alias("n_union"),
    )


def overlap_report(table: DataFrame, left: str, right: str) -> DataFrame:
    """Overlap summary as (metric, value) rows; a share of an empty set is missing."""
    counts = overlap_counts(table, left, right)
    lines = [
        ("left", F.col("n_left")),
        ("right", F.col("n_right")),
        ("both", F.col("n_both")),
        ("only_left", F.col("n_only_left")),
        ("only_right", F.col("n_only_right")),
        ("union", F.col("n_union")),
        ("pct_left_in_right", percent("n_both", "n_left")),
        ("pct_right_in_left", percent("n_both", "n_right")),
        ("jaccard_pct", percent("n_both", "n_union")),
    ]
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in lines]))
    )


def fact_overlap(facts: DataFrame, item: str, flagged: str) -> DataFrame:
    """Distinct items, those touching at least one flagged entity, and their share.

    Items are reduced to one row each first, so no distinct count meets a hot value.
    """
    items = facts.groupBy(item).agg(F.max(flagged).alias("__hit"))
    return items.agg(
        F.count(item).alias("n_items"),
        F.count_if((F.col("__hit") == 1) & F.col(item).isNotNull()).alias("n_items_hit"),
    ).withColumn("pct_hit", percent("n_items_hit", "n_items"))
