"""Ranks, running totals and quantiles that do not depend on one task.

An ordered window sorts a whole partition key in one task, which a table-wide rank or a
group with a third of the rows cannot afford. ``scan`` range-partitions on (group, order)
instead, so a hot group spreads over many slices, keeps that layout with a reliable
checkpoint, runs the window inside each slice and adds what the earlier slices of the group
contribute. Only one total per (group, slice) is exchanged for that. Every size of input
takes this one path; small input merely gets few slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import checkpoint_root

SLICE = "__slice"

Order = Sequence[tuple[str, str]]  # (column, "asc" | "desc")


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of the tables a plan reads, by Catalyst's statistics; costs no job.

    The estimate of the plan's root multiplies both sides of every join and is useless
    as a bound; the inputs are what the lookups and aggregations here start from.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    except AttributeError:  # a session without a JVM handle: treat as large
        return 1 << 62


def partition_count(df: DataFrame) -> int:
    """Partitions for an explicit repartition: the session's number, fewer on small input."""
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(wanted, max(spark.sparkContext.defaultParallelism, estimated_bytes(df) // (4 << 20)))


def order_columns(order: Order) -> list[Column]:
    return [
        F.col(c).asc_nulls_first() if way == "asc" else F.col(c).desc_nulls_last()
        for c, way in order
    ]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` in which NULL matches NULL; keeps one copy of the keys."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def sliced(df: DataFrame, by: Sequence[str], order: Order) -> DataFrame:
    """Lay rows out in (group, order) ranges and number the ranges.

    The checkpoint fixes the ranges: slice totals and rows are read from the
    same files, and a lost executor costs no recomputation.
    """
    checkpoint_root(df.sparkSession)
    parts = partition_count(df)
    keys = [F.col(c) for c in by] + order_columns(order)
    return df.repartitionByRange(parts, *keys).withColumn(SLICE, F.spark_partition_id()).checkpoint()


def scan(
    df: DataFrame,
    order: Order,
    by: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running sums / minima of ``order`` and whole-group totals for each ``by`` group.

    ``order`` must be total within a group for a reproducible result.
    """
    sums, mins, totals = dict(sums or {}), dict(mins or {}), dict(totals or {})
    group = by or [F.lit(0)]
    measures = {f"__m_{n}": e for n, e in (sums | mins | totals).items()}
    laid_out = sliced(df.withColumns(measures), by, order)
    per_slice = laid_out.groupBy(*by, SLICE).agg(
        *[F.sum(f"__m_{n}").alias(f"__b_{n}") for n in sums | totals],
        *[F.min(f"__m_{n}").alias(f"__b_{n}") for n in mins],
    )
    # One row per (group, slice): at most groups + slices rows.
    earlier = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = per_slice.withColumns(
        {f"__b_{n}": F.sum(f"__b_{n}").over(earlier) for n in sums}
        | {f"__b_{n}": F.min(f"__b_{n}").over(earlier) for n in mins}
        | {f"__b_{n}": F.sum(f"__b_{n}").over(Window.partitionBy(*group)) for n in totals}
    )
    inside = (
        Window.partitionBy(*by, SLICE)
        .orderBy(*order_columns(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = laid_out.withColumns(
        {n: F.sum(f"__m_{n}").over(inside) for n in sums}
        | {n: F.min(f"__m_{n}").over(inside) for n in mins}
    )
    out = null_safe_join(out, before, [*by, SLICE])
    # A NULL total means no earlier slice; least() skips NULL by itself.
    out = out.withColumns(
        {n: F.coalesce(F.col(f"__b_{n}") + F.col(n), F.col(n), F.col(f"__b_{n}")) for n in sums}
        | {n: F.least(F.col(n), F.col(f"__b_{n}")) for n in mins}
        | {n: F.col(f"__b_{n}") for n in totals}
    )
    return out.drop(SLICE, *measures, *[f"__b_{n}" for n in sums | mins | totals])


def row_rank(df: DataFrame, order: Order, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Contiguous 1-based rank over a total order."""
    return scan(df, order, by, sums={name: F.lit(1).cast("bigint")})


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), **counts: Column) -> DataFrame:
    """Rows per distinct value; repeated values collapse before the shuffle."""
    measures = counts or {"n": F.count(F.lit(1))}
    return df.groupBy(*by, value).agg(*[e.alias(n) for n, e in measures.items()])


def average_rank(
    df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank", way: str = "desc",
    truncate: bool = True,
) -> DataFrame:
    """Average rank of ties (optionally truncated to an integer) within each group.

    Ranks are found on the distinct values, so a tied block of any size costs one
    row; missing values get no rank.
    """
    counts = value_counts(df.filter(F.col(value).isNotNull()), value, by)
    ranked = scan(counts, [(value, way)], by, sums={"__to": F.col("n")})
    mean_rank = F.col("__to") - (F.col("n") - 1) / F.lit(2.0)
    mean_rank = F.floor(mean_rank).cast("bigint") if truncate else mean_rank.cast("double")
    return null_safe_join(df, ranked.select(*by, value, mean_rank.alias(name)), [*by, value])


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), name: str = "fdr") -> DataFrame:
    """False-discovery-rate adjusted p per group: ``min over j >= i of p_j * m / j``.

    All copies of one p share the value found at their last position, so the work
    runs on distinct p values. Missing p stays missing and does not count.
    """
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-300)), F.lit(1.0))
    tagged = df.withColumn("__p", clipped)
    counts = value_counts(tagged.filter(F.col(p).isNotNull()), "__p", by)
    placed = scan(counts, [("__p", "asc")], by, sums={"__k": F.col("n")}, totals={"__m": F.col("n")})
    placed = placed.withColumn("__q", F.col("__p") * F.col("__m") / F.col("__k"))
    adjusted = scan(placed, [("__p", "desc")], by, mins={name: F.col("__q")})
    adjusted = adjusted.select(*by, "__p", F.least(F.col(name), F.lit(1.0)).alias(name))
    return null_safe_join(tagged, adjusted, [*by, "__p"]).withColumn(
        name, F.when(F.col(p).isNotNull(), F.col(name))
    ).drop("__p")


def qq_points(df: DataFrame, observed: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Expected signed -log10 under a uniform null beside each sorted observation."""
    kept = df.filter(F.col(observed).isNotNull())
    one = F.lit(1).cast("bigint")
    placed = scan(kept, [(observed, "asc"), (key, "asc")], by, sums={"k": one}, totals={"n": one})
    q = (F.col("k") - F.lit(0.5)) / F.col("n")
    gap = q - F.lit(0.5)
    expected = F.signum(gap) * -F.log10(F.lit(1.0) - F.lit(2.0) * F.abs(gap) + F.lit(1e-300))
    return placed.withColumn("expected", expected)


def quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (), times: Column | None = None,
    part: tuple[str, str] | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per name.

    Found on the distinct values and their running counts, so no group is held in one task.
    ``times`` says how often a row counts. ``part`` names two columns, alike within a group, when rows are only
    those around the quantiles: how many of the group lie below all of them, and how many the group has.
    """
    often = (F.lit(1) if times is None else times).cast("bigint").alias("__times")
    known = df.filter(F.col(value).isNotNull()).select(*by, *(part or ()), F.col(value).cast("double").alias(value), often)
    counts = value_counts(known, value, [*by, *(part or ())], n=F.sum("__times"))
    placed = scan(counts, [(value, "asc")], by, sums={"__to": F.col("n")}, totals={"__n": F.col("n")})
    if part:
        placed = placed.withColumns({"__to": F.col("__to") + F.col(part[0]), "__n": F.col(part[1])})
    picks = []
    for name, q in probs.items():
        picks += _neighbours(name, F.col("__to"), F.col(value), _position(q))
    picked = placed.groupBy(*by).agg(F.max("__n").alias("__n"), *picks)
    return picked.select(*by, *[_interpolated(name, _position(q)).alias(name) for name, q in probs.items()])


def _position(q: float) -> Column:
    return (F.col("__n") - 1) * F.lit(float(q))


def _neighbours(name: str, to: Column, value: Column, at: Column) -> list[Column]:
    """The two order statistics around a fractional position."""
    return [
        F.min(F.when(to > F.floor(at), value)).alias(f"__lo_{name}"),
        F.min(F.when(to > F.ceil(at), value)).alias(f"__hi_{name}"),
    ]


def _interpolated(name: str, at: Column) -> Column:
    lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
    return lo + (at - F.floor(at)) * (hi - lo)


def top_rows(df: DataFrame, order: Order, k: int) -> DataFrame:
    """The k first rows of a total order (``TakeOrderedAndProject``)."""
    return df.orderBy(*order_columns(order)).limit(k)


def seeded_key(seed: object, *parts: Column | str) -> Column:
    """A reproducible pseudo-random sort key, the same under any partitioning."""
    pieces: list[Column] = [F.lit(str(seed))]
    for part in parts:
        pieces.append((F.col(part) if isinstance(part, str) else part).cast("string"))
    return F.md5(F.concat_ws(":", *pieces))


def seeded_sample(df: DataFrame, key: str, n: int, seed: object) -> DataFrame:
    """n rows without replacement, chosen by a seeded hash of the key."""
    return (
        df.withColumn("__draw", seeded_key(seed, key))
        .orderBy("__draw", key)
        .limit(n)
        .drop("__draw")
    )
