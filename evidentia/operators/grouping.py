"""Grouped summaries: lists, constants, pivots, histograms, arg-max."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.ordering import null_safe_join, quantiles, scan


def collapse(
    df: DataFrame,
    keys: Sequence[str],
    lists: Sequence[str] = (),
    counts: Mapping[str, str] | None = None,
    constants: Sequence[str] = (),
    sep: str = "; ",
) -> DataFrame:
    """One row per key: sorted distinct ``sep``-joined lists, distinct counts, constants.

    Empty and missing entries are left out of lists and counts. A constant column
    that varies inside a group raises. Values are made distinct per partition
    (``collect_set`` combines before the shuffle); what reaches one task is the
    distinct list itself, which is the value asked for. A column that is only counted
    is never listed.
    """
    counts = dict(counts or {})
    filled = {c: F.nullif(F.col(c), F.lit("")) for c in (*lists, *counts.values())}
    aggs = [F.collect_set(filled[c]).alias(f"__s_{c}") for c in dict.fromkeys(lists)]
    aggs += [F.count_distinct(filled[c]).alias(f"__d_{n}") for n, c in counts.items() if c not in lists]
    for c in constants:
        aggs += [
            F.min(F.col(c)).alias(f"__lo_{c}"), F.max(F.col(c)).alias(f"__hi_{c}"),
            F.count(F.col(c)).alias(f"__k_{c}"),
        ]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *aggs)
    out = [F.col(k) for k in keys]
    out += [F.array_join(F.array_sort(F.col(f"__s_{c}")), sep).alias(c) for c in lists]
    out += [
        (F.size(F.col(f"__s_{c}")).cast("bigint") if c in lists else F.col(f"__d_{name}")).alias(name)
        for name, c in counts.items()
    ]
    for c in constants:
        lo, hi, known = F.col(f"__lo_{c}"), F.col(f"__hi_{c}"), F.col(f"__k_{c}")
        steady = ((lo == hi) & (known == F.col("__n"))) | (known == 0)
        broken = F.raise_error(F.lit(f"column {c} is not constant within its group"))
        out.append(F.when(steady, lo).otherwise(broken.cast(df.schema[c].dataType)).alias(c))
    return grouped.select(*out)


def list_parts(df: DataFrame, keys: Sequence[str], value: str, part_chars: int = 1 << 20, sep: str = "; ") -> DataFrame:
    """(keys, part, values): the sorted distinct values of every group as texts of about ``part_chars``.

    The form of ``collapse`` for groups of any size: values become rows, are numbered by their
    running length, and only a bounded part is joined to one text. Parts count from 0 and follow each
    other in order; empty and missing values are left out.
    """
    rows = df.select(*keys, F.nullif(F.col(value).cast("string"), F.lit("")).alias("__v")).filter("__v is not null").distinct()
    placed = scan(rows, [("__v", "asc")], keys, sums={"__to": (F.length("__v") + len(sep)).cast("bigint")})
    begin = F.col("__to") - F.length("__v") - len(sep)
    parts = placed.withColumn("part", F.floor(begin / part_chars).cast("bigint")).groupBy(*keys, "part")
    return parts.agg(F.array_join(F.array_sort(F.collect_list("__v")), sep).alias("values"))


def pivot_once(
    df: DataFrame, key: str, column: str, values: Sequence, metrics: Sequence[str],
    prefixes: Mapping | None = None,
) -> DataFrame:
    """Long to wide with a fixed column order; a repeated (key, column) raises."""
    aggs = []
    for v in values:
        here = F.col(column) == F.lit(v)
        prefix = (prefixes or {}).get(v, str(v))
        for m in metrics:
            single = F.any_value(F.when(here, F.col(m)), ignoreNulls=True)
            repeated = F.raise_error(F.lit(f"repeated ({key}, {column}) pair")).cast(df.schema[m].dataType)
            aggs.append(F.when(F.count_if(here) > 1, repeated).otherwise(single).alias(f"{prefix}_{m}"))
    return df.groupBy(key).agg(*aggs)


def pivot_first(
    df: DataFrame, key: str, column: str, values: Sequence, metrics: Sequence[str], row_id: str,
    prefixes: Mapping | None = None,
) -> DataFrame:
    """Long to wide taking the first non-missing entry in source order."""
    aggs = []
    for v in values:
        prefix = (prefixes or {}).get(v, str(v))
        for m in metrics:
            at = F.when((F.col(column) == F.lit(v)) & F.col(m).isNotNull(), F.col(row_id))
            aggs.append(F.min_by(F.col(m), at).alias(f"{prefix}_{m}"))
    return df.groupBy(key).agg(*aggs)


def finite_bounds(df: DataFrame, value: str) -> Column:
    """Smallest and largest finite value as a one-row scalar struct (lo, hi)."""
    from evidentia.functions.scalars import is_finite

    x = F.when(is_finite(value), F.col(value))
    return df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("bounds")).scalar()


def equal_width_bins(
    df: DataFrame, value: str, bins: int, by: Sequence[str] = (),
    lo: float | None = None, hi: float | None = None,
) -> DataFrame:
    """Histogram with right-closed bins, the lowest edge included; empty bins are absent.

    Without explicit limits the finite minimum and maximum of the column are used, and values
    that are not finite have no bin. With explicit limits a value outside them is an error.
    """
    if lo is None or hi is None:
        tagged = df.withColumn("__b", finite_bounds(df, value))
        low, high = F.col("__b.lo"), F.col("__b.hi")
    else:
        tagged, low, high = df, F.lit(float(lo)), F.lit(float(hi))
    width = (high - low) / F.lit(float(bins))
    place = F.ceil((F.col(value) - low) / width)
    bucket = F.greatest(F.lit(1), F.least(F.lit(bins), place)).cast("bigint")
    inside = (F.col(value) >= low) & (F.col(value) <= high)
    if lo is not None and hi is not None:
        inside = F.when(F.col(value).isNull() | inside, inside).otherwise(
            F.raise_error(F.lit(f"{value} lies outside the limits {lo} to {hi}")).cast("boolean")
        )
    inside = F.col(value).isNotNull() & inside
    binned = tagged.filter(inside).select(
        *by, bucket.alias("bin"), (low + (bucket - 0.5) * width).alias("mid")
    )
    return binned.groupBy(*by, "bin").agg(F.min("mid").alias("mid"), F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, value: str, by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Count, mean and exact quantiles of a value per group."""
    basic = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return null_safe_join(basic, quantiles(df, value, probs, by), list(by))


def frequent_or_other(df: DataFrame, column: str, k: int, name: str, other: str = "other") -> DataFrame:
    """Recode all but the k most frequent values as ``other``; ties go alphabetically."""
    top = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
        .orderBy(F.desc("__n"), F.asc(column)).limit(k)
        .select(F.col(column).alias("__top"))
    )
    # At most k rows by construction, hence safe to send to every executor.
    joined = df.join(F.broadcast(top), F.col(column) == F.col("__top"), "left")
    return joined.withColumn(name, F.coalesce(F.col("__top"), F.lit(other))).drop("__top")


def group_share(df: DataFrame, group: str) -> DataFrame:
    """Number of groups, rows, and the share of rows held by the largest group."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("__n").alias("n_rows"),
        (F.max("__n") / F.sum("__n")).alias("largest_share"),
    )


def gap_ranking(
    df: DataFrame, key: str, condition: str, value: str, baseline: str, others: Sequence[str], k: int
) -> DataFrame:
    """Rows of the k keys with the largest |baseline - other| gap, gap attached.

    A missing condition is skipped; keys without any gap rank last.
    """
    wide = pivot_once(df, key, condition, [baseline, *others], [value])
    base = F.col(f"{baseline}_{value}")
    gaps = [F.abs(base - F.col(f"{o}_{value}")) for o in others]
    gap = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    top = wide.select(key, gap.alias("gap")).orderBy(F.desc_nulls_last("gap"), F.asc(key)).limit(k)
    return df.join(F.broadcast(top), key)
