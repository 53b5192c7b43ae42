"""Ranked-list quality of positives among unlabeled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import ratio
from evidentia.operators.ordering import null_safe_join, row_rank, scan, value_counts


def at_top(
    df: DataFrame, score: str, label: str, key: str, ks: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """hits@k, recall@k, enrichment@k and the base rate, one row per group and k.

    Ties go by key. Ranks come from the ordered scan, so any k costs the same and no group
    is ranked in one task.
    """
    top = row_rank(df.select(*by, label, score, key), [(score, "desc"), (key, "asc")], by, "__r")
    hits = top.groupBy(*by).agg(
        *[F.count_if((F.col("__r") <= k) & (F.col(label) == 1)).alias(f"__h{k}") for k in ks]
    )
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"))
    if by:
        both = null_safe_join(size, hits, list(by))
    else:
        row = hits.select(F.struct("*").alias("h")).scalar()
        both = size.withColumn("__h", row).select("n", "n_pos", "__h.*")
    lines = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__h{k}").alias("hits")) for k in ks]))
    out = both.select(*by, "n", "n_pos", lines)
    base = ratio("n_pos", "n")
    depth = F.least(F.col("k").cast("bigint"), F.col("n"))
    return out.withColumns(
        {
            "base_rate": base,
            "recall": F.coalesce(ratio("hits", "n_pos"), F.lit(0.0)),
            "enrichment": F.coalesce(ratio(ratio("hits", depth), base), F.lit(0.0)),
        }
    ).withColumn("k", F.col("k").cast("bigint"))


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision with tied scores taken as one step."""
    counts = value_counts(df, score, by, n=F.count(F.lit(1)), pos=F.count_if(F.col(label) == 1))
    placed = scan(counts, [(score, "desc")], by, sums={"tp": F.col("pos"), "seen": F.col("n")})
    steps = placed.groupBy(*by).agg(
        F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("__s"), F.sum("pos").alias("__p")
    )
    return steps.select(*by, F.coalesce(ratio("__s", "__p"), F.lit(0.0)).alias("average_precision"))


def cumulative_hits(df: DataFrame, score: str, label: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank and running number of positives for every row of the ranked list."""
    return scan(
        df, [(score, "desc"), (key, "asc")], by,
        sums={"rank": F.lit(1).cast("bigint"), "hits": F.col(label).cast("bigint")},
    )


def tidy(per_k: DataFrame, ap: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics as (variant..., k, metric, value) rows."""
    wide = per_k.select(
        *by, "k",
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in ("hits", "recall", "enrichment", "base_rate")
        ])),
    )
    whole = ap.select(
        *by, F.lit(None).cast("bigint").alias("k"), F.lit("average_precision").alias("metric"),
        F.col("average_precision").alias("value"),
    )
    return wide.unionByName(whole)


def compare_variants(metrics: DataFrame, metric: str, k: int, variants: Sequence[str]) -> DataFrame:
    """One metric of chosen variants side by side."""
    picked = metrics.filter((F.col("metric") == metric) & (F.col("k") == k))
    return picked.agg(*[F.max(F.when(F.col("variant") == v, F.col("value"))).alias(v) for v in variants])
