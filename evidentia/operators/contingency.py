"""2x2 enrichment statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import exponent_text, fold_text, rate_text, ratio, stars
from evidentia.functions.tails import fisher_udf

Z95 = 1.96  # fixed value: half-width of the 95 % interval in standard errors


def tables_by_universe(
    members: DataFrame, panel: str, target: str, universes: Mapping[str, Column]
) -> DataFrame:
    """Cells a, b, c, d of panel x target inside every universe.

    ``members`` has one row per entity with 0/1 columns; a universe is a condition on
    it. All universes are counted in one pass as conditional counts, then stacked:
    rows are neither repeated per universe nor shuffled.
    """
    p, t = F.col(panel) == 1, F.col(target) == 1
    aggs = []
    for i, inside in enumerate(universes.values()):
        aggs += [
            F.count_if(inside & p & t).alias(f"a{i}"),
            F.count_if(inside & p & ~t).alias(f"b{i}"),
            F.count_if(inside & ~p & t).alias(f"c{i}"),
            F.count_if(inside & ~p & ~t).alias(f"d{i}"),
        ]
    cells = members.agg(*aggs)
    rows = [
        F.struct(
            F.lit(name).alias("universe"),
            *[F.col(f"{cell}{i}").alias(cell) for cell in "abcd"],
        )
        for i, name in enumerate(universes)
    ]
    return cells.select(F.inline(F.array(*rows)))


def odds_and_rates(cells: DataFrame) -> DataFrame:
    """Rates, risk ratio, sample odds ratio and its log-normal 95 % interval.

    The interval is missing when any cell is 0; with c = 0 the risk ratio is infinite.
    """
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    inf = F.lit(float("inf"))
    p1, p0 = ratio(a, a + b), ratio(c, c + d)
    odds = F.when((b * c) > 0, a * d / (b * c)).when((a * d) > 0, inf)
    spread = Z95 * F.sqrt(ratio(1, a) + ratio(1, b) + ratio(1, c) + ratio(1, d))
    whole = F.least(a, b, c, d) > 0
    return cells.withColumns(
        {
            "N": F.col("a") + F.col("b") + F.col("c") + F.col("d"),
            "p_tgt_iei": p1,
            "p_tgt_non": p0,
            "RR": F.when(c > 0, ratio(p1, p0)).otherwise(inf),
            "OR": odds,
            "OR_lo": F.when(whole, F.exp(F.log(odds) - spread)),
            "OR_hi": F.when(whole, F.exp(F.log(odds) + spread)),
        }
    )


def exact_p(cells: DataFrame, alternative: str = "greater", name: str = "p") -> DataFrame:
    """Exact 2x2 test, one-sided (greater) or two-sided."""
    return cells.withColumn(name, fisher_udf(alternative)("a", "b", "c", "d"))


def enrichment(
    members: DataFrame, panel: str, target: str, universes: Mapping[str, Column], alternative: str = "greater"
) -> DataFrame:
    return exact_p(odds_and_rates(tables_by_universe(members, panel, target, universes)), alternative)


def readable(result: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Enrichment rows as display text."""
    label = F.col("universe")
    if labels:
        label = F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[label], label)
    return result.select(
        label.alias("comparison_group"),
        rate_text("a", F.col("a") + F.col("b")).alias("panel_rate"),
        rate_text("c", F.col("c") + F.col("d")).alias("other_rate"),
        fold_text(ratio("p_tgt_iei", "p_tgt_non"), F.col("OR"), F.col("OR_lo"), F.col("OR_hi")).alias("fold_text"),
        exponent_text("p").alias("p_text"),
    )


def comparison(result: DataFrame, chosen: list[str]) -> DataFrame:
    """Rate per cent, fold and stars for chosen universes in the given order."""
    place = F.array_position(F.array(*[F.lit(u) for u in chosen]), F.col("universe"))
    return result.filter(F.col("universe").isin(*chosen)).select(
        place.cast("bigint").alias("position"), "universe",
        (100.0 * F.col("p_tgt_iei")).alias("panel_pct"),
        (100.0 * F.col("p_tgt_non")).alias("other_pct"),
        ratio("p_tgt_iei", "p_tgt_non").alias("fold"),
        stars("p").alias("stars"),
    )
