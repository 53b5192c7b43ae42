"""Panel x target enrichment over background universes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import contingency
from evidentia.operators.sets import membership

# Universe names, their display names, the expression thresholds.
UNIVERSES = [
    "All genes (HPA-20k proxy)", "Immune-expressed nTPM>=1", "Immune-expressed nTPM>=5",
    "Druggable genome", "Druggable ∩ immune-expr(>=1)",
]
DISPLAY = dict(zip(UNIVERSES, [
    "All genes (~20,000)", "Immune-expressed (HPA, nTPM≥1)", "Immune-expressed (HPA, nTPM≥5)",
    "Druggable genome (Finan et al. 2017)", "Druggable ∩ immune-expressed",
]))
COMPARED = [UNIVERSES[0], UNIVERSES[1], UNIVERSES[3]]


def max_expression(expression: DataFrame, keys=("gene", "gene_name"), value: str = "ntpm") -> DataFrame:
    """Highest value per entity; rows without a key are dropped."""
    known = expression.dropna(subset=list(keys))
    return known.groupBy(*keys).agg(F.max(value).alias(value))


def member_table(panel: DataFrame, target: DataFrame, druggable: DataFrame, expression: DataFrame) -> DataFrame:
    """Entities with panel / target / druggable / measured flags and top expression."""
    top = expression.groupBy(F.col("gene_name").alias("entity")).agg(F.max("ntpm").alias("max_ntpm"))
    flags = membership({"panel": panel, "target": target, "druggable": druggable, "measured": top.select("entity")})
    return flags.join(top, "entity", "left")


def universe_conditions() -> dict:
    top = F.coalesce("max_ntpm", F.lit(-1.0))
    conditions = [F.lit(True), top >= 1, top >= 5, F.col("druggable") == 1, (F.col("druggable") == 1) & (top >= 1)]
    return dict(zip(UNIVERSES, conditions))


def build(panel: DataFrame, target: DataFrame, druggable: DataFrame, expression: DataFrame,
          alternative: str = "greater") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numeric table, readable table and the plotted comparison."""
    members = member_table(panel, target, druggable, max_expression(expression))
    result = contingency.enrichment(members, "panel", "target", universe_conditions(), alternative)
    return result, contingency.readable(result, DISPLAY), contingency.comparison(result, COMPARED)
