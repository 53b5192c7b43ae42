"""Polarization: two-condition Stouffer score and its calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import ratio, same_sign
from evidentia.operators.grouping import pivot_first
from evidentia.operators.ordering import row_rank
from evidentia.operators.regression import rank_sum

# Signature, conditions, direction labels, display classes.
SIGNATURE = "ota"
CONDITIONS = {"Rest": "rest", "Stim8hr": "stim8hr", "Stim48hr": "stim48hr"}
TOWARD_POS, TOWARD_NEG = "toward_signature_pos", "toward_signature_neg"
TYPE_A, TYPE_B = "Th2 regulator", "Th1 regulator"


def condition_z(coefficients: DataFrame, row_id: str = "row_id", signature: str = SIGNATURE) -> DataFrame:
    """One row per regulator: first coefficient and z per condition, annotations."""
    kept = coefficients.filter(F.col("signature") == signature)
    wide = pivot_first(
        kept, "regulator", "celltype", list(CONDITIONS), ["coef_mean", "coef_sem"], row_id, CONDITIONS
    )
    notes = kept.groupBy("regulator").agg(
        F.coalesce(F.bool_or("known_regulators"), F.lit(False)).alias("known_regulator"),
        F.min_by("regulator_type", F.when(F.col("regulator_type").isNotNull(), F.col(row_id))).alias("regulator_type"),
    )
    z = {f"z_{p}": ratio(f"{p}_coef_mean", f"{p}_coef_sem") for p in CONDITIONS.values()}
    return wide.join(notes, "regulator").withColumns(z)


def score(z: DataFrame) -> DataFrame:
    """Stouffer score of the two stimulated conditions, ranked by magnitude."""
    both = z.dropna(subset=["stim8hr_coef_mean", "stim48hr_coef_mean"], how="any")
    total = (F.col("z_stim8hr") + F.col("z_stim48hr")) / F.sqrt(F.lit(2.0))
    scored = both.withColumn("polarization_score", total).withColumns(
        {
            "abs_score": F.abs("polarization_score"),
            "direction": F.when(F.col("polarization_score") > 0, TOWARD_POS).otherwise(TOWARD_NEG),
            "signs_agree": same_sign("z_stim8hr", "z_stim48hr"),
            "z_rest_abs": F.abs("z_rest"),
        }
    )
    ranked = row_rank(scored, [("abs_score", "desc"), ("regulator", "asc")])
    return ranked.select(
        F.col("regulator").alias("gene"), "rank", "polarization_score", "abs_score", "direction", "signs_agree",
        "z_stim8hr", "z_stim48hr", "z_rest", "z_rest_abs",
        F.col("stim8hr_coef_mean").alias("coef_stim8hr"), F.col("stim48hr_coef_mean").alias("coef_stim48hr"),
        "known_regulator", "regulator_type",
    )


def calibration(scored: DataFrame) -> DataFrame:
    """One-sided rank-sum test of known regulators over the rest on |score|."""
    return rank_sum(scored.withColumn("__k", F.col("known_regulator").cast("int")), "abs_score", "__k")


def display_class(scored: DataFrame) -> DataFrame:
    """Known type, else sign agreement, as one column."""
    known = F.coalesce("known_regulator", F.lit(False))
    return scored.withColumn(
        "class",
        F.when(known & (F.col("regulator_type") == TYPE_A), TYPE_A)
        .when(known & (F.col("regulator_type") == TYPE_B), TYPE_B)
        .when(F.col("signs_agree"), "signs agree").otherwise("signs disagree"),
    )
