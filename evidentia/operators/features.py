"""Labels and the model feature table, with one missing-value policy per block."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import any_at_least, flag, max_abs, number
from evidentia.operators.joins import flag_members
from evidentia.operators.ordering import quantiles

# Column names of the assay block and the constraint block.
CONDITIONS = ("rest", "stim8hr", "stim48hr")
METRICS = ("coef_beta", "se_beta", "signed_log10p")
ASSAY = [f"{c}_{m}" for c in CONDITIONS for m in METRICS]
ASSAY_SIGNIFICANCE = [f"{c}_signed_log10p" for c in CONDITIONS]
ASSAY_EFFECT = [f"{c}_{m}" for c in CONDITIONS for m in ("coef_beta", "se_beta")]
CONSTRAINT = ["lof_oe_ci_upper", "mis_z_score"]
RESPONSIVE_AT = 1.0


@dataclass(frozen=True)
class RunConfig:
    """Every switch that changes a modelling decision.

    Fixed values: names and defaults are those of the published runs.
    """

    use_gwas: bool = True
    label_set: Literal["immune", "all"] = "immune"
    assay_na_mode: Literal["impute0_indicator", "native"] = "impute0_indicator"
    polarization_impute: Literal["zero", "median"] = "zero"
    drop_coef_se: bool = False
    use_druggability: bool = False
    n_bags: int = 100
    n_folds: int = 5
    top_k_list: tuple[int, ...] = (50, 100, 200, 500)
    seed: int = 1234
    top_n_report: int = 50
    learner: Literal["linear", "trees"] = "linear"
    n_estimators: int = 200
    max_depth: int = 5
    learning_rate: float = 0.05
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    min_rows_per_leaf: int = 50
    n_bins: int = 64

    def having(self, **changes) -> "RunConfig":
        return replace(self, **changes)


def typed_entities(df: DataFrame) -> DataFrame:
    """Numeric reading of an all-text entity table; the two complete columns get 0."""
    numeric = [c for c in (*CONSTRAINT, *ASSAY, "polarization_score") if c in df.columns]
    return df.withColumns(
        {c: number(c) for c in numeric}
        | {
            "gwas_score": F.coalesce(number("gwas_score"), F.lit(0.0)),
            "iei": F.coalesce(number("iei"), F.lit(0.0)).cast("int"),
        }
    )


def label_expressions(approved: str = "label_all") -> dict[str, Column]:
    evidence = (F.col("gwas_score") > 0) | (F.col("iei") == 1)
    return {
        "gwas_present": flag(F.col("gwas_score") != 0),
        "label_immune": flag((F.col(approved) == 1) & evidence),
    }


def with_labels(df: DataFrame, targets: DataFrame, key: str = "gene", target_key: str = "gene") -> DataFrame:
    """``label_all``: approved target. ``label_immune``: approved with independent evidence."""
    return flag_members(df, key, targets, target_key, "label_all").withColumns(label_expressions())


def label_summary(df: DataFrame, targets: DataFrame, key: str = "gene", target_key: str = "gene") -> DataFrame:
    """Size of the target list, how many are in the table, and positives per label set."""
    listed = targets.select(target_key).distinct()
    here = df.agg(
        F.count(F.lit(1)).alias("n_genes"),
        F.sum("label_all").cast("bigint").alias("positives_all"),
        F.sum("label_immune").cast("bigint").alias("positives_immune"),
    )
    return here.withColumn("n_targets", listed.agg(F.count(target_key)).scalar()).withColumn(
        "n_targets_missing", F.col("n_targets") - F.col("positives_all")
    )


def presence_expressions() -> dict[str, Column]:
    return {
        "gwas_present": flag(F.col("gwas_score") != 0),
        "perturbseq_measured": flag(F.coalesce(*[F.col(c) for c in ASSAY]).isNotNull()),
        "polarization_measured": flag(F.col("polarization_score").isNotNull()),
    }


def feature_groups(cfg: RunConfig) -> dict[str, list[str]]:
    """Ordered feature names per group; the unit of ablation."""
    assay = [c for c in ASSAY if not (cfg.drop_coef_se and c in ASSAY_EFFECT)]
    groups = {
        "genetics": ["gwas_score", "gwas_present"] if cfg.use_gwas else [],
        "prior_immune": ["iei"],
        "constraint": list(CONSTRAINT),
        "perturbseq": assay + (["perturbseq_measured"] if cfg.assay_na_mode == "impute0_indicator" else []),
        "perturbseq_derived": [
            "max_abs_signed_log10p", "dyn_signed_log10p_48_rest", "dyn_coef_48_rest", "responsive_any",
        ],
        "polarization": ["polarization_score", "polarization_measured"],
    }
    if cfg.use_druggability:
        groups["family_druggability"] = ["gene_family_size", "in_hgnc_group"]
    return groups


def feature_columns(cfg: RunConfig) -> list[str]:
    """Distinct feature names in group order."""
    return list(dict.fromkeys(c for cols in feature_groups(cfg).values() for c in cols))


def feature_expressions(cfg: RunConfig, polarization_fill: Column | float = 0.0) -> dict[str, Column]:
    """One expression per feature.

    Zero-filled scores are real values. The assay block is filled with 0 and flagged, or
    left missing (``native``). Constraint stays missing. Polarization gets a fill and a
    flag. ``responsive_any`` is 0, not missing, for unmeasured rows in both modes.
    """
    present = presence_expressions()
    fill = cfg.assay_na_mode == "impute0_indicator"

    def assay(x: Column) -> Column:
        return F.coalesce(x, F.lit(0.0)) if fill else x

    every = {
        "gwas_score": F.col("gwas_score").cast("double"),
        "gwas_present": present["gwas_present"],
        "iei": F.col("iei").cast("int"),
        **{c: F.col(c).cast("double") for c in CONSTRAINT},
        **{c: assay(F.col(c)) for c in ASSAY},
        "perturbseq_measured": present["perturbseq_measured"],
        "max_abs_signed_log10p": assay(max_abs(*ASSAY_SIGNIFICANCE)),
        "dyn_signed_log10p_48_rest": assay(F.col("stim48hr_signed_log10p") - F.col("rest_signed_log10p")),
        "dyn_coef_48_rest": assay(F.col("stim48hr_coef_beta") - F.col("rest_coef_beta")),
        "responsive_any": any_at_least(RESPONSIVE_AT, *ASSAY_SIGNIFICANCE),
        "polarization_score": F.coalesce(
            "polarization_score",
            polarization_fill if isinstance(polarization_fill, Column) else F.lit(float(polarization_fill)),
        ),
        "polarization_measured": present["polarization_measured"],
    }
    if cfg.use_druggability:
        every["gene_family_size"] = F.col("family_size").cast("double")
        every["in_hgnc_group"] = flag(F.col("family").startswith("HGNC:"))
    return {c: every[c] for c in feature_columns(cfg)}


def with_family_size(df: DataFrame, family: str = "family") -> DataFrame:
    """Row count of each row's family, by aggregation and join (no per-family window)."""
    sizes = df.groupBy(family).agg(F.count(F.lit(1)).alias("family_size"))
    return df.join(sizes, family, "left")


def polarization_fill(df: DataFrame, cfg: RunConfig) -> Column:
    """0, or the median of the measured scores as a one-row scalar."""
    if cfg.polarization_impute == "zero":
        return F.lit(0.0)
    return F.coalesce(quantiles(df, "polarization_score", {"median": 0.5}).scalar(), F.lit(0.0))


def feature_table(df: DataFrame, cfg: RunConfig, keep: list[str]) -> DataFrame:
    """Key columns plus the feature columns; rows are never dropped."""
    if cfg.use_druggability and "family_size" not in df.columns:
        df = with_family_size(df)
    exprs = feature_expressions(cfg, polarization_fill(df, cfg))
    return df.select(*keep, *[e.alias(c) for c, e in exprs.items()])
