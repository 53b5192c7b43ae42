"""Additive attribution of bag scores, driver tags and feature strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.bagging import LinearModels

# Which features count as genetic and assay evidence, and as family proxy.
EVIDENCE_PREFIXES = (
    "gwas", "iei", "max_abs_signed_log10p", "dyn_", "responsive_any",
    "rest_", "stim8hr_", "stim48hr_", "perturbseq_measured",
)
FAMILY_FEATURES = ("gene_family_size", "in_hgnc_group")
FAMILY_TAG, EVIDENCE_TAG, MIXED_TAG, WEAK_TAG = (
    "family/druggability-driven", "genetics+perturbseq-driven", "mixed", "weak/mixed",
)


def linear_attribution(rows: DataFrame, models: LinearModels, keep: Sequence[str], x: str = "x") -> DataFrame:
    """Mean over bags of ``coef * (x - training mean)`` per feature (log-odds scale).

    The bag average is itself linear in x and in the flags of missing values, so two short
    vectors give it exactly.
    """
    slope = models.slopes().mean(0)
    offset = (models.coef * models.mean).mean(0)
    flag_of = {j: len(models.features) + k for k, j in enumerate(models.missing)}

    def term(i: int) -> Column:
        held = F.get(x, F.lit(i)) * F.lit(float(slope[i])) - F.lit(float(offset[i]))
        return held + F.get(x, F.lit(flag_of[i])) * F.lit(float(slope[flag_of[i]])) if i in flag_of else held

    terms = [F.struct(F.lit(f).alias("feature"), term(i).alias("value")) for i, f in enumerate(models.features)]
    return rows.select(*keep, F.array(*terms).alias("contributions"))


def _mass(contributions: Column, wanted) -> Column:
    return F.aggregate(
        contributions, F.lit(0.0),
        lambda acc, c: acc + F.when(wanted(c["feature"]) & (c["value"] > 0), c["value"]).otherwise(0.0),
    )


def _any_prefix(name: Column) -> Column:
    cond = F.lit(False)
    for p in EVIDENCE_PREFIXES:
        cond = cond | name.startswith(p)
    return cond


def driver_tag(contributions: Column | str) -> Column:
    """What drives a score, from the share of positive contribution per group."""
    c = F.col(contributions) if isinstance(contributions, str) else contributions
    total = _mass(c, lambda f: F.lit(True))
    evidence = _mass(c, _any_prefix) / total
    family = _mass(c, lambda f: f.isin(*FAMILY_FEATURES)) / total
    return (
        F.when(total <= 0, WEAK_TAG).when(family > 0.5, FAMILY_TAG)
        .when(evidence >= 0.5, EVIDENCE_TAG).otherwise(MIXED_TAG)
    )


def top_features(contributions: Column | str, k: int = 3) -> Column:
    """``name+0.123; name-0.045`` for the k largest contributions by magnitude."""
    c = F.col(contributions) if isinstance(contributions, str) else contributions
    keyed = F.transform(c, lambda e, i: F.struct((-F.abs(e["value"])).alias("m"), i.alias("i"), e["feature"].alias("f"), e["value"].alias("v")))
    best = F.slice(F.array_sort(keyed), 1, k)
    text = F.transform(
        best,
        lambda e: F.concat(e["f"], F.when(e["v"] >= 0, "+").otherwise("-"), F.format_string("%.3f", F.abs(e["v"]))),
    )
    return F.array_join(text, "; ")


def explain(attributed: DataFrame) -> DataFrame:
    return attributed.withColumns({"driver": driver_tag("contributions"), "top_features": top_features("contributions")})
