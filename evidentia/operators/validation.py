"""Top nominations against seeded controls, using the clinical stage of known drugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import stage_label, stage_number
from evidentia.operators.contingency import exact_p
from evidentia.operators.ordering import seeded_sample, top_rows

# Fixed values of the validation design.
N_TOP, N_CONTROL, CONTROL_RANK_MIN, SEED = 25, 50, 200, 1234
IMMUNE_AREA = "immune system disorder"


def top_and_controls(
    nominations: DataFrame, label: str = "label_immune", rank: str = "rank", key: str = "gene",
    n_top: int = N_TOP, n_control: int = N_CONTROL, rank_min: int = CONTROL_RANK_MIN, seed: object = SEED,
) -> DataFrame:
    """The first n unlabeled nominations and a seeded sample from beyond ``rank_min``."""
    free = nominations.filter(F.col(label) == 0)
    top = top_rows(free, [(rank, "asc"), (key, "asc")], n_top).withColumn("arm", F.lit("top"))
    pool = free.filter(F.col(rank) > rank_min)
    return top.unionByName(seeded_sample(pool, key, n_control, seed).withColumn("arm", F.lit("control")))


def flat_programs(pages: DataFrame) -> DataFrame:
    """Target pages to one row per candidate: stage, drug, first disease, area names.

    ``pages``: ``approvedSymbol`` and ``drugAndClinicalCandidates`` (count, rows).
    """
    known = pages.select(
        F.col("approvedSymbol").alias("gene"),
        F.col("drugAndClinicalCandidates.count").alias("n_known_drugs"),
        F.posexplode_outer("drugAndClinicalCandidates.rows").alias("pos", "r"),
    )
    diseases = F.coalesce(F.col("r.diseases"), F.array().cast("array<struct<disease:struct<id:string,name:string,therapeuticAreas:array<struct<id:string,name:string>>>>>"))
    names = F.filter(F.transform(diseases, lambda d: d["disease"]["name"]), lambda n: n.isNotNull() & (n != ""))
    areas = F.flatten(F.transform(
        diseases,
        lambda d: F.transform(
            F.coalesce(d["disease"]["therapeuticAreas"], F.array().cast("array<struct<id:string,name:string>>")),
            lambda t: t["name"],
        ),
    ))
    return known.select(
        "gene", F.coalesce("n_known_drugs", F.lit(0)).alias("n_known_drugs"), "pos",
        F.col("r.maxClinicalStage").alias("stage"), F.col("r.drug.name").alias("drug"),
        F.get(names, F.lit(0)).alias("disease"), areas.alias("areas"),
    )


def best_programs(programs: DataFrame, group: str, stage: str, drug: str, disease: str, wanted: Column, pos: str) -> DataFrame:
    """Most advanced program per group, overall and among ``wanted`` rows.

    Only a strictly later stage replaces an earlier row, so the first of equals wins; a
    stage outside the scale never does.
    """
    num = stage_number(stage)

    def best(cond: Column):
        ok = cond & (num > -1)
        order = F.struct(num.alias("num"), (-F.col(pos)).alias("at"))
        return F.max_by(
            F.struct(num.alias("num"), stage_label(stage).alias("label"), F.col(drug).alias("drug"), F.col(disease).alias("disease")),
            F.when(ok, order),
        )

    agg = programs.groupBy(group).agg(best(F.lit(True)).alias("b"), best(F.coalesce(wanted, F.lit(False))).alias("w"))
    return agg.select(
        group,
        F.coalesce("b.label", F.lit("")).alias("max_clinical_stage"),
        F.coalesce("b.num", F.lit(-1.0)).alias("max_stage_number"),
        F.coalesce("b.drug", F.lit("")).alias("example_drug"),
        F.coalesce("w.label", F.lit("")).alias("immune_max_stage"),
        F.coalesce("w.num", F.lit(-1.0)).alias("immune_stage_number"),
        F.coalesce("w.drug", F.lit("")).alias("immune_example_drug"),
        F.coalesce("w.disease", F.lit("")).alias("immune_indication"),
    )


def arm_tallies(members: DataFrame, arm: str, hits: list[str], top: str = "top", control: str = "control") -> DataFrame:
    """Per outcome: counts and shares of both arms, and the exact two-sided p.

    ``hits`` are 0/1 columns; the same rule applies to both arms.
    """
    is_top, is_ctrl = F.col(arm) == top, F.col(arm) == control
    aggs = [F.count_if(is_top).alias("top_n"), F.count_if(is_ctrl).alias("ctrl_n")]
    for h in hits:
        aggs += [F.count_if(is_top & (F.col(h) == 1)).alias(f"t_{h}"), F.count_if(is_ctrl & (F.col(h) == 1)).alias(f"c_{h}")]
    counted = members.agg(*aggs)
    lines = F.array(*[
        F.struct(F.lit(h).alias("outcome"), F.col(f"t_{h}").alias("a"), F.col(f"c_{h}").alias("c")) for h in hits
    ])
    cells = counted.select("top_n", "ctrl_n", F.inline(lines))
    cells = cells.withColumns({"b": F.col("top_n") - F.col("a"), "d": F.col("ctrl_n") - F.col("c")})
    tested = exact_p(cells, "two-sided")
    return tested.select(
        "outcome", "top_n", F.col("a").alias("top_hits"), "ctrl_n", F.col("c").alias("ctrl_hits"),
        (100.0 * F.try_divide("a", "top_n")).alias("top_pct"), (100.0 * F.try_divide("c", "ctrl_n")).alias("ctrl_pct"), "p",
    )


def named_rows(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Point lookup of named candidates, in no particular order."""
    return df.filter(F.col(key).isin(*names))
