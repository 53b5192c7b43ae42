"""Drug programs: nested pages to flat facts, filters, grouped lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import joined_distinct
from evidentia.operators.grouping import collapse
from evidentia.operators.joins import flag_members, look_up, place_after

# The disease branch, its name, the approved stage.
PARENT_ID = "MONDO_0005046"
BROAD_CATEGORY = "immune system disorder"
APPROVED_STAGE = "APPROVAL"


def flatten_targets(pages: DataFrame, descendants: DataFrame, parent: str = PARENT_ID,
                    category: str = BROAD_CATEGORY) -> DataFrame:
    """Distinct target x drug x indication rows; a candidate without indication keeps one row."""
    candidates = pages.select(
        F.col("target.approvedSymbol").alias("target"),
        F.explode("target.drugAndClinicalCandidates.rows").alias("c"),
    )
    flat = candidates.select(
        "target",
        F.col("c.drug.name").alias("drug_name"),
        joined_distinct(F.col("c.drug.mechanismsOfAction.rows.mechanismOfAction")).alias("action"),
        joined_distinct(F.col("c.drug.mechanismsOfAction.rows.actionType")).alias("action_type"),
        F.col("c.maxClinicalStage").alias("max_clinical_stage"),
        F.col("c.diseases").alias("diseases"),
    )
    # The joined texts are made once per candidate, before indications multiply the rows.
    flat = flat.withColumn("d", F.explode_outer("diseases")).select(
        "target", "drug_name", "action", "action_type",
        F.coalesce(F.nullif("d.disease.name", F.lit("")), "d.diseaseFromSource", F.lit("")).alias("specific_disease"),
        F.coalesce("d.disease.id", F.lit("")).alias("specific_disease_id"),
        F.lit(category).alias("broad_category"), "max_clinical_stage",
    )
    branch = descendants.select(F.col(descendants.columns[0]).alias("id"))
    spark = pages.sparkSession
    branch = branch.unionByName(spark.range(1).select(F.lit(parent).alias("id")))
    # Duplicates go first, so the join sees each fact once.
    return flag_members(flat.dropDuplicates(), "specific_disease_id", branch, "id", "immune_indication")


def immune_only(flat: DataFrame) -> DataFrame:
    return flat.filter(F.col("immune_indication") == 1)


def approved_only(flat: DataFrame) -> DataFrame:
    return flat.filter(F.col("max_clinical_stage") == APPROVED_STAGE)


def filter_counts(flat: DataFrame) -> DataFrame:
    """Total, kept and distinct-drug counters of both filters in one pass over drugs."""
    per_drug = flat.groupBy("drug_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("immune_indication") == 1).alias("immune"),
        F.count_if(F.col("max_clinical_stage") == APPROVED_STAGE).alias("approved"),
    )
    return per_drug.agg(
        F.sum("n").alias("total"), F.sum("immune").alias("kept_immune"), F.sum("approved").alias("kept_approved"),
        F.count_if(F.col("immune") > 0).alias("drugs_immune"),
    )


def grouped_programs(flat: DataFrame) -> DataFrame:
    """One row per (target, action type) with lists and counts."""
    return collapse(
        flat, ["target", "action_type"], lists=["action", "drug_name", "specific_disease"],
        counts={"num_drugs": "drug_name", "num_diseases": "specific_disease"},
        constants=["broad_category", "max_clinical_stage", "immune_indication"],
    )


def approved_pairs(flat: DataFrame) -> DataFrame:
    """Distinct approved (target, drug) pairs."""
    return approved_only(flat).select("target", "drug_name", "max_clinical_stage").distinct()


def with_anchor_drugs(candidates: DataFrame, approved: DataFrame, anchor: str, name: str = "fda_drugs_targeting_nearest_gene") -> DataFrame:
    """Attach the approved drug names of each row's nearest anchor, right behind it."""
    listed = collapse(approved_only(approved), ["target"], lists=["drug_name"])
    base = candidates.drop(name)
    looked = look_up(base, anchor, listed, "target", "drug_name", name, default=F.lit(""))
    return place_after(looked, name, anchor)
