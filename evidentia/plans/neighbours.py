"""Nearest approved target per perturbation signature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.joins import flag_members, look_up
from evidentia.operators.components import Components
from evidentia.operators.nearest import nearest_anchor, principal_components, signatures, usable_rows
from evidentia.operators.symbols import canonical


def condition_signatures(rows: DataFrame, columns: DataFrame, condition: str, min_cells: int = 50) -> DataFrame:
    """Quality-filtered, de-duplicated, self-masked unit signatures of one condition."""
    good = usable_rows(
        rows, F.col("culture_condition") == condition, F.col("ontarget_significant"), F.col("n_cells_target"), min_cells
    )
    own = columns.groupBy(F.col("gene_name").alias("__g")).agg(F.max("col_id").alias("__own"))
    placed = look_up(good, "target_contrast_gene_name", own, "__g", "__own", "own_col")
    return signatures(placed, "target_contrast_gene_name", "values", "row_id", "own_col")


def candidates(rows: DataFrame, columns: DataFrame, anchors: DataFrame, index: DataFrame, condition: str,
               min_cells: int = 50) -> DataFrame:
    """Best cosine to an approved target and its name, raw and harmonised.

    Membership and the nearest name are judged on the harmonised symbol; the raw
    spelling is kept beside it.
    """
    sig = condition_signatures(rows, columns, condition, min_cells)
    named = canonical(sig, index, "target_contrast_gene_name", "gene_current")
    flagged = flag_members(named, "gene_current", anchors, "gene", "is_fda_target")
    scored = nearest_anchor(flagged, "target_contrast_gene_name", "is_fda_target", "row_id")
    both = canonical(scored, index, "nearest", "nearest_current")
    return both.select(
        F.col("target_contrast_gene_name").alias("gene"), F.col("best").alias("knn_max_score"),
        F.col("nearest").alias("nearest_fda_target"), F.col("nearest_current").alias("nearest_fda_target_current"),
        "is_fda_target", F.col("breadth").alias("n_downstream_z3"), F.lit(condition).alias("culture_condition"),
    )


def signature_components(rows: DataFrame, columns: DataFrame, found: DataFrame, condition: str, k: int = 50,
                         min_cells: int = 50) -> tuple[DataFrame, Components]:
    """Components of one condition's unit signatures, labelled from the table of ``candidates``.

    The signatures are those the search uses, so each has its row there.
    """
    sig = condition_signatures(rows, columns, condition, min_cells).withColumnRenamed("target_contrast_gene_name", "gene")
    labelled = sig.select("gene", "unit").join(found.select("gene", "is_fda_target", "nearest_fda_target"), "gene", "left")
    return principal_components(labelled, "gene", k, ["is_fda_target", "nearest_fda_target"])
