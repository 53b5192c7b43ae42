"""Regulator burden: covariates, per-condition regression scan, wide reshape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import clip
from evidentia.operators.dedup import keep_first
from evidentia.operators.grouping import finite_bounds, pivot_once
from evidentia.operators.joins import keyed_values, look_up, only_members
from evidentia.operators.ordering import top_rows
from evidentia.operators.regression import MIN_ROWS, scan_matrix, with_p_values
from evidentia.operators.symbols import harmonize

# Condition names with their column prefixes, carried metrics.
CONDITIONS = {"Rest": "rest", "Stim8hr": "stim8hr", "Stim48hr": "stim48hr"}
METRICS = ["coef_beta", "se_beta", "signed_log10p"]


def clipped_first(df: DataFrame, key: str, value: str, row_id: str) -> DataFrame:
    """First value per key; infinities move to the finite extremes of what was kept."""
    firsts = keep_first(df.select(key, value, row_id), [key], row_id)
    bounded = firsts.withColumn("__b", finite_bounds(firsts, value))
    moved = F.when(F.isnan(value), F.lit(None)).otherwise(clip(value, F.col("__b.lo"), F.col("__b.hi")))
    return bounded.select(key, moved.cast("double").alias(value))


def scan_inputs(
    rows: DataFrame, columns: DataFrame, gamma: DataFrame, shet: DataFrame, gene_map: DataFrame
) -> DataFrame:
    """Matrix rows with covariates and the positions of their own columns.

    The symbol of a perturbed entity maps to its id (the last mapping wins, the symbol
    itself if unknown); covariates and all columns of that id follow by it.
    """
    ids = keyed_values(gene_map, "symbol", "ensg", "row_id", wins="last")
    named = look_up(rows, "target_contrast_gene_name", ids, "symbol", "ensg", "entity",
                    default=F.col("target_contrast_gene_name"))
    y = clipped_first(gamma, "ensg", "post_mean", "row_id")
    w = keep_first(shet.select("ensg", "shet", "row_id"), ["ensg"], "row_id")
    full = look_up(named, "entity", y, "ensg", "post_mean", "y")
    full = look_up(full, "entity", w, "ensg", "shet", "w")
    own = columns.groupBy(F.col("gene_ids").alias("__id")).agg(F.collect_set("col_id").alias("__own"))  # at most all columns
    full = look_up(full, "entity", own, "__id", "__own", "own_cols")
    return full.select(F.col("culture_condition").alias("condition"), "entity", "values", "own_cols", "y", "w")


def score(inputs: DataFrame, columns: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Scored (condition, column) tests with p, signed -log10 p, FDR and rank."""
    fits = scan_matrix(inputs, min_rows)
    dim = columns.select("col_id", F.col("gene_ids").alias("ensg"), F.col("gene_name").alias("gene"))
    tested = with_p_values(fits.join(dim, "col_id"), ["condition"])
    return tested.select(
        "ensg", "gene", "n_reg", "coef_beta", "se_beta", "p_beta", "signed_log10p", "fdr", "condition", "rank"
    )


def score_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("fdr") < 0.05).alias("n_fdr"),
        F.count_if(F.col("p_beta") < 0.05).alias("n_p05"),
    )


def wide(scores: DataFrame, index: DataFrame) -> DataFrame:
    """One row per gene with every condition's metrics, symbols harmonised."""
    flat = pivot_once(scores, "gene", "condition", list(CONDITIONS), METRICS, CONDITIONS)
    return harmonize(flat, index, "gene")[0]


def table(
    rows: DataFrame, columns: DataFrame, gamma: DataFrame, shet: DataFrame, gene_map: DataFrame, index: DataFrame, min_rows: int = MIN_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Scored tests of all conditions and the wide table, from the raw inputs."""
    scores = score(scan_inputs(rows, columns, gamma, shet, gene_map), columns, min_rows)
    return scores, wide(scores, index)


def list_overlap(scores: DataFrame, condition: str, reference: DataFrame, ends: Sequence[str] = ("positive", "negative"),
                 k: int = 50) -> DataFrame:
    """How many of the k strongest genes at either end a reference list holds.

    ``reference`` holds ``gene, direction``.
    """
    mine = scores.filter((F.col("condition") == condition) & F.col("signed_log10p").isNotNull())
    out = None
    for direction in ends:
        way = "desc" if direction == "positive" else "asc"
        best = top_rows(mine, [("signed_log10p", way), ("ensg", "asc")], k)
        named = reference.filter(F.col("direction") == direction)
        hits = only_members(best, "gene", named, "gene").agg(F.count(F.lit(1)).alias("overlap"))
        line = hits.select(F.lit(direction).alias("direction"), "overlap")
        out = line if out is None else out.unionByName(line)
    return out
