"""The master entity table: filter, deduplicate, harmonise, flag, attach scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import has_prefix, is_named, not_in
from evidentia.operators.dedup import drop_all_copies, duplicated_keys
from evidentia.operators.joins import Source, attach_sources, attach_zero_filled, flag_members
from evidentia.operators.ordering import row_rank
from evidentia.operators.symbols import canonical, harmonize, rename_counts

# Accepted id prefix, excluded chromosomes, kept columns, score datasource.
ID_PREFIX = "ENSG"
SEX_CHROMOSOMES = ("chrX", "chrY", "X", "Y")
KEPT = ["gene", "gene_id", "lof_oe_ci_upper", "mis_z_score", "iei"]
DATASOURCE = "gwas_credible_sets"


def row_filters() -> dict:
    return {
        "ensg": has_prefix("gene_id", ID_PREFIX),
        "autosomal": not_in("chromosome", SEX_CHROMOSOMES),
        "named": is_named("gene"),
    }


def build(
    constraint: DataFrame, index: DataFrame, panel: DataFrame, sources: Sequence[Source], panel_key: str = "gene",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns the table, the match counts per source and the row audit per step."""
    masks = row_filters()
    kept = constraint.filter(masks["ensg"] & masks["autosomal"] & masks["named"])
    unique = drop_all_copies(kept, ["gene"])
    renamed, changes = harmonize(unique, index, "gene")
    flagged = flag_members(renamed, "gene", panel, panel_key, "iei").select(*KEPT)
    current = [s._replace(df=harmonize(s.df, index, "gene")[0]) for s in sources]
    table, matched = attach_sources(flagged, current, "gene")

    steps = constraint.agg(
        F.count(F.lit(1)).alias("input"),
        *[F.count_if(m).alias(f"keep_{n}") for n, m in masks.items()],
        F.count_if(masks["ensg"] & masks["autosomal"] & masks["named"]).alias("kept"),
    )
    copies = duplicated_keys(kept, ["gene"]).agg(
        F.count(F.lit(1)).alias("duplicated_symbols"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("duplicated_rows")
    )
    audit = steps.withColumns(
        {
            "dup": copies.select(F.struct("*").alias("s")).scalar(),
            "ren": rename_counts(changes).select(F.struct("renamed", "dropped").alias("s")).scalar(),
        }
    ).select(
        "input", "keep_ensg", "keep_autosomal", "keep_named", "kept", "dup.*", "ren.*",
    )
    # Symbols are unique before renaming, so dropped names equal dropped rows.
    audit = audit.withColumn("final", F.col("kept") - F.col("duplicated_rows") - F.col("dropped"))
    return table, matched, audit


def association_scores(pages: DataFrame, index: DataFrame, datasource: str = DATASOURCE) -> DataFrame:
    """Nested score pages to a ranked table: rank, gene, ensembl_id, gwas_score."""
    score = F.get(F.filter("datasourceScores", lambda d: d["id"] == datasource), F.lit(0))["score"]
    flat = pages.select(
        F.col("target.approvedSymbol").alias("gene"), F.col("target.id").alias("ensembl_id"), score.alias("gwas_score")
    )
    current, _ = harmonize(flat, index, "gene")
    ranked = row_rank(current, [("gwas_score", "desc"), ("gene", "asc")])
    return ranked.select("rank", "gene", "ensembl_id", "gwas_score")


def zero_filled_scores(universe: DataFrame, scores: DataFrame, index: DataFrame) -> DataFrame:
    """Every named entity of the universe with its score, 0 where there is none."""
    named = universe.filter(is_named("gene")).select("gene").distinct()
    current, _ = harmonize(named, index, "gene")
    return attach_zero_filled(current, scores, "gene", "gwas_score")


def anchor_set(symbols: DataFrame, index: DataFrame) -> DataFrame:
    return canonical(symbols, index, "gene").distinct()
