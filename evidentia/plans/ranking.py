"""The ranking run: folds, bagged out-of-fold scores, metrics, ablations, nominations.

All variants of an ablation go through one set of jobs: ``variant`` is a column, the
draws are shared by variants with the same labels, and each pass over the training
rows serves every model of every variant.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.attribution import explain, linear_attribution
from evidentia.operators.bagging import LinearModels, Plan, fit_linear, score_linear, with_membership
from evidentia.operators.boosting import Forest, TreeSettings, fit_forests, forest_attribution, score_forests
from evidentia.operators.features import (
    RunConfig, feature_columns, feature_expressions, polarization_fill, presence_expressions, with_family_size,
)
from evidentia.operators.folds import with_balanced_folds
from evidentia.operators.metrics import at_top, average_precision, tidy
from evidentia.operators.ordering import partition_count, row_rank, top_rows
from evidentia.session import checkpoint_root

LABEL = {"immune": "label_immune", "all": "label_all"}


def ablation_configs(base: RunConfig) -> dict[str, RunConfig]:
    """The eight compared settings (several coincide under default switches)."""
    return {
        "label_immune": base.having(label_set="immune"),
        "label_all": base.having(label_set="all"),
        "gwas_in": base.having(use_gwas=True),
        "gwas_out": base.having(use_gwas=False),
        "assay_zero_filled": base.having(assay_na_mode="impute0_indicator"),
        "assay_missing": base.having(assay_na_mode="native"),
        "druggability_out": base.having(use_druggability=False),
        "druggability_in": base.having(use_druggability=True),
    }


def _prepared(df: DataFrame, configs: Mapping[int, RunConfig], key: str, crossed: bool) -> DataFrame:
    """Rows with fold and draw columns per label set.

    The rows are written down before folds are dealt, which reads them several times, and again with
    their folds and, per label set, with the hashes that may be drawn; the draw column is an expression on
    these that only tables with draws evaluate.
    """
    checkpoint_root(df.sparkSession)
    parts = partition_count(df)
    out = df.checkpoint() if crossed else df
    sets = {c.label_set: c for c in configs.values()}
    for name, cfg in sets.items():
        label = LABEL[name]
        if crossed:
            out = with_balanced_folds(out, "family", label, cfg.n_folds, cfg.seed, f"fold_{name}")
        else:
            out = out.withColumn(f"fold_{name}", F.lit(-2))
    # Joins on family leave a hot family in one partition; the unique key spreads it.
    out = out.repartition(parts, key).checkpoint()
    for name, cfg in sets.items():
        fold = f"fold_{name}" if crossed else None
        out = with_membership(out, key, LABEL[name], fold, _plan(cfg, crossed), f"bags_{name}")
    return out


def _plan(cfg: RunConfig, crossed: bool) -> Plan:
    return Plan(cfg.n_bags, cfg.n_folds if crossed else None, cfg.seed)


def _long(
    df: DataFrame, configs: Mapping[int, RunConfig], key: str, keep: Sequence[str], flagged: bool, drawn: bool = True
) -> tuple[DataFrame, dict[int, list[int]]]:
    """(variant, id, y, fold, bags, bags_times, x): one row per entity and variant, and the flagged features.

    With ``flagged``, ``x`` holds 0 for a missing value and, behind the features, a flag for every
    feature that can be missing; otherwise missing values stay null. Without ``drawn`` the bags are empty.
    """
    none = F.array().cast("array<int>")
    if any(c.use_druggability for c in configs.values()):
        df = with_family_size(df)
    raw = {v: feature_expressions(c, polarization_fill(df, c)) for v, c in configs.items()}
    missing, entries = {}, []
    for v, c in configs.items():
        values = [e.cast("double") for e in raw[v].values()]
        nullable = [f.nullable for f in df.select(*[e.alias(f) for f, e in raw[v].items()]).schema.fields]
        missing[v] = [j for j, can in enumerate(nullable) if can and flagged]
        if flagged:
            flags = [F.when(values[j].isNull(), 1.0).otherwise(0.0) for j in missing[v]]
            values = [F.coalesce(e, F.lit(0.0)) for e in values] + flags
        entries.append(F.struct(
            F.lit(v).alias("variant"), F.col(LABEL[c.label_set]).cast("int").alias("y"),
            F.col(f"fold_{c.label_set}").alias("fold"), (F.col(f"bags_{c.label_set}") if drawn else none).alias("bags"),
            (F.col(f"bags_{c.label_set}_times") if drawn else none).alias("bags_times"), F.array(*values).alias("x"),
        ))
    return df.select(F.col(key).alias("id"), *keep, F.inline(F.array(*entries))), missing


def _fit(long: DataFrame, configs: Mapping[int, RunConfig], crossed: bool, missing: Mapping[int, list[int]]) -> dict[int, LinearModels]:
    train = long.select("id", "variant", "y", "fold", "bags", "bags_times", "x").filter((F.col("y") == 1) | (F.size("bags") > 0))
    train = train.repartition(partition_count(long), "id").drop("id")  # even work for the passes to come
    features = {v: feature_columns(c) for v, c in configs.items()}
    plan = _plan(next(iter(configs.values())), crossed)
    return fit_linear(train.checkpoint(), features, plan, missing)


def _settings(cfg: RunConfig) -> TreeSettings:
    return TreeSettings(
        cfg.n_estimators, cfg.max_depth, cfg.learning_rate, cfg.subsample, cfg.colsample_bytree, cfg.min_rows_per_leaf, cfg.n_bins, cfg.seed
    )


def _fit_forests(long: DataFrame, configs: Mapping[int, RunConfig], crossed: bool) -> dict[int, Forest]:
    """Forests of all variants with equal tree settings, fitted together."""
    train = long.select("id", "variant", "y", "fold", "bags", "bags_times", "x").filter((F.col("y") == 1) | (F.size("bags") > 0))
    train = train.repartition(partition_count(long), "id").checkpoint()
    out: dict[int, Forest] = {}
    for settings in {_settings(c) for c in configs.values()}:
        mine = {v: c for v, c in configs.items() if _settings(c) == settings}
        plan = _plan(next(iter(mine.values())), crossed)
        out |= fit_forests(train.where(F.col("variant").isin(*mine)), {v: feature_columns(c) for v, c in mine.items()}, plan, settings)
    return out


def _numbered(configs: Mapping[str, RunConfig]) -> dict[RunConfig, int]:
    """Settings that coincide have one number."""
    unique: dict[RunConfig, int] = {}
    for cfg in configs.values():
        unique.setdefault(cfg, len(unique))
    return unique


def _named(df: DataFrame, configs: Mapping[str, RunConfig], *columns: str) -> DataFrame:
    """Rows of a numbered setting under each of its names."""
    unique = _numbered(configs)
    names = F.array(*[
        F.struct(F.lit(unique[c]).alias("v"), F.lit(n).alias("name")) for n, c in configs.items()
    ])
    # The names of a setting are a short literal list, so no join is needed.
    named = df.withColumn("n", F.explode(F.filter(names, lambda e: e["v"] == F.col("variant"))))
    return named.select(F.col("n.name").alias("variant"), *columns)


def out_of_fold(df: DataFrame, configs: Mapping[str, RunConfig], key: str = "gene") -> DataFrame:
    """(variant, id, y, score) of every row under grouped cross-validation.

    Settings that coincide are fitted once and reported under each name.
    """
    return _named(_held_out_scores(df, configs, key), configs, "id", "y", "score")


def _held_out_scores(df: DataFrame, configs: Mapping[str, RunConfig], key: str) -> DataFrame:
    """(id, variant, y, score) under grouped cross-validation, by number of the setting."""
    unique = _numbered(configs)
    by_number = {v: c for c, v in unique.items()}
    prepared = _prepared(df, by_number, key, crossed=True)
    parts = []
    linear = {v: c for v, c in by_number.items() if c.learner == "linear"}
    if linear:
        long, missing = _long(prepared, linear, key, [], True)
        held_out, _ = _long(prepared, linear, key, [], True, drawn=False)  # scored by fold alone
        scored = score_linear(held_out, _fit(long, linear, True, missing))
        parts.append(scored.select("id", "variant", "y", "score"))
    trees = {v: c for v, c in by_number.items() if c.learner == "trees"}
    if trees:
        long, _ = _long(prepared, trees, key, [], False)
        held_out, _ = _long(prepared, trees, key, [], False, drawn=False)
        scored = score_forests(held_out, _fit_forests(long, trees, True))
        parts.append(scored.select("id", "variant", "y", "score"))
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    return scores


def ablation(df: DataFrame, configs: Mapping[str, RunConfig], key: str = "gene") -> DataFrame:
    """Tidy metrics (variant, k, metric, value) of every setting."""
    scored = _held_out_scores(df, configs, key).checkpoint()
    ks = next(iter(configs.values())).top_k_list
    found = tidy(
        at_top(scored, "score", "y", "id", ks, ["variant"]),
        average_precision(scored, "score", "y", ["variant"]), ["variant"],
    )
    return _named(found, configs, "k", "metric", "value")


@dataclass
class FullRun:
    """Final run on all rows: every row with its score, and the models behind it."""

    scored: DataFrame
    models: LinearModels | Forest  # all bags


def full_run(df: DataFrame, cfg: RunConfig, key: str = "gene") -> FullRun:
    """Bagging without folds; unlabeled rows are scored out of bag."""
    configs = {0: cfg}
    prepared = _prepared(df, configs, key, crossed=False)
    long, missing = _long(prepared, configs, key, df.columns, cfg.learner == "linear")
    if cfg.learner == "trees":
        forests = _fit_forests(long, configs, False)
        return FullRun(score_forests(long, forests), forests[0])
    models = _fit(long, configs, False, missing)
    return FullRun(score_linear(long, models), models[0])


def nominations(run: FullRun, cfg: RunConfig, key: str = "gene", extra: Sequence[str] = ()) -> DataFrame:
    """Every row with rank, score, labels, family, presence flags and model count.

    The table is written down before it is ranked, so scoring runs once.
    """
    present = presence_expressions()
    status = F.when(F.col(LABEL[cfg.label_set]) == 1, "positive").otherwise("unlabeled")
    table = run.scored.withColumns(present).select(
        key, *extra, F.col("score").alias("pu_score"), "label_all", "label_immune", status.alias("label_status"),
        "family", *present, "oob_models",
    )
    return row_rank(table.checkpoint(), [("pu_score", "desc"), (key, "asc")])


def explained(nominated: DataFrame, run: FullRun, cfg: RunConfig, key: str = "gene") -> DataFrame:
    """Attribution, driver tag and leading features of the top unlabeled rows."""
    top = top_rows(nominated.filter(F.col("label_status") == "unlabeled"), [("rank", "asc")], cfg.top_n_report)
    rows = run.scored.select(key, "x").join(
        F.broadcast(top.select(key, "rank", "pu_score", "gwas_present", "perturbseq_measured")), key  # top_n_report rows
    )
    keep = ["rank", key, "pu_score", "gwas_present", "perturbseq_measured"]
    if isinstance(run.models, LinearModels):
        told = linear_attribution(rows, run.models, keep)
    else:
        told = forest_attribution(rows, run.models, keep, key)
    told = explain(told)
    return told.select(
        "rank", key, F.round("pu_score", 6).alias("pu_score"), "driver", "top_features", "gwas_present", "perturbseq_measured"
    )
