"""Families, folds, features, bagging, metrics, attribution on a customer entity table."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from evidentia.operators import attribution, bagging, boosting, features, folds, metrics, symbols
from evidentia.operators.joins import attach_checked, place_after
from evidentia.plans import ranking
from evidentia.registry.base import query, shaped, table

# ------------------------------------------------------------- the entity table
#
# Customers stand for entities: account data give constraint, 1998 orders a zero-filled
# score, events (10 % of customers) the assay blocks, frequent large orders the positives.

_ENTITIES = """
fam AS (SELECT substr(c_mktsegment, 1, 1) || c_custkey AS symbol, arg_max(CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment || '.' || (c_nationkey % 7) END, c_custkey) AS grp FROM customer GROUP BY 1),
ord AS (SELECT o_custkey, round(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1998), 2) / 1000000.0::DOUBLE AS gwas,
    CASE WHEN count(*) >= 8 THEN (round(sum(o_totalprice), 2) / count(*) - 250000) / 100000.0::DOUBLE END AS mis,
    count(*) FILTER (WHERE o_totalprice > 400000) AS large FROM orders GROUP BY 1),
ev AS (SELECT user_id, event_type, round(sum(value), 2) / count(*) AS m, count(*) AS n, max(value) AS hi FROM events GROUP BY 1, 2),
wide AS (SELECT user_id, """ + ", ".join(
    f"max(m / 50 - 1) FILTER (WHERE event_type = '{e}') AS {c}_coef_beta, max(hi / n / 97) FILTER (WHERE event_type = '{e}') AS {c}_se_beta, "
    f"max((m - 50) / 10) FILTER (WHERE event_type = '{e}') AS {c}_signed_log10p"
    for e, c in (("click", "rest"), ("view", "stim8hr"), ("error", "stim48hr"))
) + """, (max(m) FILTER (WHERE event_type = 'purchase') - max(m) FILTER (WHERE event_type = 'signup')) / 10 AS polarization_score FROM ev GROUP BY 1),
ent AS (SELECT substr(c_mktsegment, 1, 1) || c_custkey AS gene, 'ENSG' || c_custkey AS gene_id,
    CASE WHEN c_acctbal >= 0 THEN c_acctbal / 10000.0::DOUBLE END AS lof_oe_ci_upper, mis AS mis_z_score,
    CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END AS iei, coalesce(gwas, 0) AS gwas_score, wide.* EXCLUDE (user_id),
    CASE WHEN coalesce(large, 0) >= 4 THEN 1 ELSE 0 END AS label_all,
    CASE WHEN coalesce(large, 0) >= 4 AND (coalesce(gwas, 0) > 0 OR n_regionkey = 2) THEN 1 ELSE 0 END AS label_immune,
    coalesce('HGNC:' || grp, 'PFX:' || upper(substr(substr(c_mktsegment, 1, 1) || c_custkey, 1, 3))) AS family
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN ord ON o_custkey = c_custkey LEFT JOIN wide ON user_id = c_custkey
  LEFT JOIN fam ON symbol = substr(c_mktsegment, 1, 1) || c_custkey)
"""


def _family_groups(spark, sf):
    cust = table(spark, sf, "customer")
    grp = F.when(F.col("c_mktsegment") != "MACHINERY",
                 F.concat(F.lit(" |"), "c_mktsegment", F.lit("."), F.col("c_nationkey") % 7, F.lit("|extra"))).otherwise("")
    return cust.select(F.concat(F.substring("c_mktsegment", 1, 1), "c_custkey").alias("symbol"), grp.alias("gene_group_id"), F.col("c_custkey").alias("row_id"))


def _targets(spark, sf):
    large = table(spark, sf, "orders").filter("o_totalprice > 400000").groupBy("o_custkey").count().filter("count >= 4")
    return large.select(F.col("o_custkey").alias("c_custkey"))


def entities(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    cust = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    in98 = F.when(F.year("o_orderdate") == 1998, F.col("o_totalprice"))
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        (F.round(F.sum(in98), 2) / 1000000.0).alias("gwas"),
        F.when(F.count(F.lit(1)) >= 8, (F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1)) - 250000) / 100000.0).alias("mis_z_score"),
    )
    per = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey"), "event_type").agg(
        (F.round(F.sum("value"), 2) / F.count(F.lit(1))).alias("m"), F.count(F.lit(1)).alias("n"), F.max("value").alias("hi")
    )

    def of(kind, e):
        return F.max(F.when(F.col("event_type") == kind, e))

    assay = []
    for kind, c in (("click", "rest"), ("view", "stim8hr"), ("error", "stim48hr")):
        assay += [of(kind, F.col("m") / 50 - 1).alias(f"{c}_coef_beta"), of(kind, F.col("hi") / F.col("n") / 97).alias(f"{c}_se_beta"),
                  of(kind, (F.col("m") - 50) / 10).alias(f"{c}_signed_log10p")]
    pol = ((of("purchase", F.col("m")) - of("signup", F.col("m"))) / 10).alias("polarization_score")
    wide = per.groupBy("c_custkey").agg(*assay, pol)
    base = cust.join(orders, "c_custkey", "left").join(wide, "c_custkey", "left")
    base = base.select(
        "c_custkey", F.concat(F.substring("c_mktsegment", 1, 1), "c_custkey").alias("gene"), F.concat(F.lit("ENSG"), "c_custkey").alias("gene_id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 10000.0).alias("lof_oe_ci_upper"), "mis_z_score",
        (F.col("n_regionkey") == 2).cast("int").alias("iei"), F.coalesce("gwas", F.lit(0.0)).alias("gwas_score"), *features.ASSAY, "polarization_score",
    )
    labelled = features.with_labels(base, _targets(spark, sf), "c_custkey", "c_custkey").drop("c_custkey", "gwas_present")
    return symbols.family_of(labelled, _family_groups(spark, sf), "gene", row_id="row_id")


_CONFIG = features.RunConfig(n_bags=40, n_folds=5)


@query("WITH " + _ENTITIES + "SELECT gene, family FROM ent")
def family_assign(spark, sf):
    return entities(spark, sf).select("gene", "family")


@query("WITH " + _ENTITIES + """
SELECT CAST(count(*) AS BIGINT) AS n_genes, CAST(sum(label_all) AS BIGINT) AS positives_all, CAST(sum(label_immune) AS BIGINT) AS positives_immune,
  CAST((SELECT count(*) FROM ord WHERE large >= 4) AS BIGINT) AS n_targets,
  CAST((SELECT count(*) FROM ord WHERE large >= 4) - sum(label_all) AS BIGINT) AS n_targets_missing FROM ent
""")
def label_summary(spark, sf):
    return shaped(features.label_summary(entities(spark, sf), _targets(spark, sf), "gene", "c_custkey"))


_FEATURES = {
    "gwas_score": "gwas_score", "gwas_present": "CAST(gwas_score <> 0 AS BIGINT)", "iei": "CAST(iei AS BIGINT)",
    "lof_oe_ci_upper": "lof_oe_ci_upper", "mis_z_score": "mis_z_score",
    **{c: f"coalesce({c}, 0)" for c in features.ASSAY},
    "perturbseq_measured": "CAST(coalesce(" + ", ".join(features.ASSAY) + ") IS NOT NULL AS BIGINT)",
    "max_abs_signed_log10p": "coalesce(greatest(abs(rest_signed_log10p), abs(stim8hr_signed_log10p), abs(stim48hr_signed_log10p)), 0)",
    "dyn_signed_log10p_48_rest": "coalesce(stim48hr_signed_log10p - rest_signed_log10p, 0)",
    "dyn_coef_48_rest": "coalesce(stim48hr_coef_beta - rest_coef_beta, 0)",
    "responsive_any": "CAST(coalesce(greatest(abs(rest_signed_log10p), abs(stim8hr_signed_log10p), abs(stim48hr_signed_log10p)) >= 1, false) AS DOUBLE)",
    "polarization_score": "coalesce(polarization_score, 0)", "polarization_measured": "CAST(polarization_score IS NOT NULL AS BIGINT)",
}


def _feature_sql(exprs: dict[str, str]) -> str:
    whole = {"gwas_present", "iei", "perturbseq_measured", "polarization_measured", "in_hgnc_group"}
    return ", ".join(f"{e} AS {n}" if n in whole else f"round(({e})::DOUBLE, 6) + 0.0 AS {n}" for n, e in exprs.items())


@query("WITH " + _ENTITIES + f"SELECT gene, {_feature_sql(_FEATURES)} FROM ent")
def feature_matrix(spark, sf):
    return shaped(features.feature_table(entities(spark, sf), _CONFIG, ["gene"]))


_NATIVE = {
    **{k: v for k, v in _FEATURES.items() if k not in ("perturbseq_measured", "rest_coef_beta", "rest_se_beta", "stim8hr_coef_beta",
                                                       "stim8hr_se_beta", "stim48hr_coef_beta", "stim48hr_se_beta", "gwas_score", "gwas_present")},
    **{c: c for c in features.ASSAY_SIGNIFICANCE},
    "max_abs_signed_log10p": "greatest(abs(rest_signed_log10p), abs(stim8hr_signed_log10p), abs(stim48hr_signed_log10p))",
    "dyn_signed_log10p_48_rest": "stim48hr_signed_log10p - rest_signed_log10p", "dyn_coef_48_rest": "stim48hr_coef_beta - rest_coef_beta",
    "polarization_score": "coalesce(polarization_score, (SELECT quantile_cont(polarization_score, 0.5) FROM ent))",
    "gene_family_size": "count(*) OVER (PARTITION BY family)", "in_hgnc_group": "CAST(starts_with(family, 'HGNC:') AS BIGINT)",
}


@query("WITH " + _ENTITIES + f"SELECT gene, {_feature_sql(_NATIVE)} FROM ent")
def feature_matrix_native(spark, sf):
    cfg = _CONFIG.having(assay_na_mode="native", polarization_impute="median", drop_coef_se=True, use_gwas=False, use_druggability=True)
    return shaped(features.feature_table(entities(spark, sf), cfg, ["gene"]))


_FOLDS = """,
fs AS (SELECT family, sum(label_immune) AS n_pos, count(*) AS n_rows FROM ent GROUP BY 1),
fr AS (SELECT family, (row_number() OVER (ORDER BY n_pos DESC, n_rows DESC, md5('1234:' || family), family) - 1) % 10 AS turn FROM fs),
ff AS (SELECT family, CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS fold FROM fr)
"""


@query("WITH " + _ENTITIES + _FOLDS + "SELECT gene, family, CAST(fold AS BIGINT) AS fold FROM ent JOIN ff USING (family)")
def grouped_folds(spark, sf):
    out = folds.with_folds(entities(spark, sf), "family", "label_immune", 5, 1234)
    return shaped(out.select("gene", "family", "fold"))


@query("WITH " + _ENTITIES + """,
b AS (SELECT gene, label_immune, CASE WHEN ('0x' || substr(md5(gene), 1, 4))::INT % 10 < 3 THEN 'HGNC:dominant' ELSE family END AS family FROM ent),
g AS (SELECT family, sum(label_immune) AS p, count(*) AS n FROM b GROUP BY 1),
t AS (SELECT sum(p) AS p, sum(n) AS n, max(p) FILTER (WHERE family <> 'HGNC:dominant') AS big_p, max(n) FILTER (WHERE family <> 'HGNC:dominant') AS big_n,
  max(p) FILTER (WHERE family = 'HGNC:dominant') AS dom_p, max(n) FILTER (WHERE family = 'HGNC:dominant') AS dom_n FROM g)
SELECT CAST(f AS BIGINT) AS fold, CAST(1 AS BIGINT) AS even_load, CAST(0 AS BIGINT) AS split_families FROM range(0, 5) r(f)
""")
def balanced_folds(spark, sf):
    """Folds where one family holds 30 % of all rows: whole families, and no fold but that family's carries
    more than an even share of what it leaves, give or take the largest other family."""
    ent = entities(spark, sf).select("gene", "label_immune", "family")
    dominant = F.conv(F.substring(F.md5("gene"), 1, 4), 16, 10).cast("int") % 10 < 3
    ent = ent.withColumn("family", F.when(dominant, "HGNC:dominant").otherwise(F.col("family")))
    out = folds.with_balanced_folds(ent, "family", "label_immune", 5, 1234)
    sizes = out.groupBy("family", "fold").agg(F.sum("label_immune").alias("p"), F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.struct(F.sum("p").alias("p"), F.sum("n").alias("n")).alias("t")).scalar()
    weighed = sizes.withColumn("t", total).withColumn("w", F.col("p") / F.col("t.p") + F.col("n") / F.col("t.n"))
    per = weighed.groupBy("fold").agg(F.sum("w").alias("load"), F.max(F.when(F.col("family") == "HGNC:dominant", F.col("w"))).alias("own"))
    largest = weighed.filter("family <> 'HGNC:dominant'").agg(F.max("w")).scalar()
    alone = weighed.filter("family = 'HGNC:dominant'").agg(F.max("w")).scalar()
    even = F.greatest((2 - F.col("alone")) / 4, F.lit(2 / 5))
    fair = F.when(F.col("own").isNotNull(), F.col("load") <= F.greatest(F.col("own"), even) + F.col("largest")).otherwise(F.col("load") <= even + F.col("largest"))
    split = sizes.groupBy("family").agg(F.count_distinct("fold").alias("k")).filter("k > 1").agg(F.count(F.lit(1))).scalar()
    return shaped(per.withColumns({"alone": alone, "largest": largest}).select("fold", fair.alias("even_load"), split.alias("split_families")))


_BAGS = 6


@query("WITH " + _ENTITIES + f"""
SELECT CAST(model AS BIGINT) AS model, id FROM (
  SELECT model, gene AS id, row_number() OVER (PARTITION BY model ORDER BY md5('1234:' || model || ':' || gene), gene) AS r
  FROM ent, range(0, {_BAGS}) b(model) WHERE label_immune = 0)
WHERE r <= (SELECT sum(label_immune) FROM ent)
""")
def pu_bag_membership(spark, sf):
    plan = bagging.Plan(_BAGS, None, 1234)
    ent = entities(spark, sf).select("gene", "label_immune")
    return shaped(bagging.draws(ent, "gene", "label_immune", None, plan))


@query("WITH " + _ENTITIES + _FOLDS + """
, fe AS (SELECT gene, label_immune, fold FROM ent JOIN ff USING (family)),
want AS (SELECT f AS held, (SELECT sum(label_immune) FROM fe WHERE fold <> f) AS n FROM range(0, 5) h(f))
SELECT CAST(model AS BIGINT) AS model, gene AS id FROM (
  SELECT model, gene, n, row_number() OVER (PARTITION BY model ORDER BY md5('1234:' || model || ':' || gene), gene) AS r
  FROM range(0, 15) b(model) JOIN want ON held = model // 3 JOIN fe ON fold <> held AND label_immune = 0)
WHERE r <= n
""")
def pu_fold_membership(spark, sf):
    """Draws of every held-out fold and bag, read back from the per-row membership arrays."""
    plan = bagging.Plan(3, 5, 1234)
    ent = folds.with_folds(entities(spark, sf).select("gene", "family", "label_immune"), "family", "label_immune", 5, 1234)
    out = bagging.with_membership(ent, "gene", "label_immune", "fold", plan)
    return shaped(out.select(F.explode("bags").alias("model"), F.col("gene").alias("id")))


@query()
def pu_out_of_fold(spark, sf):
    scored = ranking.out_of_fold(entities(spark, sf), {"primary": _CONFIG})
    return shaped(scored)


@query()
def pu_ablation(spark, sf):
    return shaped(ranking.ablation(entities(spark, sf), ranking.ablation_configs(_CONFIG)))


@query()
def variant_compare(spark, sf):
    configs = {n: c for n, c in ranking.ablation_configs(_CONFIG).items() if n.startswith("gwas_")}
    table_ = ranking.ablation(entities(spark, sf), configs)
    return shaped(metrics.compare_variants(table_, "enrichment", 100, list(configs)))


@query()
def pu_nominations(spark, sf):
    run = ranking.full_run(entities(spark, sf), _CONFIG)
    return shaped(ranking.nominations(run, _CONFIG, extra=["gene_id"]))


@query()
def pu_attribution(spark, sf):
    run = ranking.full_run(entities(spark, sf), _CONFIG)
    return shaped(ranking.explained(ranking.nominations(run, _CONFIG, extra=["gene_id"]), run, _CONFIG))


# Scoring and attribution with fixed coefficients, so that SQL can state the result.

_GIVEN_BAGS = 4
_GIVEN_X = {"gwas_score": "gwas_score", "iei": "iei", "mis_z_score": "coalesce(mis_z_score, 0)", "polarization_score": "coalesce(polarization_score, 0)"}
_GIVEN_COEF = [[0.5 + 0.1 * b, -0.3 + 0.2 * b, 0.05 * b, 0.02] for b in range(_GIVEN_BAGS)]
_GIVEN_INTERCEPT = [-1.0 + 0.25 * b for b in range(_GIVEN_BAGS)]
_GIVEN_MEAN = [[0.2 * b, 0.3, -0.1, 0.01 * b] for b in range(_GIVEN_BAGS)]
_GIVEN_MODELS = "(VALUES " + ", ".join(
    f"({b}, {i}::DOUBLE, " + ", ".join(f"{v}::DOUBLE" for v in c + m) + ")"
    for b, (i, c, m) in enumerate(zip(_GIVEN_INTERCEPT, _GIVEN_COEF, _GIVEN_MEAN))
) + ") mo(model, b0, c0, c1, c2, c3, m0, m1, m2, m3)"
_GIVEN_ROWS = "gx AS (SELECT gene, label_immune AS y, " + ", ".join(f"({e})::DOUBLE AS x{i}" for i, e in enumerate(_GIVEN_X.values())) + " FROM ent)"


def _given(spark, sf):
    plan = bagging.Plan(_GIVEN_BAGS, None, 77)
    fitted = bagging.LinearModels(
        list(_GIVEN_X), plan, np.array(_GIVEN_COEF), np.array(_GIVEN_INTERCEPT), np.array(_GIVEN_MEAN))
    ent = bagging.with_membership(entities(spark, sf), "gene", "label_immune", None, plan)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in _GIVEN_X])
    rows = ent.select(F.col("gene").alias("id"), F.lit(0).alias("variant"), F.col("label_immune").alias("y"), F.lit(-2).alias("fold"), "bags", "bags_times", x.alias("x"))
    return rows, fitted


@query("WITH " + _ENTITIES + ", " + _GIVEN_ROWS + f""",
dr AS (SELECT model, gene, row_number() OVER (PARTITION BY model ORDER BY md5('77:' || model || ':' || gene), gene) <= (SELECT sum(y) FROM gx) AS drawn
  FROM gx, range(0, {_GIVEN_BAGS}) b(model) WHERE y = 0),
pr AS (SELECT gx.gene, model, y = 1 OR coalesce(drawn, false) AS inside, 1 / (1 + exp(-(b0 + c0 * x0 + c1 * x1 + c2 * x2 + c3 * x3))) AS p
  FROM gx CROSS JOIN {_GIVEN_MODELS} LEFT JOIN dr USING (gene, model))
SELECT gene AS id, round(coalesce(avg(p) FILTER (WHERE NOT inside), avg(p)), 6) AS score,
  CAST(count(*) FILTER (WHERE NOT inside) AS BIGINT) AS oob_models, CAST(count(*) FILTER (WHERE inside) AS BIGINT) AS inbag_models FROM pr GROUP BY 1
""")
def out_of_bag_scores(spark, sf):
    rows, fitted = _given(spark, sf)
    return shaped(bagging.score_linear(rows, {0: fitted}).select("id", "score", "oob_models", "inbag_models"))


@query("WITH " + _ENTITIES + ", " + _GIVEN_ROWS + f"""
SELECT gene AS id, """ + ", ".join(
    f"round(avg(c{i} * (x{i} - m{i})), 6) + 0.0 AS {f}" for i, f in enumerate(_GIVEN_X)
) + f" FROM gx CROSS JOIN {_GIVEN_MODELS} GROUP BY 1")
def linear_attribution(spark, sf):
    rows, fitted = _given(spark, sf)
    told = attribution.linear_attribution(rows, fitted, ["id"])
    return shaped(told.select("id", *[F.get("contributions", F.lit(i))["value"].alias(f) for i, f in enumerate(_GIVEN_X)]))


@query("WITH " + _ENTITIES + "SELECT gene, gene_id, round(gwas_score * 0.5 + 0.25, 6) AS pu_score, CAST(iei AS BIGINT) AS iei FROM ent")
def scored_entity_table(spark, sf):
    """Scores joined back on the stable id with row and completeness guards."""
    ent = entities(spark, sf)
    scores = ent.select("gene_id", (F.col("gwas_score") * 0.5 + 0.25).alias("pu_score"))
    out = attach_checked(ent.select("gene", "gene_id", "iei"), scores, "gene_id", ["pu_score"])
    return shaped(place_after(out, "pu_score", "gene_id"))


# ------------------------------------------------------------------------- trees

# Each fixed tree: (feature, bin of the split, left, right), a leaf is its margin. Edges give the thresholds.
_TREE_EDGES = [[0.05, 0.2, 0.5], [0.5], [-0.5, 0.0, 0.75], [-0.25, 0.25]]
_TREES = [
    [(0, 2, (2, 1, -0.4, 0.15), (1, 1, 0.3, 0.9)), (3, 0, -0.1, (0, 1, -0.2, 0.35))],
    [(2, 3, (0, 3, -0.25, 0.5), (3, 2, 0.1, 0.6)), (1, 1, (2, 0, -0.3, 0.05), 0.45)],
]
_TREE_X = {"gwas_score": "gwas_score", "iei": "iei::DOUBLE", "mis_z_score": "mis_z_score", "polarization_score": "polarization_score"}


def _tree_forest():
    plan = bagging.Plan(len(_TREES), None, 77)
    shape = (len(_TREES), len(_TREES[0]), 7)
    arrays = {"feature": np.full(shape, -1, np.int16), "split": np.zeros(shape, np.uint8), "value": np.zeros(shape), "cover": np.zeros(shape)}

    def put(m, t, node, tree, cover):
        arrays["cover"][m, t, node] = cover
        if not isinstance(tree, tuple):
            arrays["value"][m, t, node] = tree
            return
        arrays["feature"][m, t, node], arrays["split"][m, t, node] = tree[:2]
        put(m, t, 2 * node + 1, tree[2], cover * 0.75)
        put(m, t, 2 * node + 2, tree[3], cover * 0.25)

    for m, trees in enumerate(_TREES):
        for t, tree in enumerate(trees):
            put(m, t, 0, tree, 64.0)
    return boosting.Forest(list(_TREE_X), plan, [np.array(e) for e in _TREE_EDGES], **arrays)


def _tree_rows(spark, sf):
    ent = bagging.with_membership(entities(spark, sf), "gene", "label_immune", None, bagging.Plan(len(_TREES), None, 77))
    x = F.array(*[F.col(c).cast("double") for c in _TREE_X])
    return ent.select(F.col("gene").alias("id"), F.lit(0).alias("variant"), F.col("label_immune").alias("y"), F.lit(-2).alias("fold"), "bags", "bags_times", x.alias("x"))


def _tree_sql(tree, known=None):
    """A tree as nested cases; with ``known`` only these features decide, others take the share of rows (3 : 1)."""
    if not isinstance(tree, tuple):
        return f"{tree}::DOUBLE"
    f, b, left, right = tree
    one, other = _tree_sql(left, known), _tree_sql(right, known)
    if known is not None and f not in known:
        return f"(0.75::DOUBLE * {one} + 0.25::DOUBLE * {other})"
    test = f"x{f} IS NULL" + (f" OR x{f} <= {_TREE_EDGES[f][b - 1]}" if b else "")
    return f"(CASE WHEN {test} THEN {one} ELSE {other} END)"


def _shapley_sql(f):
    """Shapley value of one feature over all trees by all subsets of the other three, per model averaged."""
    others, terms = [g for g in range(4) if g != f], []
    for size, weight in ((0, 1 / 4), (1, 1 / 12), (2, 1 / 12), (3, 1 / 4)):
        for some in itertools.combinations(others, size):
            for tree in (t for trees in _TREES for t in trees):
                terms.append(f"{weight!r}::DOUBLE * ({_tree_sql(tree, {*some, f})} - {_tree_sql(tree, set(some))})")
    return "(" + " + ".join(terms) + f") / {len(_TREES)}"


_TREE_SELECT = "tx AS (SELECT gene, label_immune AS y, " + ", ".join(f"{e} AS x{i}" for i, e in enumerate(_TREE_X.values())) + " FROM ent)"


@query("WITH " + _ENTITIES + ", " + _TREE_SELECT + f""",
dr AS (SELECT model, gene, row_number() OVER (PARTITION BY model ORDER BY md5('77:' || model || ':' || gene), gene) <= (SELECT sum(y) FROM tx) AS drawn
  FROM tx, range(0, {len(_TREES)}) b(model) WHERE y = 0),
pr AS (SELECT tx.gene, model, y = 1 OR coalesce(drawn, false) AS inside, 1 / (1 + exp(-(CASE model
  """ + " ".join(f"WHEN {m} THEN " + " + ".join(_tree_sql(t) for t in trees) for m, trees in enumerate(_TREES)) + f""" END))) AS p
  FROM tx CROSS JOIN range(0, {len(_TREES)}) b(model) LEFT JOIN dr USING (gene, model))
SELECT gene AS id, round(coalesce(avg(p) FILTER (WHERE NOT inside), avg(p)), 6) AS score,
  CAST(count(*) FILTER (WHERE NOT inside) AS BIGINT) AS oob_models, CAST(count(*) FILTER (WHERE inside) AS BIGINT) AS inbag_models FROM pr GROUP BY 1
""")
def tree_scores_given(spark, sf):
    """Scores of fixed trees by the out-of-bag rules."""
    scored = boosting.score_forests(_tree_rows(spark, sf), {0: _tree_forest()})
    return shaped(scored.select("id", "score", "oob_models", "inbag_models"))


@query("WITH " + _ENTITIES + ", " + _TREE_SELECT + " SELECT gene AS id, " + ", ".join(
    f"round({_shapley_sql(i)}, 6) + 0.0 AS {f}" for i, f in enumerate(_TREE_X)) + " FROM tx")
def tree_attribution_given(spark, sf):
    """Shapley values of fixed trees, by all subsets in SQL."""
    told = boosting.forest_attribution(_tree_rows(spark, sf).select("id", "x"), _tree_forest(), ["id"], "id")
    return shaped(told.select("id", *[F.get("contributions", F.lit(i))["value"].alias(f) for i, f in enumerate(_TREE_X)]))


_GROWN = boosting.TreeSettings(n_trees=1, max_depth=2, step=0.1, subsample=1.0, columns=1.0, min_rows=5, n_bins=8)
_GROWN_BAGS = 3


def _level_sql(name, rows):
    """The best split of every node in ``rows`` (model, node, gene, w, y): one of equal gains by feature, then bin."""
    return f"""
{name}_h AS (SELECT model, node, j, bin, sum(w * (0.5 - y)) AS g, sum(w * 0.25) AS h, sum(w) AS c FROM {rows} JOIN bins USING (gene) GROUP BY ALL),
{name}_l AS (SELECT *, sum(g) OVER t AS gl, sum(h) OVER t AS hl, sum(c) OVER t AS cl, sum(g) OVER a AS gt, sum(h) OVER a AS ht, sum(c) OVER a AS ct FROM {name}_h
  WINDOW t AS (PARTITION BY model, node, j ORDER BY bin), a AS (PARTITION BY model, node, j)),
{name} AS (SELECT * FROM (SELECT *, gl * gl / hl + (gt - gl) * (gt - gl) / nullif(ht - hl, 0) - gt * gt / ht AS gain FROM {name}_l)
  WHERE cl >= {_GROWN.min_rows} AND ct - cl >= {_GROWN.min_rows} AND gain::FLOAT > 1e-10
  QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY gain::FLOAT DESC, j, bin) = 1)"""


@query("WITH " + _ENTITIES + ", " + _TREE_SELECT + f""",
dr AS (SELECT model, gene, y, 1.0::DOUBLE AS w FROM tx, range(0, {_GROWN_BAGS}) b(model) WHERE y = 0
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY md5('77:' || model || ':' || gene), gene) <= (SELECT sum(y) FROM tx)),
bag AS (SELECT * FROM dr UNION ALL SELECT model, gene, y, 1.0 FROM tx, range(0, {_GROWN_BAGS}) b(model) WHERE y = 1),
xl AS (SELECT gene, unnest([x0, x1, x2, x3]) AS x, unnest([0, 1, 2, 3]) AS j FROM tx WHERE gene IN (SELECT gene FROM bag)),
ed AS (SELECT j, unnest(list_distinct(quantile_cont(x, [{", ".join(f"{i}/7.0::DOUBLE" for i in range(1, 7))}]))) AS e FROM xl WHERE x IS NOT NULL GROUP BY j),
rk AS (SELECT j, e, row_number() OVER (PARTITION BY j ORDER BY e) AS bin FROM ed),
bins AS (SELECT gene, j, CASE WHEN x IS NULL THEN 0 ELSE 1 + (SELECT count(*) FROM ed WHERE ed.j = xl.j AND e < x) END AS bin FROM xl),
r0 AS (SELECT model, 0 AS node, gene, y, w FROM bag),
{_level_sql("s0", "r0")},
r1 AS (SELECT model, CASE WHEN b.bin <= s0.bin THEN 1 ELSE 2 END AS node, gene, y, w FROM r0 JOIN s0 USING (model, node) JOIN bins b USING (gene, j)),
{_level_sql("s1", "r1")},
r2 AS (SELECT model, 2 * node + CASE WHEN b.bin <= s1.bin THEN 1 ELSE 2 END AS node, gene, y, w FROM r1 JOIN s1 USING (model, node) JOIN bins b USING (gene, j)),
every AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2),
v AS (SELECT model, node, -{_GROWN.step} * sum(w * (0.5 - y)) / sum(w * 0.25) AS value, sum(w) AS cover FROM every GROUP BY ALL),
s AS (SELECT model, node, j, bin FROM s0 UNION ALL SELECT model, node, j, bin FROM s1)
SELECT CAST(model AS BIGINT) AS model, CAST(node AS BIGINT) AS node, ['gwas_score', 'iei', 'mis_z_score', 'polarization_score'][j + 1] AS feature,
  round(CASE WHEN bin = 0 THEN -1e6 ELSE e END, 6) + 0.0 AS threshold, round(value, 6) + 0.0 AS value, CAST(cover AS BIGINT) AS cover
FROM v LEFT JOIN s USING (model, node) LEFT JOIN rk USING (j, bin)
""")
def pu_first_trees(spark, sf):
    """The first tree of every bag: bins, splits, values and counts of its nodes."""
    plan = bagging.Plan(_GROWN_BAGS, None, 77)
    ent = bagging.with_membership(entities(spark, sf), "gene", "label_immune", None, plan)
    x = F.array(*[F.col(c).cast("double") for c in _TREE_X])
    train = ent.where("label_immune = 1 OR size(bags) > 0").select(
        F.col("gene").alias("id"), F.lit(0).alias("variant"), F.col("label_immune").alias("y"), F.lit(-2).alias("fold"), "bags", "bags_times", x.alias("x"))
    forest = boosting.fit_forests(train, {0: list(_TREE_X)}, plan, _GROWN)[0]
    nodes = boosting.forest_nodes(spark, forest)
    threshold = F.when(F.col("threshold") == float("-inf"), -1e6).otherwise(F.col("threshold"))
    return shaped(nodes.select("model", "node", "feature", threshold.alias("threshold"), "value", F.col("cover").cast("bigint").alias("cover")))


@query()
def pu_tree_ablation(spark, sf):
    """The compared settings with boosted trees, with all published trees and bags."""
    base = _CONFIG.having(learner="trees")
    return shaped(ranking.ablation(entities(spark, sf), ranking.ablation_configs(base)))


# ------------------------------------------------------- bags: medians, draws, fits

_DRAWN = """
dr AS (SELECT model, gene, label_immune AS y FROM ent, range(0, {bags}) b(model) WHERE label_immune = 0
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY md5('77:' || model || ':' || gene), gene) <= (SELECT sum(label_immune) FROM ent)),
bag AS (SELECT * FROM dr UNION ALL SELECT model, gene, label_immune FROM ent, range(0, {bags}) b(model) WHERE label_immune = 1)
"""


def _bag_train(spark, sf, bags, columns):
    """Training rows of the full run with flags for the ``columns`` that can be missing."""
    plan = bagging.Plan(bags, None, 77)
    ent = bagging.with_membership(entities(spark, sf), "gene", "label_immune", None, plan)
    value = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    missing = [j for j, c in enumerate(columns) if c in ("mis_z_score", "lof_oe_ci_upper", "polarization_score")]
    flags = [F.when(F.col(columns[j]).isNull(), 1.0).otherwise(0.0) for j in missing]
    rows = ent.where("label_immune = 1 OR size(bags) > 0").select(
        F.col("gene").alias("id"), F.lit(0).alias("variant"), F.col("label_immune").alias("y"), F.lit(-2).alias("fold"),
        "bags", "bags_times", F.array(*value, *flags).alias("x"))
    return rows, plan, {0: missing}


@query("WITH " + _ENTITIES + ", " + _DRAWN.format(bags=5) + """,
x AS (SELECT model, unnest(['mis_z_score', 'lof_oe_ci_upper']) AS feature, unnest([mis_z_score, lof_oe_ci_upper]) AS v FROM bag JOIN ent USING (gene))
SELECT CAST(model AS BIGINT) AS model, feature, round(quantile_cont(v, 0.5), 6) + 0.0 AS median FROM x WHERE v IS NOT NULL GROUP BY ALL
""")
def pu_bag_medians(spark, sf):
    """What each bag fills missing values with: the median of its own training rows."""
    columns = ["mis_z_score", "gwas_score", "lof_oe_ci_upper"]
    train, plan, missing = _bag_train(spark, sf, 5, columns)
    names = F.array(*[F.lit(c) for c in columns])
    return shaped(bagging.bag_medians(train, {0: columns}, plan, missing).select("model", F.get(names, F.col("feature")).alias("feature"), "median"))


@query("WITH RECURSIVE " + _ENTITIES.lstrip() + ", " + _DRAWN.format(bags=1) + """,
x AS (SELECT bag.y, gwas_score AS x1, iei::DOUBLE AS x2, coalesce(mis_z_score, (SELECT quantile_cont(mis_z_score, 0.5) FROM bag JOIN ent USING (gene))) AS x3
  FROM bag JOIN ent USING (gene)),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, stddev_pop(x3) AS s3, count(*) AS n FROM x),
z AS (SELECT y, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, (x3 - m3) / s3 AS z3, 1.0 / (n + 1) AS t FROM x, m),
it AS (SELECT 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3
  UNION ALL SELECT i + 1, b0 - t * g0, """ + ", ".join(
    f"sign(b{k} - t * (g{k} + 0.5 * b{k})) * greatest(abs(b{k} - t * (g{k} + 0.5 * b{k})) - 0.5 * t, 0)" for k in (1, 2, 3)) + """
  FROM (SELECT i, b0, b1, b2, b3, t, sum(p - y) AS g0, sum((p - y) * z1) AS g1, sum((p - y) * z2) AS g2, sum((p - y) * z3) AS g3
    FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2 + b3 * z3))) AS p FROM it, z WHERE i < 1500) GROUP BY ALL)),
e AS (SELECT b1 / s1 AS c1, b2 / s2 AS c2, b3 / s3 AS c3, b0 - b1 / s1 * m1 - b2 / s2 * m2 - b3 / s3 * m3 AS c0 FROM it, m WHERE i = 1500)
SELECT unnest(['intercept', 'gwas_score', 'iei', 'mis_z_score']) AS term, round(unnest([c0, c1, c2, c3]), 4) + 0.0 AS value FROM e
""")
def linear_fit_of_one_bag(spark, sf):
    """Coefficients of one bag's elastic net: its own median, scaling and penalty, against plain descent in SQL."""
    columns = ["gwas_score", "iei", "mis_z_score"]
    train, plan, missing = _bag_train(spark, sf, 1, columns)
    fitted = bagging.fit_linear(train, {0: columns}, plan, missing, tol=1e-9)[0]
    values = [("intercept", float(fitted.intercept[0])), *zip(columns, map(float, fitted.coef[0]))]
    return shaped(spark.createDataFrame(values, "term string, value double"), 4)


@query("WITH " + _ENTITIES + """,
pool AS (SELECT gene, CAST(row_number() OVER (ORDER BY gene) AS BIGINT) AS number, count(*) OVER () AS have FROM ent WHERE label_immune = 1),
asked AS (SELECT model, j FROM range(0, 3) b(model), range(0, (SELECT count(*) FROM ent WHERE label_immune = 0)) a(j)),
picks AS (SELECT model, ('0x' || substr(md5('77:' || model || ':' || j), 1, 12))::BIGINT % (SELECT count(*) FROM pool) + 1 AS number FROM asked)
SELECT CAST(model AS BIGINT) AS model, gene AS id, CAST(count(*) AS BIGINT) AS times FROM picks JOIN pool USING (number) GROUP BY ALL
""")
def pu_replacement_draw(spark, sf):
    """Draws from a pool smaller than their number: rows with how often each model drew them."""
    rare = entities(spark, sf).select("gene", (1 - F.col("label_immune")).alias("label"))
    out = bagging.with_membership(rare, "gene", "label", None, bagging.Plan(3, None, 77)).where("size(bags) > 0")
    both = F.arrays_zip(F.col("bags").alias("model"), F.col("bags_times").alias("times"))
    return shaped(out.select(F.col("gene").alias("id"), F.explode(both).alias("e")).select(F.col("e.model").alias("model"), "id", F.col("e.times").alias("times")))


# ----------------------------------------------------------------------- metrics

_SCORED = """
sc AS (SELECT doc_id, source, quality, floor(n_chars / 100.0::DOUBLE) AS score FROM documents JOIN labels USING (doc_id))
"""


def _scored(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.floor(F.col("n_chars") / 100.0).cast("double").alias("score"))
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("WITH " + _SCORED + """,
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM sc),
t AS (SELECT count(*) AS n, sum(quality) AS p FROM sc)
SELECT CAST(n AS BIGINT) AS n, CAST(p AS BIGINT) AS n_pos, CAST(k AS BIGINT) AS k, CAST(h AS BIGINT) AS hits, round(p / n::DOUBLE, 6) AS base_rate,
  round(h / p::DOUBLE, 6) AS recall, round((h / least(k, n)::DOUBLE) / (p / n::DOUBLE), 6) AS enrichment
FROM (SELECT n, p, k, (SELECT sum(quality) FROM r WHERE rk <= k) AS h FROM t, (VALUES (50), (100), (200), (500)) v(k))
""")
def ranked_metrics(spark, sf):
    return shaped(metrics.at_top(_scored(spark, sf), "score", "quality", "doc_id", (50, 100, 200, 500)))


@query("WITH " + _SCORED + """,
g AS (SELECT source, score, count(*) AS n, sum(quality) AS p FROM sc GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER w AS seen, sum(p) OVER w AS tp FROM g WINDOW w AS (PARTITION BY source ORDER BY score DESC))
SELECT source, round(coalesce(sum(p * tp / seen::DOUBLE) / nullif(sum(p), 0), 0), 6) AS average_precision FROM c GROUP BY 1
""")
def average_precision(spark, sf):
    return shaped(metrics.average_precision(_scored(spark, sf), "score", "quality", ["source"]))


@query("WITH " + _SCORED + """
SELECT doc_id, row_number() OVER w AS rank, CAST(sum(quality) OVER w AS BIGINT) AS hits FROM sc
WINDOW w AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)
""")
def cumulative_hits(spark, sf):
    return metrics.cumulative_hits(_scored(spark, sf), "score", "quality", "doc_id").select("doc_id", "rank", "hits")


# ------------------------------------------- comparisons and nominations of given scores

_COMPARED = """,
s AS (SELECT 'gwas' AS variant, gene AS id, label_immune AS y, gwas_score AS score FROM ent
  UNION ALL SELECT 'mis', gene, label_immune, mis_z_score FROM ent),
rk AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY score DESC NULLS LAST, id) AS r FROM s),
n AS (SELECT variant, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM s GROUP BY 1),
h AS (SELECT variant, k, sum(CASE WHEN r <= k THEN y ELSE 0 END)::DOUBLE AS hits FROM rk, (SELECT unnest([50, 100, 1200]) AS k) GROUP BY ALL),
m AS (SELECT h.variant, k, hits, hits / p AS recall, (hits / least(k, n)) / (p / n) AS enrichment, p / n AS base_rate FROM h JOIN n USING (variant)),
t AS (SELECT variant, score, sum(y) AS pos, count(*) AS c FROM s GROUP BY 1, 2),
q AS (SELECT variant, pos, sum(pos) OVER w AS tp, sum(c) OVER w AS seen FROM t WINDOW w AS (PARTITION BY variant ORDER BY score DESC NULLS LAST)),
tidy AS (SELECT variant, k::BIGINT AS k, metric, value FROM (SELECT variant, k, unnest(['hits', 'recall', 'enrichment', 'base_rate']) AS metric,
    unnest([hits, recall, enrichment, base_rate]) AS value FROM m)
  UNION ALL SELECT variant, NULL, 'average_precision', sum(pos * tp / seen)::DOUBLE / sum(pos) FROM q GROUP BY 1)
"""


def _compared(spark, sf):
    """The tidy metrics of two given scores, as an ablation computes them for fitted ones."""
    ent = entities(spark, sf)
    kinds = F.array(*[
        F.struct(F.lit(n).alias("variant"), F.col(c).alias("score")) for n, c in (("gwas", "gwas_score"), ("mis", "mis_z_score"))
    ])
    scored = ent.select(F.col("gene").alias("id"), F.col("label_immune").alias("y"), F.inline(kinds))
    ks = [50, 100, 1200]
    return metrics.tidy(
        metrics.at_top(scored, "score", "y", "id", ks, ["variant"]), metrics.average_precision(scored, "score", "y", ["variant"]), ["variant"]
    )


@query("WITH " + _ENTITIES + _COMPARED + "SELECT variant, k, metric, round(value, 6) AS value FROM tidy")
def metrics_of_given_scores(spark, sf):
    return shaped(_compared(spark, sf))


@query("WITH " + _ENTITIES + _COMPARED + """
SELECT round(max(value) FILTER (WHERE variant = 'gwas'), 6) AS gwas, round(max(value) FILTER (WHERE variant = 'mis'), 6) AS mis
FROM tidy WHERE metric = 'enrichment' AND k = 1200
""")
def compare_given_scores(spark, sf):
    return shaped(metrics.compare_variants(_compared(spark, sf), "enrichment", 1200, ["gwas", "mis"]))


@query("WITH " + _ENTITIES + """
SELECT row_number() OVER (ORDER BY gwas_score + coalesce(mis_z_score, 0) DESC, gene) AS rank, gene, gene_id,
  round(gwas_score + coalesce(mis_z_score, 0), 6) AS pu_score, CAST(label_all AS BIGINT) AS label_all, CAST(label_immune AS BIGINT) AS label_immune,
  CASE WHEN label_immune = 1 THEN 'positive' ELSE 'unlabeled' END AS label_status, family, CAST(length(family) AS BIGINT) AS oob_models,
  CAST(gwas_score <> 0 AS BIGINT) AS gwas_present, CAST(coalesce(""" + ", ".join(features.ASSAY) + """) IS NOT NULL AS BIGINT) AS perturbseq_measured
FROM ent
""")
def nominations_of_given_scores(spark, sf):
    """The nomination table of given scores: rank, labels, presence flags."""
    scored = entities(spark, sf).withColumns(
        {"score": F.col("gwas_score") + F.coalesce("mis_z_score", F.lit(0.0)), "oob_models": F.length("family").cast("bigint")}
    )
    out = ranking.nominations(ranking.FullRun(scored, None), _CONFIG, extra=["gene_id"])
    return shaped(out.select("rank", "gene", "gene_id", "pu_score", "label_all", "label_immune", "label_status", "family", "oob_models",
                             "gwas_present", "perturbseq_measured"))


# ------------------------------------------------------------------- driver tags

_TAG_FEATURES = ("gwas_score", "iei", "mis_z_score", "gene_family_size", "rest_signed_log10p")
_TAG_VALUES = {
    "gwas_score": "gwas_score * 2.0::DOUBLE - 0.3", "iei": "iei * 0.8::DOUBLE - 0.1", "mis_z_score": "coalesce(mis_z_score, 0) * 0.5::DOUBLE",
    "gene_family_size": "(length(family) - 10) * 0.25::DOUBLE", "rest_signed_log10p": "coalesce(rest_signed_log10p, 0) * -0.5::DOUBLE",
}


@query("WITH " + _ENTITIES + """,
c AS (SELECT gene, unnest([""" + ", ".join(f"'{f}'" for f in _TAG_FEATURES) + "]) AS f, unnest([" + ", ".join(
    f"({_TAG_VALUES[f]})::DOUBLE" for f in _TAG_FEATURES) + """]) AS v, unnest([1, 2, 3, 4, 5]) AS i FROM ent),
s AS (SELECT gene, sum(greatest(v, 0)) AS total, sum(CASE WHEN f IN ('gwas_score', 'iei', 'rest_signed_log10p') THEN greatest(v, 0) ELSE 0 END) AS ev,
    sum(CASE WHEN f = 'gene_family_size' THEN greatest(v, 0) ELSE 0 END) AS fam FROM c GROUP BY 1),
o AS (SELECT gene, f, v, row_number() OVER (PARTITION BY gene ORDER BY abs(v) DESC, i) AS r FROM c)
SELECT s.gene, CASE WHEN total <= 0 THEN 'weak/mixed' WHEN fam / total > 0.5 THEN 'family/druggability-driven'
    WHEN ev / total >= 0.5 THEN 'genetics+perturbseq-driven' ELSE 'mixed' END AS driver,
  (SELECT string_agg(f || CASE WHEN v >= 0 THEN '+' ELSE '-' END || round(abs(v)::VARCHAR::DECIMAL(38, 20), 3)::DECIMAL(28, 3)::VARCHAR, '; ' ORDER BY r) FROM o WHERE o.gene = s.gene AND r <= 3) AS top_features
FROM s
""")
def driver_tags(spark, sf):
    ent = entities(spark, sf)
    values = {
        "gwas_score": F.col("gwas_score") * 2.0 - 0.3, "iei": F.col("iei") * 0.8 - 0.1,
        "mis_z_score": F.coalesce("mis_z_score", F.lit(0.0)) * 0.5, "gene_family_size": (F.length("family") - 10) * 0.25,
        "rest_signed_log10p": F.coalesce("rest_signed_log10p", F.lit(0.0)) * -0.5,
    }
    told = attribution.explain(ent.select("gene", F.array(*[
        F.struct(F.lit(f).alias("feature"), values[f].cast("double").alias("value")) for f in _TAG_FEATURES
    ]).alias("contributions")))
    return told.select("gene", "driver", "top_features")
