"""Labels, features, folds, draws, learner, scores, metrics, attribution."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evidentia.functions import digests
from evidentia.operators import attribution, bagging, boosting, features, folds, metrics
from evidentia.operators.features import RunConfig
from evidentia.plans import ranking
from tests.conftest import rows
from tests.test_boosting import expected

N = 400


@pytest.fixture(scope="module")
def table(spark):
    """Entities with a planted score signal, missing blocks and one dominant family."""
    rng = np.random.default_rng(11)
    data = []
    for i in range(N):
        hit = i % 8 == 0
        gwas = float(rng.uniform(0.2, 1.0)) if (hit and rng.random() < 0.9) or rng.random() < 0.1 else 0.0
        measured = rng.random() < 0.5
        block = [float(v) if measured else None for v in rng.normal(0, 1, 9)]
        if measured and i % 5 == 0:
            block[3] = None
        data.append((
            f"g{i:03d}", f"ENSG{i}", None if i % 11 == 0 else float(rng.normal()), float(rng.normal()), int(rng.random() < 0.3),
            gwas, *block, None if i % 3 else float(rng.normal()), int(hit), "HGNC:1" if i % 3 == 0 else f"PFX:{i // 6}",
        ))
    cols = ["gene", "gene_id", "lof_oe_ci_upper", "mis_z_score", "iei", "gwas_score", *features.ASSAY, "polarization_score", "approved", "family"]
    types = ["string", "string", "double", "double", "int", "double", *["double"] * 9, "double", "int", "string"]
    df = spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in zip(cols, types)))
    targets = df.filter("approved = 1").select("gene")
    return features.with_labels(df.drop("approved"), targets).repartition(5).cache()


CFG = RunConfig(n_bags=4, n_folds=3, top_k_list=(10, 50), top_n_report=5)


def test_labels(table):
    bad = table.filter("label_immune = 1 and not (label_all = 1 and (gwas_score > 0 or iei = 1))").count()
    assert bad == 0 and table.filter("label_all = 1").count() == N // 8
    summary = features.label_summary(table, table.filter("label_all = 1").select("gene").unionByName(table.sparkSession.createDataFrame([("zz",)], "gene string"))).first()
    assert summary["n_targets"] == N // 8 + 1 and summary["n_targets_missing"] == 1


def test_features_keep_rows_and_policies(table):
    full = features.feature_table(table, CFG, ["gene"])
    assert full.count() == N
    assert full.filter("rest_signed_log10p is null or polarization_score is null").count() == 0
    assert full.filter("lof_oe_ci_upper is null").count() == len(range(0, N, 11))
    for c in ("gwas_present", "perturbseq_measured", "polarization_measured"):
        assert {r[0] for r in full.select(c).distinct().collect()} <= {0, 1}
    native = CFG.having(assay_na_mode="native", polarization_impute="median")
    raw = features.feature_table(table, native, ["gene"])
    assert raw.filter("rest_signed_log10p is null").count() > 0
    assert "perturbseq_measured" not in features.feature_groups(native)["perturbseq"]
    assert raw.filter("responsive_any is null").count() == 0
    pol = [r[0] for r in table.select("polarization_score").dropna().collect()]
    unmeasured = raw.join(table.filter("polarization_score is null").select("gene"), "gene").select("polarization_score").distinct().collect()
    assert [r[0] for r in unmeasured] == [pytest.approx(float(np.median(pol)))]
    # A partly missing block skips missing entries.
    part = table.filter("stim8hr_coef_beta is null and rest_coef_beta is not null").select("gene")
    assert raw.join(part, "gene").filter("max_abs_signed_log10p is null").count() == 0


def test_feature_registry():
    assert len(features.feature_columns(RunConfig())) == 21
    assert len(features.feature_columns(RunConfig(use_gwas=False))) == 19
    assert len(features.feature_columns(RunConfig(assay_na_mode="native"))) == 20
    assert len(features.feature_columns(RunConfig(use_druggability=True))) == 23
    assert len(features.feature_columns(RunConfig(drop_coef_se=True))) == 15


def test_typed_entities(spark):
    raw = spark.createDataFrame([("a", "0.5", None, "1", "NA", "x"), ("b", None, "bad", None, "2", "1")],
                                "gene string, gwas_score string, lof_oe_ci_upper string, iei string, mis_z_score string, polarization_score string")
    got = rows(features.typed_entities(raw))
    assert got == [("a", 0.5, None, 1, None, None), ("b", 0.0, None, 0, 2.0, 1.0)]


def test_folds_do_not_leak_and_balance(table):
    out = folds.with_folds(table, "family", "label_immune", 3, 7).cache()
    assert out.count() == N and folds.leaked_groups(out, "family", "fold").count() == 0
    per = out.groupBy("fold").agg(F.sum("label_immune").alias("p")).collect()
    assert len(per) == 3 and all(r["p"] > 0 for r in per)
    assert rows(folds.with_folds(table.repartition(1), "family", "label_immune", 3, 7).select("gene", "fold")) == rows(out.select("gene", "fold"))


def _expected_draws(genes, unlabeled, n, plan, model):
    import hashlib

    keyed = sorted((hashlib.md5(f"{plan.seed}:{model}:{g}".encode()).hexdigest(), g) for g in genes if g in unlabeled)
    return {g for _, g in keyed[:n]}


def test_draws_match_direct_ranking(table):
    plan = bagging.Plan(5, None, 9)
    labels = {r["gene"]: r["label_all"] for r in table.select("gene", "label_all").collect()}
    unlabeled = {g for g, y in labels.items() if y == 0}
    got = {}
    for r in bagging.draws(table, "gene", "label_all", None, plan).collect():
        got.setdefault(r["model"], set()).add(r["id"])
    for m in range(5):
        assert got[m] == _expected_draws(labels, unlabeled, N // 8, plan, m)
    member = bagging.with_membership(table, "gene", "label_all", None, plan)
    arrays = {r["gene"]: set(r["bags"]) for r in member.collect()}
    assert all((m in arrays[g]) == (g in got[m]) for m in range(5) for g in labels)
    assert len(set(map(frozenset, got.values()))) == 5


def test_draws_survive_a_cut_that_is_too_tight(table, monkeypatch):
    plan = bagging.Plan(2, None, 9)
    want = rows(bagging.draws(table, "gene", "label_all", None, plan))
    monkeypatch.setattr(bagging, "_cut", lambda wanted, pool: "00000001")
    assert rows(bagging.draws(table, "gene", "label_all", None, plan)) == want


def test_draws_rank_only_rows_near_the_last_one(spark, monkeypatch):
    """All rows that a model drew used to be ranked to find its last one."""
    df = spark.range(20_000).select(F.concat(F.lit("g"), "id").alias("gene"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    ranked = []
    whole = bagging.row_rank
    monkeypatch.setattr(bagging, "row_rank", lambda near, *a: ranked.append(near.count()) or whole(near, *a))
    plan = bagging.Plan(2, None, 9)
    labels = {r["gene"]: r["y"] for r in df.collect()}
    got = {}
    for r in bagging.draws(df, "gene", "y", None, plan).collect():
        got.setdefault(r["model"], set()).add(r["id"])
    for m in range(2):
        assert got[m] == _expected_draws(labels, {g for g, y in labels.items() if y == 0}, 5_000, plan, m)
    assert len(ranked) == 1 and ranked[0] < 2 * 2_000


def test_digests_of_many_texts():
    rng = np.random.default_rng(6)
    for before, behind in itertools.product((1, 5, 8, 63, 64), (0, 3, 47, 55, 56, 120)):
        heads = [bytes(rng.integers(0, 256, before, dtype=np.uint8)) for _ in range(3)]
        tails = rng.integers(0, 256, (5, behind), dtype=np.uint8)
        want = [[int(hashlib.md5(h + t.tobytes()).hexdigest()[:16], 16) for t in tails] for h in heads]
        assert (digests.leading_md5(heads, tails) == np.array(want, dtype=np.uint64)).all()


def test_a_pair_is_hashed_once(spark):
    """Every table with draws, and the scores that need none, hashed all rows for all models again."""
    ids = [f"g{i}" for i in range(200)] + ["g1", None, "\u00e9" * 40]
    df = spark.createDataFrame([(g, int(i % 5 == 0), i % 4 if i % 50 else None) for i, g in enumerate(ids)], "gene string, y int, fold int")
    plan = bagging.Plan(3, 4, 9)
    member = bagging.with_membership(df, "gene", "y", "fold", plan)
    text = lambda m, g: hashlib.md5(":".join([str(9), str(m)] + [g] * (g is not None)).encode()).hexdigest()
    got = [(r["gene"], r["fold"], r["y"], set(r["bags"])) for r in member.collect()]
    for m in range(12):
        pool = sorted(text(m, g) for g, f, y, _ in got if y == 0 and f is not None and f != m // 3)
        n = min(bagging.draw_sizes(df, "y", "fold", plan)[m // 3])
        assert all((m in bags) == (y == 0 and f is not None and f != m // 3 and text(m, g) <= pool[min(n, len(pool)) - 1]) for g, f, y, bags in got)
    leaf = member._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEval" not in leaf and "sequence" not in leaf


def test_medians_rank_only_values_near_the_middle(spark, monkeypatch):
    """All values of all bags used to be ranked."""
    rng = np.random.default_rng(8)
    x = [(float(a) if a < 70 else None, float(b)) for a, b in zip(rng.integers(0, 90, 3000), rng.normal(size=3000))]
    bags = [[] if i % 9 == 0 else [m for m in range(4) if rng.random() < 0.3] for i in range(3000)]
    data = [(0, int(i % 9 == 0), i % 2, [m for m in bags[i] if m // 2 != i % 2], [2] * sum(m // 2 != i % 2 for m in bags[i]),
             [x[i][0] or 0.0, x[i][1], float(x[i][0] is None), 0.0]) for i in range(3000)]
    df = spark.createDataFrame(data, "variant int, y int, fold int, bags array<int>, bags_times array<int>, x array<double>").repartition(3)
    ranked, whole = [], bagging.quantiles
    monkeypatch.setattr(bagging, "quantiles", lambda near, *a: ranked.append(near.count()) or whole(near, *a))
    got = {(r["model"], r["feature"]): r["median"] for r in bagging.bag_medians(df, {0: ["a", "b"]}, bagging.Plan(2, 2, 1), {0: [0, 1]}).collect()}
    for m, j in itertools.product(range(4), range(2)):
        values = [x[i][j] for i, r in enumerate(data) if x[i][j] is not None for _ in range(r[1] and r[2] != m // 2 or 2 * (m in r[3]))]
        assert got[m, j] == pytest.approx(np.median(values), abs=1e-12)
    assert len(got) == 8 and ranked[0] < 400


def test_small_pool_draws_with_replacement(table):
    flipped = table.withColumn("y", 1 - F.col("label_all"))  # now positives outnumber the pool
    plan = bagging.Plan(3, None, 1)
    out = bagging.with_membership(flipped, "gene", "y", None, plan)
    pairs = out.select("gene", "y", F.explode(F.arrays_zip("bags", "bags_times")).alias("e")).select("gene", "y", "e.*").cache()
    drawn = pairs.groupBy("bags", "y").agg(F.sum("bags_times").alias("n")).collect()
    assert {(r["bags"], r["y"], r["n"]) for r in drawn} == {(m, 0, N - N // 8) for m in range(3)}
    assert pairs.filter("bags_times > 1").count() > 0 and pairs.count() == pairs.distinct().count()
    # Repeats weigh in the fit as if the rows were repeated.
    rows_ = out.select(F.lit(0).alias("variant"), "y", F.lit(-2).alias("fold"), "bags", "bags_times",
                       F.array("gwas_score", "mis_z_score").alias("x"))
    fitted = bagging.fit_linear(rows_, {0: ["a", "b"]}, plan)[0]
    data = rows_.collect()
    x = [list(r["x"]) for r in data for _ in range(1 if r["y"] else dict(zip(r["bags"], r["bags_times"])).get(1, 0))]
    y = [r["y"] for r in data for _ in range(1 if r["y"] else dict(zip(r["bags"], r["bags_times"])).get(1, 0))]
    coef, intercept = _direct_fit(np.array(x), np.array(y, dtype=float))
    assert fitted.coef[1] == pytest.approx(coef, abs=1e-3) and fitted.intercept[1] == pytest.approx(intercept, abs=1e-3)


def _direct_fit(x, y):
    """Elastic net logistic by proximal gradient on standardised features."""
    mu, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z = (x - mu) / sd
    b, b0 = np.zeros(z.shape[1]), 0.0
    step = 1.0 / (0.25 * (np.linalg.norm(np.c_[z, np.ones(len(z))], 2) ** 2) + 0.5)
    for _ in range(60_000):
        r = 1 / (1 + np.exp(-(z @ b + b0))) - y
        g = b - step * (z.T @ r + 0.5 * b)
        new = np.sign(g) * np.maximum(np.abs(g) - step * 0.5, 0)
        new0 = b0 - step * r.sum()
        done = max(np.abs(new - b).max(), abs(new0 - b0)) < 1e-10
        b, b0 = new, new0
        if done:
            break
    return b / sd, b0 - (b / sd) @ mu


def test_linear_learner_against_proximal_gradient(spark):
    rng = np.random.default_rng(2)
    x = np.c_[rng.normal(5, 3, 300), rng.normal(0, 0.01, 300), rng.integers(0, 2, 300), np.full(300, 4.0)]
    x = np.c_[x, x[:, 0] + rng.normal(0, 0.5, 300)]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 5 + 120 * x[:, 1])))).astype(int)
    bags = [[] if y[i] else [m for m in range(2) if (i + m) % 2] for i in range(300)]
    df = spark.createDataFrame([(3, int(y[i]), -2, bags[i], [], [float(v) for v in x[i]]) for i in range(300)],
                               "variant int, y int, fold int, bags array<int>, bags_times array<int>, x array<double>").repartition(4)
    fitted = bagging.fit_linear(df, {3: list("abcde")}, bagging.Plan(2, None, 0))[3]
    for m in range(2):
        rows_ = [i for i in range(300) if y[i] or m in bags[i]]
        coef, intercept = _direct_fit(x[rows_], y[rows_].astype(float))
        assert fitted.coef[m] == pytest.approx(coef, abs=2e-4 * np.abs(coef).max())
        assert fitted.intercept[m] == pytest.approx(intercept, abs=1e-3)
        assert fitted.mean[m] == pytest.approx(x[rows_].mean(0))
    scored = bagging.score_linear(df.withColumn("id", F.monotonically_increasing_id()), {3: fitted}).collect()
    assert len(scored) == 300 and all(0 <= r["score"] <= 1 for r in scored)


def test_columns_that_follow_from_others_are_settled_with_many_rows():
    """The more rows stood against the fixed penalty, the smaller the steps among such columns were, until the passes ran out."""
    rng = np.random.default_rng(4)
    two = (rng.random((2000, 1)) < 0.1) * rng.normal(size=(2000, 2))
    x = np.c_[two, 5 * two, two[:, 1] - two[:, 0], 3 * (two[:, 1] - two[:, 0]), np.abs(two).max(1), rng.normal(size=2000)]
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(2000)]
    y = (rng.random(2000) < 1 / (1 + np.exp(-two @ [2.0, -1.0]))).astype(float)
    for copies in (1, 1_000, 100_000):
        h, g, k = copies * z.T @ z * 0.25, copies * z.T @ (0.5 - y), z.shape[1]
        b = bagging._penalised_minimum(h[None], g[None], np.zeros((1, k)), np.ones((1, k - 1)))[0]
        pull = -g - h @ b - np.append(0.5 * b[:-1], 0.0)
        on, blur = b[:-1] != 0, 1e-12 * copies * 2000
        assert on.any() and abs(pull[-1]) <= 1e-6 + blur
        assert pull[:-1][on] == pytest.approx(0.5 * np.sign(b[:-1][on]), abs=1e-6 + blur)
        assert (np.abs(pull[:-1][~on]) <= 0.5 + 1e-6 + blur).all()


def test_full_run_scores_out_of_bag(table):
    run = ranking.full_run(table, CFG)
    held = {r["id"]: r for r in run.scored.select("id", "y", "bags", "x").collect()}
    m = run.models
    for r in run.scored.collect():
        h = held[r["id"]]
        x, flags = np.array(h["x"][:len(m.features)]), np.array(h["x"][len(m.features):])
        filled = np.tile(x, (4, 1))
        filled[:, list(m.missing)] += flags * m.fill  # every model fills in its own medians
        p = 1 / (1 + np.exp(-((filled * m.coef).sum(1) + m.intercept)))
        inside = np.array([h["y"] == 1 or b in h["bags"] for b in range(4)])
        want = p[~inside].mean() if (~inside).any() else p.mean()
        assert r["score"] == pytest.approx(want) and r["oob_models"] == (~inside).sum() and r["inbag_models"] == inside.sum()
    nominated = ranking.nominations(run, CFG, extra=["gene_id"])
    got = nominated.orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, N + 1))
    assert all(a["pu_score"] >= b["pu_score"] for a, b in zip(got, got[1:]))
    assert all((r["oob_models"] == 0) for r in got if r["label_status"] == "positive")
    told = ranking.explained(nominated, run, CFG).orderBy("rank").collect()
    assert len(told) == 5 and all(r["top_features"].count(";") == 2 for r in told)
    best = told[0]
    x, flags = (np.array(part) for part in np.split(np.array(held[best["gene"]]["x"]), [len(m.features)]))
    filled = np.tile(x, (4, 1))
    filled[:, list(m.missing)] += flags * m.fill
    values = (m.coef * (filled - m.mean)).mean(0)
    top = m.features[int(np.abs(values).argmax())]
    assert best["top_features"].startswith(f"{top}{'+' if values[np.abs(values).argmax()] >= 0 else '-'}")


def test_out_of_fold_recovers_the_signal_and_ablation_moves_it(table):
    configs = ranking.ablation_configs(CFG)
    scored = ranking.out_of_fold(table, configs)
    counts = {r["variant"]: r["count"] for r in scored.groupBy("variant").count().collect()}
    assert counts == {v: N for v in configs}
    tidy = ranking.ablation(table, configs)
    got = {(r["variant"], r["k"], r["metric"]): r["value"] for r in tidy.collect()}
    with_, without = got[("gwas_in", 50, "enrichment")], got[("gwas_out", 50, "enrichment")]
    assert with_ > 2 and with_ > without
    assert got[("label_immune", 50, "hits")] == got[("gwas_in", 50, "hits")]
    side = metrics.compare_variants(tidy, "enrichment", 50, ["gwas_in", "gwas_out"]).first()
    assert tuple(side) == (with_, without)


def test_tree_learner(table):
    cfg = CFG.having(learner="trees", n_bags=1, n_folds=2, n_estimators=3, max_depth=3, min_rows_per_leaf=2)
    scored = ranking.out_of_fold(table, {"trees": cfg}).cache()
    assert scored.count() == N and scored.filter("score is null").count() == 0
    r = metrics.at_top(scored, "score", "y", "id", [50]).first()
    assert r["enrichment"] > 1.5


def test_tree_attribution_adds_up(table):
    cfg = CFG.having(learner="trees", n_bags=2, n_estimators=3, max_depth=3, min_rows_per_leaf=2)
    run = ranking.full_run(table, cfg)
    rows_ = run.scored.select("id", "x").limit(20).cache()
    cols = features.feature_columns(cfg)
    told = boosting.forest_attribution(rows_, run.models, ["id"], "id")
    got = {r["id"]: {c["feature"]: c["value"] for c in r["contributions"]} for r in told.collect()}
    assert len(got) == 20 and all(set(v) == set(cols) for v in got.values())
    forest = run.models
    held = rows_.collect()
    x = np.array([[np.nan if v is None else v for v in r["x"]] for r in held])
    margin = boosting.margins(forest, boosting.binned(x, forest.edges), np.arange(2)).mean(1)
    base = sum(expected(forest, m, t, 0) for m in range(2) for t in range(3)) / 2
    for r, m in zip(held, margin):
        assert sum(got[r["id"]].values()) == pytest.approx(m - base, abs=1e-9)
    told = ranking.explained(ranking.nominations(run, cfg), run, cfg).collect()
    assert len(told) == 5 and all(r["driver"] and r["top_features"] for r in told)


def test_perfect_ranking(spark):
    df = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(zip([9.0, 8.0] + [1.0] * 8, [1, 1] + [0] * 8))], "id int, s double, y int")
    r = metrics.at_top(df, "s", "y", "id", [2]).first()
    assert r["recall"] == 1.0 and r["enrichment"] == pytest.approx(1 / 0.2)
    assert metrics.average_precision(df, "s", "y").first()[0] == 1.0


def test_metric_identities(spark):
    """Sizes and hits of the published primary run give its published rates."""
    df = spark.range(18692).select("id", (-F.col("id")).cast("double").alias("s"), F.when((F.col("id") < 15) | (F.col("id") >= 18692 - 346), 1).otherwise(0).alias("y"))
    r = metrics.at_top(df, "s", "y", "id", [100, 10**6]).orderBy("k").collect()
    assert r[0]["n_pos"] == 361 and r[0]["hits"] == 15
    assert r[0]["recall"] == pytest.approx(0.041551, abs=1e-6) and r[0]["enrichment"] == pytest.approx(7.766759, abs=1e-6)
    assert r[1]["recall"] == 1.0 and r[1]["enrichment"] == pytest.approx(1.0)  # k is capped at n


def test_average_precision_with_ties(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 15, 200) / 10, rng.integers(0, 2, 200)
    df = spark.createDataFrame([(int(i), float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))], "id int, s double, y int")
    want, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        take = s >= t
        recall = y[take].sum() / y.sum()
        want += (recall - last) * y[take].mean()
        last = recall
    assert metrics.average_precision(df, "s", "y").first()[0] == pytest.approx(want)
    curve = metrics.cumulative_hits(df, "s", "y", "id").orderBy("rank").collect()
    assert curve[-1]["hits"] == y.sum() and curve[-1]["rank"] == 200


def test_driver_tags(spark):
    def told(**values):
        items = [F.struct(F.lit(k).alias("feature"), F.lit(float(v)).alias("value")) for k, v in values.items()]
        return attribution.explain(spark.range(1).select(F.array(*items).alias("contributions"))).first()

    assert told(gwas_score=-1, mis_z_score=-2)["driver"] == "weak/mixed"
    assert told(gene_family_size=3, gwas_score=1)["driver"] == "family/druggability-driven"
    assert told(gwas_score=1, mis_z_score=1)["driver"] == "genetics+perturbseq-driven"
    assert told(mis_z_score=3, iei=1)["driver"] == "mixed"
    assert told(iei=0.5, gwas_score=-1.98765, mis_z_score=0.1, rest_se_beta=0.5)["top_features"] == "gwas_score-1.988; iei+0.500; rest_se_beta+0.500"


def test_unscored_row_raises(spark):
    rows_ = spark.createDataFrame([(1, 0, 1, 7, [], [], [1.0])], "id int, variant int, y int, fold int, bags array<int>, bags_times array<int>, x array<double>")
    m = bagging.LinearModels(["a"], bagging.Plan(1, 2, 0), np.ones((2, 1)), np.zeros(2), np.zeros((2, 1)))
    with pytest.raises(PySparkException, match="never in a scored fold"):
        bagging.score_linear(rows_, {0: m}).collect()


def test_a_pass_adds_up_rows_of_many_batches_at_once(spark):
    """The cost of a call, one loop over all models, does not come with every Arrow batch."""
    schema = "variant int, y int, fold int, bags array<int>, bags_times array<int>, x array<double>"
    rows = spark.createDataFrame([(i % 2, i % 3 == 0 and 1 or 0, -2, [0], [], [float(i)]) for i in range(1000)], schema).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = bagging._pass(rows, {v: np.array([-1, -1]) for v in (0, 1)}, lambda v, x, y, w: np.array([[1.0, len(x)]] * 2))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all((got[v] == [[1.0, 500.0]] * 2).all() for v in (0, 1))
