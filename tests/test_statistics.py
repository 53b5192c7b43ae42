"""Enrichment goldens, regression against least squares, rank tests, neighbours."""

import math
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import tails
from evidentia.operators import contingency, nearest, regression, sets
from evidentia.plans import burden, polarization
from evidentia.plans import enrichment as enrichment_plan

# Published values: cells, odds ratio, interval, one-sided p.
GOLDEN = [
    (72, 433, 651, 19127, 4.885516331243814, 3.7617180962500982, 6.34504479393161, 4.202060459278409e-24, "72 / 505 = 14.3%", "4.3× (OR 4.9, 3.8–6.3)", "4e-24"),
    (63, 383, 369, 12042, 5.368018849901293, 4.033201447455587, 7.144603796340104, 8.279720050172099e-23, "63 / 446 = 14.1%", "4.8× (OR 5.4, 4.0–7.1)", "8e-23"),
    (57, 330, 291, 8879, 5.270259293970634, 3.8870838752961028, 7.145622249678881, 3.2493710446383256e-20, "57 / 387 = 14.7%", "4.6× (OR 5.3, 3.9–7.1)", "3e-20"),
    (65, 146, 558, 3694, 2.94729218834389, 2.1714029706002265, 4.000423394959138, 7.847064761092213e-11, "65 / 211 = 30.8%", "2.3× (OR 2.9, 2.2–4.0)", "8e-11"),
    (56, 122, 282, 1912, 3.1121962562492733, 2.2147767751477136, 4.37324684189268, 6.792439079028276e-10, "56 / 178 = 31.5%", "2.4× (OR 3.1, 2.2–4.4)", "7e-10"),
]


def test_enrichment_goldens(spark):
    cells = spark.createDataFrame([(f"u{i}", *g[:4]) for i, g in enumerate(GOLDEN)], "universe string, a long, b long, c long, d long")
    result = contingency.exact_p(contingency.odds_and_rates(cells)).orderBy("universe")
    for r, g in zip(result.collect(), GOLDEN):
        assert (r["OR"], r["OR_lo"], r["OR_hi"]) == pytest.approx(g[4:7], rel=1e-12)
        assert r["p"] == pytest.approx(g[7], rel=1e-9)
    text = contingency.readable(result).orderBy("comparison_group").collect()
    assert [(r["panel_rate"], r["fold_text"], r["p_text"]) for r in text] == [g[8:] for g in GOLDEN]


def test_enrichment_plan_from_member_lists(spark):
    def listed(prefix, n, start=0):
        return spark.range(start, start + n).select(F.concat(F.lit(prefix), "id").alias("g"))

    genes = listed("g", 1000)
    panel, target = listed("g", 40), listed("g", 60, 20)
    druggable = listed("g", 300)
    expression = genes.select(
        F.concat(F.lit("E"), "g").alias("gene"), F.col("g").alias("gene_name"),
        F.when(F.substring("g", -1, 1) < "5", 7.0).otherwise(0.5).alias("ntpm"))
    result, text, compared = enrichment_plan.build(panel, target, druggable, expression)
    first = result.filter(F.col("universe") == enrichment_plan.UNIVERSES[0]).first()
    assert (first["a"], first["b"], first["c"], first["d"]) == (20, 20, 40, 920)
    fifth = {r["universe"]: r["N"] for r in result.collect()}
    assert fifth[enrichment_plan.UNIVERSES[1]] == 500 and fifth[enrichment_plan.UNIVERSES[4]] == 150
    assert text.count() == 5 and [r["position"] for r in compared.orderBy("position").collect()] == [1, 2, 3]


def test_zero_cells(spark):
    cells = spark.createDataFrame([("z", 3, 0, 0, 5)], "universe string, a long, b long, c long, d long")
    r = contingency.odds_and_rates(cells).first()
    assert math.isinf(r["RR"]) and math.isinf(r["OR"]) and r["OR_lo"] is None


def _exact(a, b, c, d, two_sided):
    """Exact integer arithmetic over the whole support."""
    row, col, n = a + b, a + c, a + b + c + d
    ways = {k: math.comb(row, k) * math.comb(n - row, col - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
    total = math.comb(n, col)
    if two_sided:
        return sum(w for w in ways.values() if w <= ways[a] * (1 + 1e-7)) / total
    return sum(w for k, w in ways.items() if k >= a) / total


@pytest.mark.parametrize("cells", [(6, 19, 1, 49), (5, 20, 0, 50), (0, 5, 5, 0), (3, 3, 3, 3), (1, 9, 11, 3), (40, 2, 5, 300), (2, 300, 40, 5), (0, 0, 4, 4)])
def test_fisher_against_integers(cells):
    assert tails.fisher_p(*cells, "two-sided") == pytest.approx(_exact(*cells, True), rel=1e-9)
    assert tails.fisher_p(*cells, "greater") == pytest.approx(_exact(*cells, False), rel=1e-9)


def test_fisher_on_large_counts():
    assert tails.fisher_p(10**8, 10**8, 10**8, 10**8, "two-sided") == pytest.approx(1.0)
    assert 0.0 <= tails.fisher_p(100_040_000, 99_960_000, 99_960_000, 100_040_000, "greater") < 1e-10


def test_student_t_tail():
    x = np.array([10 / 14.0, 2997 / 4597.0, 1.0])
    got = tails.incomplete_beta(x, np.array([5.0, 1498.5, 4.0]), np.full(3, 0.5))
    assert got[0] == pytest.approx(0.07338803477074, rel=1e-9)
    assert got[1] == pytest.approx(9.76e-281, rel=1e-2) and got[2] == 1.0


def _least_squares(x, y, w):
    z = lambda v: (v - v.mean()) / v.std(ddof=1)
    design = np.column_stack([z(x), w, np.ones(len(x))])
    coef, *_ = np.linalg.lstsq(design, z(y), rcond=None)
    res = z(y) - design @ coef
    se = math.sqrt(res @ res / (len(x) - 3) * np.linalg.inv(design.T @ design)[0, 0])
    return coef[0], se


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(0)
    n = 900
    y, w = rng.normal(0, 0.1, n), rng.uniform(0, 0.1, n)
    cols = np.column_stack([
        0.8 * (y - y.mean()) + rng.normal(0, 0.05, n), rng.normal(0, 0.3, n), np.full(n, 2.0), 1e4 + rng.normal(0, 1, n),
    ]).astype(np.float32)
    cols[5, 1] = np.nan
    y[7] = np.nan
    data = [(i, "Rest" if i % 3 else "Stim8hr", [float(v) for v in cols[i]], i % 4 if i < 40 else None, [i % 4] if i < 40 else None if i % 2 else [],
             None if math.isnan(y[i]) else float(y[i]), float(w[i])) for i in range(n)]
    df = spark.createDataFrame(data, "id int, condition string, values array<float>, own_col int, own_cols array<int>, y double, w double")
    return df.repartition(6), cols.astype(float), y, w


def test_matrix_scan_equals_least_squares(spark, matrix):
    df, cols, y, w = matrix
    got = {(r["condition"], r["col_id"]): r for r in regression.scan_matrix(df, 50).collect()}
    for cond in ("Rest", "Stim8hr"):
        for j in (0, 1, 3):
            keep = np.array([(("Rest" if i % 3 else "Stim8hr") == cond) and not (i < 40 and i % 4 == j) for i in range(len(y))])
            keep &= np.isfinite(cols[:, j]) & np.isfinite(y)
            coef, se = _least_squares(cols[keep, j], y[keep], w[keep])
            r = got[(cond, j)]
            assert r["n_reg"] == keep.sum()
            assert (r["coef_beta"], r["se_beta"]) == pytest.approx((coef, se), rel=1e-7)
        assert got[(cond, 2)]["coef_beta"] is None  # a constant column has no slope


def test_long_scan_equals_matrix_scan(matrix):
    df, *_ = matrix
    cells = df.select("condition", "own_col", "y", "w", F.posexplode("values").alias("col_id", "x"))
    long = regression.scan_columns(cells, ["condition", "col_id"], "x", "y", "w", "own_col", "col_id", 50)
    want = {(r[0], r[1]): r for r in regression.scan_matrix(df, 50).collect()}
    got = long.collect()
    assert len(got) == len(want) == 8
    for r in got:
        m = want[(r[0], r[1])]
        assert r["n_reg"] == m["n_reg"]
        if m["coef_beta"] is not None:
            assert (r["coef_beta"], r["se_beta"]) == pytest.approx((m["coef_beta"], m["se_beta"]), rel=1e-7)


def test_every_own_column_is_left_out(spark, matrix):
    df, *_ = matrix
    two = df.withColumn("own_cols", F.when(F.col("id") < 40, F.array(F.lit(0), F.lit(3))))
    got = {(r["condition"], r["col_id"]): r["n_reg"] for r in regression.scan_matrix(two, 50).collect()}
    none = {(r["condition"], r["col_id"]): r["n_reg"] for r in regression.scan_matrix(df.withColumn("own_cols", F.lit(None).cast("array<int>")), 50).collect()}
    gone = {"Rest": 26 - 1, "Stim8hr": 14}  # row 7 has no y
    assert {k: none[k] - got[k] for k in none} == {(c, j): gone[c] if j in (0, 3) else 0 for c in gone for j in range(4)}


def test_planted_signal(spark, matrix):
    df, *_ = matrix
    cols = spark.createDataFrame([(0, "ES", "SIGNAL"), (1, "EN", "NULL"), (2, "EC", "CONST"), (3, "EF", "FLAT")], "col_id int, gene_ids string, gene_name string")
    scored = {(r["condition"], r["gene"]): r for r in burden.score(df, cols, 50).collect()}
    assert scored[("Rest", "SIGNAL")]["p_beta"] < 1e-10 and scored[("Rest", "SIGNAL")]["coef_beta"] > 0
    assert scored[("Rest", "NULL")]["p_beta"] > 0.05 and scored[("Rest", "SIGNAL")]["rank"] == 1
    assert regression.scan_matrix(df, 100_000).count() == 0


def test_scan_inputs_follow_mapping_rules(spark):
    rows = spark.createDataFrame([("Rest", "symA", [1.0, 2.0]), ("Rest", "symB", [3.0, 4.0])], "culture_condition string, target_contrast_gene_name string, values array<float>")
    cols = spark.createDataFrame([(0, "E2", "symA"), (1, "symB", "symB"), (2, "E2", "symC")], "col_id int, gene_ids string, gene_name string")
    gamma = spark.createDataFrame([(1, "E2", float("inf")), (2, "E2", 5.0), (3, "x", 2.0), (4, "y", -1.0)], "row_id int, ensg string, post_mean double")
    shet = spark.createDataFrame([(1, "E2", 0.3)], "row_id int, ensg string, shet double")
    gmap = spark.createDataFrame([(1, "symA", "E1"), (2, "symA", "E2")], "row_id int, symbol string, ensg string")
    got = {r["entity"]: r for r in burden.scan_inputs(rows, cols, gamma, shet, gmap).collect()}
    assert (got["E2"]["y"], got["E2"]["w"], sorted(got["E2"]["own_cols"])) == (2.0, 0.3, [0, 2])
    assert (got["symB"]["y"], got["symB"]["own_cols"]) == (None, [1])


def test_rank_sum(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(0, 1, 120), 1)
    g = rng.integers(0, 2, 120)
    v[g == 1] += 0.3
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, g)], "v double, g int")
    r = regression.rank_sum(df, "v", "g").first()
    u = sum((a > b) + 0.5 * (a == b) for a in v[g == 1] for b in v[g == 0])
    assert r["u"] == pytest.approx(u)
    n1, n0 = int((g == 1).sum()), int((g == 0).sum())
    _, t = np.unique(v, return_counts=True)
    sd = math.sqrt(n1 * n0 / 12 * (121 - (t**3 - t).sum() / (120 * 119)))
    z = (u - n1 * n0 / 2 - 0.5) / sd
    assert (r["z"], r["p"]) == pytest.approx((z, 0.5 * math.erfc(z / math.sqrt(2))))


@pytest.mark.parametrize("n1,n0", [(3, 5), (6, 2), (1, 7), (4, 4)])
def test_rank_sum_exact_for_small_samples(spark, n1, n0):
    from itertools import combinations

    rng = np.random.default_rng(n1 * 10 + n0)
    v = rng.permutation(n1 + n0).astype(float)
    df = spark.createDataFrame([(float(x), int(i < n1)) for i, x in enumerate(v)], "v double, g int")
    r = regression.rank_sum(df, "v", "g").first()

    def u_of(chosen):
        return sum(a > b for a in chosen for b in range(n1 + n0) if b not in chosen)

    every = [u_of(set(c)) for c in combinations(range(n1 + n0), n1)]
    assert r["p"] == pytest.approx(sum(u >= r["u"] for u in every) / len(every), rel=1e-12)


def test_polarization_edges(spark):
    data = [
        (1, "a", "Stim8hr", "ota", 2.0, 1.0, True, "Th2 regulator"), (2, "a", "Stim48hr", "ota", 4.0, 2.0, True, None),
        (3, "a", "Rest", "ota", None, 1.0, True, None), (4, "a", "Stim8hr", "ota", 9.0, 1.0, True, None),
        (5, "b", "Stim8hr", "ota", 0.0, 1.0, False, None), (6, "b", "Stim48hr", "ota", 0.0, 1.0, False, None),
        (7, "c", "Stim8hr", "ota", 1.0, 1.0, False, None), (8, "d", "Stim8hr", "other", 1.0, 1.0, False, None),
        (9, "e", "Stim8hr", "ota", 1.0, 0.0, None, None), (10, "e", "Stim48hr", "ota", -1.0, 1.0, None, None),
    ]
    df = spark.createDataFrame(data, "row_id int, regulator string, celltype string, signature string, coef_mean double, coef_sem double, known_regulators boolean, regulator_type string")
    got = {r["gene"]: r for r in polarization.score(polarization.condition_z(df)).collect()}
    assert set(got) == {"a", "b", "e"}
    assert got["a"]["polarization_score"] == pytest.approx(4 / math.sqrt(2)) and got["a"]["regulator_type"] == "Th2 regulator"
    assert got["b"]["direction"] == "toward_signature_neg" and got["b"]["signs_agree"] is True
    assert got["e"]["polarization_score"] is None and got["e"]["signs_agree"] is False and got["e"]["rank"] == 3


@pytest.fixture(scope="module")
def signature_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 2, (60, 12)).astype(np.float32)
    x[7] = x[3]  # an exact tie between two anchors
    data = [(i, f"g{i}", [float(v) for v in x[i]], i % 12, int(i % 4 == 3)) for i in range(60)]
    data.append((99, "g0", [9.0] * 12, 0, 0))  # a later copy that must be ignored
    return spark.createDataFrame(data, "row_id long, gene string, values array<float>, own_col int, anchor int"), x


@pytest.mark.parametrize("limit", [1 << 30, 12 * 8 * 4])
def test_nearest_anchor_against_brute_force(signature_rows, limit):
    df, x = signature_rows
    z = x.astype(float).copy()
    z[np.arange(60), np.arange(60) % 12] = 0.0
    unit = z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-12)
    sig = nearest.signatures(df.repartition(4), "gene", "values", "row_id", "own_col")
    got = {r["gene"]: r for r in nearest.nearest_anchor(sig, "gene", "anchor", "row_id", limit).collect()}
    assert len(got) == 60
    anchors = [i for i in range(60) if i % 4 == 3]
    for i in range(60):
        others = [j for j in anchors if j != i]
        cos = unit[others] @ unit[i]
        assert got[f"g{i}"]["best"] == pytest.approx(cos.max())
        assert unit[int(got[f"g{i}"]["nearest"][1:])] @ unit[i] == pytest.approx(cos.max())
        assert got[f"g{i}"]["breadth"] == int((np.abs(z[i]) > 3).sum())


def test_many_small_anchor_blocks_send_rows_once_per_shard(spark):
    """Blocks of one anchor: 3,000 rows and 1,000 anchors used to be sent 1,000 and 3,000 times."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 8))
    data = [(i, [float(v) for v in x[i]], int(i % 3 == 0)) for i in range(3000)]
    df = spark.createDataFrame(data, "row_id long, values array<double>, anchor int")
    began = time.monotonic()
    found = nearest.nearest_anchor(nearest.signatures(df, "row_id", "values", "row_id"), "row_id", "anchor", "row_id", 8 * 8)
    got = {r["row_id"]: r for r in found.select("row_id", "best", "nearest").collect()}
    assert time.monotonic() - began < 60
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit[::3].T
    sim[np.arange(0, 3000, 3), np.arange(1000)] = -np.inf
    assert [got[i]["nearest"] for i in range(3000)] == list(3 * sim.argmax(1))
    assert [got[i]["best"] for i in range(3000)] == pytest.approx(list(sim.max(1)))


def test_products_held_at_once_do_not_grow_with_rows():
    rng = np.random.default_rng(7)
    x, anchors = rng.normal(size=(40_000, 4)), rng.normal(size=(3000, 4))
    tracemalloc.start()
    best, at = nearest._best(np.full(40_000, -1), x, anchors, 2048)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    some = np.arange(0, 40_000, 997)
    assert (at[some] == (x[some] @ anchors.T).argmax(1)).all() and best[some] == pytest.approx((x[some] @ anchors.T).max(1))


def test_copies_of_an_anchor_give_way_to_the_first():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 31))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    anchors = np.tile(x[:40], (9, 1))
    for width in (1, 7, 64, 2048):
        _, at = nearest._best(np.full(500, -1), x, anchors, width)
        assert (at == (x @ x[:40].T).argmax(1)).all()


def test_single_anchor_has_no_neighbour(signature_rows):
    df, _ = signature_rows
    one = df.withColumn("anchor", (F.col("gene") == "g3").cast("int"))
    got = {r["gene"]: r for r in nearest.nearest_anchor(nearest.signatures(one, "gene", "values", "row_id"), "gene", "anchor", "row_id").collect()}
    assert got["g3"]["best"] is None and got["g3"]["nearest"] is None and got["g5"]["nearest"] == "g3"


def test_principal_components_match_svd(signature_rows):
    df, _ = signature_rows
    sig = nearest.signatures(df, "gene", "values", "row_id", "own_col")
    pcs, fitted = nearest.principal_components(sig, "gene", 3)
    shares = list(fitted.variances / fitted.total_variance)
    unit = np.array([r["unit"] for r in sig.collect()])
    s = np.linalg.svd(unit - unit.mean(0), compute_uv=False) ** 2
    assert shares == pytest.approx(list(s[:3] / s.sum()), rel=1e-6)
    spread = pcs.agg(F.var_samp("pc1")).first()[0]
    assert spread == pytest.approx(s[0] / (len(unit) - 1), rel=1e-6)


def test_overlap_golden(spark):
    """Counts published for the two reference lists, rebuilt from their sizes."""
    left = spark.range(505).select(F.col("id").cast("string").alias("g"))
    right = spark.range(433, 433 + 723).select(F.col("id").cast("string").alias("g"))
    got = {r["metric"]: r["value"] for r in sets.overlap_report(sets.membership({"l": left, "r": right}), "l", "r").collect()}
    assert got == {"left": 505, "right": 723, "both": 72, "only_left": 433, "only_right": 651, "union": 1156,
                   "pct_left_in_right": 14.3, "pct_right_in_left": 10.0, "jaccard_pct": 6.2}
