"""Boosted trees: against one plain tree per bag, at several block sizes, and exact Shapley values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import boosting
from evidentia.operators.boosting import Forest, TreeSettings
from evidentia.operators.bagging import Plan

NAMES = ["a", "b", "c", "d"]


def training(spark, seed, n=240, folds=3, models=6, parts=4, variants=(0,)):
    rng = np.random.default_rng(seed)
    data = []
    for v in variants:
        for i in range(n):
            y = int(i % 4 == 0)
            x = [float(rng.normal() + y), float(rng.integers(0, 3)), float(rng.normal()) if rng.random() < 0.7 else None, float(rng.normal() - y)]
            fold = i % folds
            bags = [] if y else sorted(int(m) for m in range(models) if m // (models // folds) != fold and rng.random() < 0.4)
            times = [int(rng.integers(1, 3)) for _ in bags] if i % 2 else []
            data.append((f"r{v}-{i}", v, y, fold, bags, times, x))
    schema = "id string, variant int, y int, fold int, bags array<int>, bags_times array<int>, x array<double>"
    return spark.createDataFrame(data, schema).repartition(parts), data


def plain(rows, m, plan, settings, edges):
    """One bag's trees, node by node and without any sampling."""
    held = plan.held_out_array()
    mine = [(r, (r[5][r[4].index(m)] if r[5] else 1) if m in r[4] else int(r[2] == 1 and r[3] != held[m])) for r in rows]
    mine = [(r, w) for r, w in mine if w]
    x = np.array([[np.nan if c is None else c for c in r[6]] for r, _ in mine])
    bins = boosting.binned(x, edges)
    y, w = np.array([r[2] for r, _ in mine], float), np.array([w for _, w in mine], float)
    margin, trees = np.zeros(len(y)), []
    for _ in range(settings.n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        tree, todo = {}, [(0, np.arange(len(y)), 0)]
        while todo:
            node, at, depth = todo.pop()
            tree[node] = [-1, 0, -settings.step * g[at].sum() / h[at].sum(), w[at].sum()]
            best = (1e-10, None)
            for f in range(x.shape[1]) if depth < settings.max_depth else []:
                for b in range(settings.n_bins):
                    left = at[bins[at, f] <= b]
                    right = at[bins[at, f] > b]
                    if w[left].sum() < settings.min_rows or w[right].sum() < settings.min_rows or min(h[left].sum(), h[right].sum()) <= 1e-3:
                        continue
                    gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[at].sum() ** 2 / h[at].sum()
                    if np.float32(gain) > np.float32(best[0]):
                        best = (gain, (f, b, left, right))
            if best[1]:
                f, b, left, right = best[1]
                tree[node][:2] = f, b
                todo += [(2 * node + 1, left, depth + 1), (2 * node + 2, right, depth + 1)]
            else:
                margin[at] += tree[node][2]
        trees.append(tree)
    return trees


def fitted(df, plan, settings, block_rows=boosting.BLOCK, variants=(0,)):
    return boosting.fit_forests(df, {v: NAMES for v in variants}, plan, settings, block_rows)


@pytest.mark.parametrize("block_rows", [boosting.BLOCK, 40])
def test_equals_plain_trees(spark, block_rows):
    plan, settings = Plan(2, 3, 5), TreeSettings(2, 3, 0.3, 1.0, 1.0, 4, 8, 5)
    df, data = training(spark, 1)
    forest = fitted(df, plan, settings, block_rows)[0]
    for m in range(plan.n_models):
        for t, tree in enumerate(plain(data, m, plan, settings, forest.edges)):
            for node, (f, b, value, cover) in tree.items():
                assert forest.feature[m, t, node] == f and forest.value[m, t, node] == pytest.approx(value, abs=1e-9)
                assert forest.cover[m, t, node] == cover and (f < 0 or forest.split[m, t, node] == b)
            assert set(np.flatnonzero(forest.cover[m, t])) == set(tree)


def test_blocks_and_partitions_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REWRITE", 2)
    plan = Plan(2, 3, 5)
    settings = TreeSettings(5, 3, 0.2, 0.7, 0.6, 3, 16, 9)
    df, _ = training(spark, 2, variants=(0, 3))
    want = fitted(df, plan, settings, variants=(0, 3))
    for other in (fitted(df.repartition(1), plan, settings, variants=(0, 3)), fitted(df.repartition(7), plan, settings, 30, (0, 3))):
        for v in (0, 3):
            assert (want[v].feature == other[v].feature).all() and (want[v].split == other[v].split).all()
            assert np.allclose(want[v].value, other[v].value, atol=1e-12) and (want[v].cover == other[v].cover).all()
    used = {tuple(sorted(set(want[0].feature[m, t]) - {-1})) for m in range(6) for t in range(settings.n_trees)}
    assert len(used) > 1 and all(len(u) <= 3 for u in used)  # a tree sees three of four columns


def test_scores_follow_the_rules_of_bags(spark):
    plan, settings = Plan(4, None, 1), TreeSettings(5, 2, 0.3, 1.0, 1.0, 3, 16, 1)
    df, data = training(spark, 3, folds=1, models=4)
    df = df.withColumn("fold", F.lit(-2))
    forest = fitted(df, plan, settings)[0]
    x = np.array([[np.nan if c is None else c for c in r[6]] for r in data])
    prob = 1 / (1 + np.exp(-boosting.margins(forest, boosting.binned(x, forest.edges), np.arange(4))))
    got = {r["id"]: r for r in boosting.score_forests(df, {0: forest}).collect()}
    for r, p in zip(data, prob):
        inside = np.array([r[2] == 1 or m in r[4] for m in range(4)])
        use = ~inside if not inside.all() else np.ones(4, bool)
        assert got[r[0]]["score"] == pytest.approx(p[use].mean()) and got[r[0]]["inbag_models"] == inside.sum()


def test_no_rows_and_one_class(spark):
    plan, settings = Plan(1, 2, 1), TreeSettings(2, 2, 0.3, 1.0, 1.0, 1, 8, 1)
    df, _ = training(spark, 4, folds=2, models=2)
    none = fitted(df.where("false"), plan, settings)[0]
    assert (none.feature == -1).all() and (none.value == 0).all()
    alone = fitted(df.where("y = 1"), plan, settings)[0]
    assert np.isfinite(alone.value).all()


def test_a_bag_of_many_rows_takes_no_pass_per_level(spark, monkeypatch):
    """A bag of more than 65,536 rows used to cost Spark jobs for every level of every tree."""
    n = 70_000
    x = F.array(F.rand(1), F.floor(F.rand(2) * 3).cast("double"), F.when(F.rand(3) < 0.1, F.rand(4)).otherwise(0.0), F.col("y") + F.rand(5))
    none = F.array().cast("array<int>")
    rows = spark.range(n).select(F.col("id").cast("string"), F.lit(0).alias("variant"), (F.col("id") % 2).cast("int").alias("y"), F.lit(-2).alias("fold"))
    df = rows.withColumns({"bags": F.when(F.col("y") == 0, F.array(F.lit(0))).otherwise(none), "bags_times": none, "x": x}).checkpoint()
    plan, settings = Plan(1, None, 1), TreeSettings(2, 3, 0.3, 0.8, 1.0, 50, 16, 1)
    divided = fitted(df, plan, settings, 20_000)[0]
    monkeypatch.setattr(boosting, "_fit_divided", None)
    whole = fitted(df, plan, settings)[0]
    assert (whole.feature == divided.feature).all() and (whole.split == divided.split).all() and (whole.cover == divided.cover).all()
    assert np.allclose(whole.value, divided.value, atol=1e-12) and whole.cover[0, :, 0].min() > 50_000


def test_sums_with_a_common_bin(monkeypatch):
    """Features that mostly have one bin are added up over their other rows alone."""
    monkeypatch.setattr(boosting, "STRIDE", 300)
    rng = np.random.default_rng(6)
    n, models, settings = 1000, 2, TreeSettings(1, 2, 0.3, 1.0, 1.0, 1, 8, 1)
    bins = np.stack([rng.integers(0, 8, n), np.where(rng.random(n) < 0.05, rng.integers(0, 8, n), 3), np.full(n, 5)]).astype(np.uint8)
    block = boosting.Block(settings, np.arange(models), bins, rng.integers(0, models, n), rng.integers(0, 2, n).astype(float),
                           rng.integers(0, 2**60, n).astype(np.uint64), rng.integers(1, 3, n).astype(float))
    block.margin = rng.normal(size=n)
    block.start(0)
    block.node = rng.integers(0, 3, n)
    assert block.common == [-1, 3, 5] and sum(map(len, (at for part in block.listed for at, _ in part[1:]))) < 100
    p = 1 / (1 + np.exp(-block.margin))
    measures = block.weight * (p - block.y), block.weight * p * (1 - p), block.weight
    want = np.zeros((models, 2, 3, 3, 8))
    for i in np.flatnonzero(block.node >= 1):
        for k, j in itertools.product(range(3), range(3)):
            want[block.model[i], block.node[i] - 1, k, j, bins[j, i]] += measures[k][i]
    got = block.sums(1)
    assert np.allclose(got, want, atol=1e-12) and (got[:, :, 2] == want[:, :, 2]).all()


def expected(forest, m, t, node):
    """Mean leaf value by the rows that grew the tree."""
    if forest.feature[m, t, node] < 0:
        return forest.value[m, t, node]
    parts = [(forest.cover[m, t, c], expected(forest, m, t, c)) for c in (2 * node + 1, 2 * node + 2)]
    return sum(c * v for c, v in parts) / sum(c for c, _ in parts)


def known(forest, m, t, node, row, subset):
    """The tree's value when only the features of ``subset`` are known."""
    f = forest.feature[m, t, node]
    if f < 0:
        return forest.value[m, t, node]
    left, right = 2 * node + 1, 2 * node + 2
    if f in subset:
        return known(forest, m, t, left if row[f] <= forest.split[m, t, node] else right, row, subset)
    a, b = forest.cover[m, t, left], forest.cover[m, t, right]
    return (a * known(forest, m, t, left, row, subset) + b * known(forest, m, t, right, row, subset)) / (a + b)


def test_shapley_values_by_all_subsets(spark):
    plan, settings = Plan(2, None, 1), TreeSettings(3, 4, 0.3, 0.8, 1.0, 3, 16, 1)
    df, data = training(spark, 5, folds=1, models=2)
    forest = fitted(df.withColumn("fold", F.lit(-2)), plan, settings)[0]
    x = np.array([[np.nan if c is None else c for c in r[6]] for r in data[:12]])
    bins = boosting.binned(x, forest.edges)
    got = boosting.shapley(forest, bins, [0, 1])
    for i, row in enumerate(bins):
        for j in range(4):
            want = 0.0
            others = [f for f in range(4) if f != j]
            for m, t in itertools.product(range(2), range(3)):
                for size in range(4):
                    weight = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    for s in itertools.combinations(others, size):
                        want += weight * (known(forest, m, t, 0, row, {*s, j}) - known(forest, m, t, 0, row, set(s)))
            assert got[i, j] == pytest.approx(want, abs=1e-10)


def test_nodes_as_a_table(spark):
    plan = Plan(1, None, 1)
    feature = np.array([[[0, 1, -1, -1, -1, -1, -1]]], dtype=np.int16)
    split = np.array([[[1, 0, 0, 0, 0, 0, 0]]], dtype=np.uint8)
    value, cover = np.arange(7.0).reshape(1, 1, 7), np.array([[[10, 6, 4, 1, 5, 0, 0.0]]])
    forest = Forest(["a", "b"], plan, [np.array([1.5, 2.0]), np.array([0.0])], feature, split, value, cover)
    got = {r["node"]: (r["feature"], r["threshold"], r["value"]) for r in boosting.forest_nodes(spark, forest).collect()}
    assert got == {0: ("a", 1.5, 0.0), 1: ("b", float("-inf"), 1.0), 2: (None, None, 2.0), 3: (None, None, 3.0), 4: (None, None, 4.0)}
