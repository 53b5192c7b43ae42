"""Ranks, FDR, quantiles: both execution paths against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import ordering
from tests.conftest import rows


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(7)
    data = []
    for i in range(400):
        # One group holds most rows and one value most of that group.
        g = "hot" if i % 4 else rng.choice(["b", "c", None])
        v = 1.0 if g == "hot" and i % 3 else round(rng.random(), 2)
        data.append((i, g, None if i % 29 == 0 else v))
    return spark.createDataFrame(data, "id int, g string, v double").repartition(5).cache()


def _groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], []).append(r)
    return out


def _check_all(df):
    ranked = ordering.row_rank(df, [("v", "desc"), ("id", "asc")], ["g"])
    for rs in _groups(ranked).values():
        want = sorted(rs, key=lambda r: (r["v"] is None, -(r["v"] or 0), r["id"]))
        assert [r["rank"] for r in want] == list(range(1, len(rs) + 1))
    whole = ordering.row_rank(df, [("v", "desc"), ("id", "asc")])
    want = sorted(whole.collect(), key=lambda r: (r["v"] is None, -(r["v"] or 0), r["id"]))
    assert [r["rank"] for r in want] == list(range(1, 401))

    avg = ordering.average_rank(df, "v", ["g"], "r")
    for rs in _groups(avg).values():
        vals = [r["v"] for r in rs if r["v"] is not None]
        for r in rs:
            if r["v"] is None:
                assert r["r"] is None
            else:
                above, same = sum(x > r["v"] for x in vals), sum(x == r["v"] for x in vals)
                assert r["r"] == int(above + (same + 1) / 2)

    fdr = ordering.benjamini_hochberg(df, "v", ["g"])
    assert fdr.count() == 400
    for rs in _groups(fdr).values():
        known = sorted((r for r in rs if r["v"] is not None), key=lambda r: r["v"])
        m, best = len(known), 1.0
        want = {}
        for i in range(m, 0, -1):
            best = min(best, known[i - 1]["v"] * m / i)
            want[known[i - 1]["id"]] = best
        for r in known:
            same = min(want[k["id"]] for k in known if k["v"] == r["v"])
            assert r["fdr"] == pytest.approx(max(same, 1e-300), rel=1e-12)

    q = ordering.quantiles(df, "v", {"lo": 0.1, "mid": 0.5, "hi": 0.93}, ["g"])
    by = _groups(df)
    for r in q.collect():
        vals = np.array([x["v"] for x in by[r["g"]] if x["v"] is not None])
        assert [r["lo"], r["mid"], r["hi"]] == pytest.approx(list(np.quantile(vals, [0.1, 0.5, 0.93])))


def test_scans_against_brute_force(sample):
    _check_all(sample)


def test_many_slices(spark, sample, monkeypatch):
    monkeypatch.setattr(ordering, "partition_count", lambda df: 9)
    _check_all(sample)


def test_partitioning_does_not_matter(sample):
    for op in (
        lambda d: ordering.benjamini_hochberg(d, "v", ["g"]),
        lambda d: ordering.seeded_sample(d, "id", 20, 5),
        lambda d: ordering.qq_points(d, "v", "id", ["g"]),
    ):
        assert rows(op(sample.repartition(1))) == rows(op(sample.repartition(17)))


def test_qq_points(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "id int, v double")
    got = {r["id"]: r["expected"] for r in ordering.qq_points(df, "v", "id").collect()}
    assert got[0] == pytest.approx(math.log10(1 - 2 * 0.375 + 1e-300))
    assert got[3] == pytest.approx(-got[0])


def test_sample_is_without_replacement(sample):
    ids = [r["id"] for r in ordering.seeded_sample(sample, "id", 50, "s").collect()]
    assert len(set(ids)) == 50
    other = [r["id"] for r in ordering.seeded_sample(sample, "id", 50, "t").collect()]
    assert set(ids) != set(other)


def test_top_rows(sample):
    top = ordering.top_rows(sample, [("v", "desc"), ("id", "asc")], 3).collect()
    want = sorted(sample.collect(), key=lambda r: (r["v"] is None, -(r["v"] or 0), r["id"]))[:3]
    assert [r["id"] for r in top] == [r["id"] for r in want]
    assert sample.filter(F.col("v").isNull()).count() == 14


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_are_exact(spark, by):
    rng = np.random.default_rng(4)
    data = [("a", float(v)) for v in rng.normal(0, 1, 900)] + [("a", 0.25)] * 400
    data += [("b", float(v)) for v in rng.integers(0, 5, 50)] + [(None, 7.0), ("c", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    probs = {"lo": 0.02, "mid": 0.5, "up": 0.77, "top": 1.0}
    got = ordering.quantiles(df, "v", probs, by).collect()
    assert len(got) == (3 if by else 1)
    for r in got:
        vals = [v for g, v in data if v is not None and (not by or g == r["g"])]
        assert [r[n] for n in probs] == pytest.approx(list(np.quantile(vals, list(probs.values()))), abs=1e-12)
