"""Every registered query with a SQL statement, beside DuckDB, on the smallest tables."""

import os

import pytest

from evidentia.registry import load, modelling
from tools.compare import compare, oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    state, _, note = compare(name, QUERIES[name](spark, SF), con, SQL[name])
    assert state == "ok", note


def test_every_query_is_known():
    assert set(SQL) <= set(QUERIES)
    assert {"pu_ablation", "pu_tree_ablation", "pu_out_of_fold", "pu_nominations", "pu_attribution", "signature_pca"} <= set(QUERIES) - set(SQL)


def test_candidates_grow_with_the_table(spark, con):
    """Every usable vector is searched, beyond the 400 keys and 40 anchors of nearest_candidates."""
    one = QUERIES["nearest_candidates_per_vector"](spark, "/root/testdata/sf0.1")
    ((n,),) = con.sql(
        "SELECT count(*) FROM '/root/testdata/sf0.1/embeddings.parquet' "
        "WHERE label % 2 = 0 AND embedding[1] > embedding[2] AND floor(abs(embedding[3]::DOUBLE) * 2000) >= 50").fetchall()
    got = one.selectExpr("count(*)", "count_if(is_fda_target = 1)", "count(knn_max_score)").first()
    assert got[0] == got[2] == n > 400 and got[1] > 40


def test_tree_ablation_grows_every_tree_and_bag(monkeypatch):
    """It used to grow 20 of the 200 published trees and 10 of the 40 bags."""
    asked = []
    monkeypatch.setattr(modelling, "entities", lambda spark, sf: None)
    monkeypatch.setattr(modelling, "shaped", lambda found: found)
    monkeypatch.setattr(modelling.ranking, "ablation", lambda df, configs: asked.append(configs))
    QUERIES["pu_tree_ablation"](None, "")
    assert {c.learner for c in asked[0].values()} == {"trees"} and len(asked[0]) == 8
    assert {(c.n_estimators, c.n_bags, c.n_folds) for c in asked[0].values()} == {(200, 40, 5)}
