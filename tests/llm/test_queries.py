"""The registered corpus queries beside SQL, on the smallest tables."""

import os

import pytest

from evidentia.llm.queries import ORACLES, QUERIES
from tools.compare import compare, oracle

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    state, _, note = compare(name, QUERIES[name](spark, SF), oracle(SF), ORACLES[name])
    assert state == "ok", note


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
