"""Symbol index, classification, harmonisation, families."""

import pytest
from pyspark.errors import PySparkException

from evidentia.operators import symbols
from tests.conftest import rows


@pytest.fixture(scope="module")
def index(spark):
    authority = spark.createDataFrame(
        [
            (1, "NEW1", "Approved", "OLD1|OLD2", "ALI1"),
            (2, "NEW2", "Approved", "OLD2| |OLD3", "ALI1|OLD1"),
            (3, "GONE", "Withdrawn", "OLD9", "ALI9"),
            (4, "KEEP", "Approved", "", ""),
            (5, "NEW3", "Approved", "KEEP|OLD5", ""),
            (6, "NEW4", "Approved", "OLD6|OLD7", ""),
        ],
        "row_id int, symbol string, status string, prev_symbol string, alias_symbol string",
    )
    return symbols.symbol_index(authority.repartition(3)).cache()


def test_precedence_and_first_wins(index):
    got = {r["name"]: (r["status"], r["target"]) for r in index.collect()}
    assert got["OLD2"] == ("previous_symbol", "NEW1")  # two records claim it: the first wins
    assert got["OLD1"] == ("previous_symbol", "NEW1")  # previous before alias
    assert got["KEEP"] == ("approved", "KEEP")  # approved before previous
    assert got["ALI1"] == ("alias_symbol", "ALI1")
    assert "GONE" not in got and "OLD9" not in got


def test_classify(spark, index):
    df = spark.createDataFrame([("NEW1",), ("OLD3",), ("ALI1",), ("GONE",), (None,)], "g string")
    got = {r["g"]: r["status"] for r in symbols.classify(df, index, "g").collect()}
    assert got == {"NEW1": "approved", "OLD3": "previous_symbol", "ALI1": "alias_symbol", "GONE": "not_found", None: "not_found"}


def test_harmonize_renames_and_drops_collisions(spark, index):
    df = spark.createDataFrame([("OLD1", 1), ("NEW1", 2), ("OLD3", 3), ("ALI1", 4), ("NA", 5)], "g string, v int")
    out, changes = symbols.harmonize(df, index, "g")
    assert rows(out) == [("ALI1", 4), ("NA", 5), ("NEW1", 2), ("NEW2", 3)]
    assert rows(changes) == [("OLD1", "NEW1", True, 1), ("OLD3", "NEW2", False, 1)]
    assert tuple(symbols.rename_counts(changes).first()) == (1, 1)
    kept = symbols.canonical(df, index, "g", "g_current")
    assert {r["g_current"] for r in kept.collect()} == {"NEW1", "NEW2", "ALI1", "NA"} and kept.count() == 5


def test_harmonize_rejects_two_names_for_one_target(spark, index):
    df = spark.createDataFrame([("OLD6",), ("OLD7",)], "g string")
    with pytest.raises(PySparkException, match="NEW4"):
        symbols.harmonize(df, index, "g")[0].collect()


@pytest.mark.parametrize("names", [["A", "A"], ["OLD6", "OLD6"], ["NEW1", "NEW1", "OLD1"]])
def test_harmonize_rejects_repeated_rows(spark, index, names):
    df = spark.createDataFrame([(n,) for n in names], "g string")
    with pytest.raises(PySparkException, match="duplicate symbols"):
        symbols.harmonize(df, index, "g")[0].collect()


def test_harmonize_keeps_unnamed_rows_and_repeats_of_dropped_ones(spark, index):
    df = spark.createDataFrame([(None, 1), (None, 2), ("NEW1", 3), ("OLD1", 4), ("OLD1", 5)], "g string, v int")
    out, changes = symbols.harmonize(df, index, "g")
    assert rows(out) == [("NEW1", 3), (None, 1), (None, 2)] and rows(changes) == [("OLD1", "NEW1", True, 2)]
    empty, none = symbols.harmonize(df.filter("false"), index, "g")
    assert rows(empty) == [] and rows(none) == []


def test_format_profile(spark):
    df = spark.createDataFrame([("A1",), ("A1",), (" B",), ("C D",), ("NA",), ("",), ("X-2.1",), ("é#",)], "g string")
    r = symbols.format_profile(df, "g").first()
    assert (r["n"], r["unique_n"], r["whitespace"], r["space"], r["empty_or_na"], r["duplicates"]) == (8, 7, 1, 2, 2, 1)
    assert r["special_chars"] == " #-." and r["nonstandard_n"] == 4


def test_family_fallback(spark):
    df = spark.createDataFrame([("ABCD",), ("xyz1",), ("Q",)], "gene string")
    groups = spark.createDataFrame([("ABCD", " |12|34"), ("xyz1", ""), ("none", "9")], "symbol string, gene_group_id string")
    got = {r["gene"]: r["family"] for r in symbols.family_of(df, groups, "gene").collect()}
    assert got == {"ABCD": "HGNC:12", "xyz1": "PFX:XYZ", "Q": "PFX:Q"}
