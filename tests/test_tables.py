"""Duplicates, joins, sets, grouping and the text expressions on edge rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.operators import dedup, grouping, joins, sets
from tests.conftest import rows


def test_drop_all_copies_keeps_single_keys_only(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5), ("c", None)], "k string, v int")
    assert rows(dedup.drop_all_copies(df, ["k"])) == [("b", 3), ("c", None)]
    assert rows(dedup.duplicated_keys(df, ["k"])) == [("a", 2), (None, 2)]


def test_keep_first_follows_source_order(spark):
    df = spark.createDataFrame([(3, "a", "z"), (1, "a", None), (2, "b", "y")], "id int, k string, v string").repartition(3)
    assert rows(dedup.keep_first(df, ["k"], "id")) == [(1, "a", None), (2, "b", "y")]
    assert rows(dedup.first_known(df, ["k"], ["v"], "id")) == [("a", "z"), ("b", "y")]


def test_attach_sources_fill_policy_and_counts(spark):
    base = spark.createDataFrame([("a",), ("b",), ("c",)], "gene string")
    zero = spark.createDataFrame([("a", 0.5), ("c", None)], "gene string, s double")
    keep = spark.createDataFrame([("b", 1.0, 2.0)], "gene string, x double, y double")
    out, matched = joins.attach_sources(base, [joins.Source(zero, ["s"], 0.0, "zero"), joins.Source(keep, None, None, "keep")], "gene")
    assert rows(out) == [("a", 0.5, None, None), ("b", 0.0, 1.0, 2.0), ("c", 0.0, None, None)]
    assert rows(matched) == [("keep", 1), ("zero", 1)]


def test_checked_join_guards(spark):
    base = spark.createDataFrame([("a",), ("b",)], "k string")
    good = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, s double")
    assert rows(joins.attach_checked(base, good, "k", ["s"])) == [("a", 1.0), ("b", 2.0)]
    with pytest.raises(PySparkException, match="no match for b"):
        joins.attach_checked(base, good.filter("k = 'a'"), "k", ["s"]).collect()
    with pytest.raises(PySparkException, match="repeats"):
        joins.attach_checked(base, good.union(good), "k", ["s"]).collect()


def test_membership_is_null_safe_and_keeps_rows(spark):
    df = spark.createDataFrame([("a",), (None,), ("x",)], "k string")
    panel = spark.createDataFrame([("a",), ("a",), (None,)], "m string")
    assert rows(joins.flag_members(df, "k", panel, "m", "f")) == [("a", 1), ("x", 0), (None, 0)]
    assert rows(joins.only_members(df, "k", panel, "m")) == [("a",)]
    assert rows(joins.without_members(df, "k", panel, "m")) == [("x",), (None,)]


def test_lookup_first_and_last_win(spark):
    m = spark.createDataFrame([(1, "s", "one"), (2, "s", "two")], "id int, k string, v string")
    df = spark.createDataFrame([("s",), ("t",)], "k string")
    for wins, value in (("first", "one"), ("last", "two")):
        dim = joins.keyed_values(m, "k", "v", "id", wins)
        assert rows(joins.look_up(df, "k", dim, "k", "v", "o", F.col("k"))) == [("s", value), ("t", "t")]


def test_place_after_and_required_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, `c.d` int")
    assert joins.place_after(df, "c.d", "a").columns == ["a", "c.d", "b"]
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        joins.require_columns(df, ["a", "x", "y"])


def test_overlap_report_with_empty_side(spark):
    empty = spark.createDataFrame([], "g string")
    full = spark.createDataFrame([("a",), ("b",), ("a",)], "g string")
    got = {r["metric"]: r["value"] for r in sets.overlap_report(sets.membership({"l": empty, "r": full}), "l", "r").collect()}
    assert got["union"] == 2 and got["both"] == 0 and got["pct_left_in_right"] is None and got["pct_right_in_left"] == 0.0


def test_collapse_lists_counts_and_constants(spark):
    df = spark.createDataFrame(
        [("t", "b", "x", 1), ("t", "a", "", 1), ("t", "a", None, 1), ("u", None, None, 2)], "k string, l string, m string, c int")
    out = grouping.collapse(df, ["k"], ["l", "m"], {"n": "l"}, ["c"])
    assert rows(out) == [("t", "a; b", "x", 2, 1), ("u", "", "", 0, 2)]
    counted = grouping.collapse(df, ["k"], ["l"], {"n": "l", "m_n": "m"}, ["c"])
    assert rows(counted) == [("t", "a; b", 2, 1, 1), ("u", "", 0, 0, 2)]
    broken = df.withColumn("c", F.when(F.col("l") == "b", 9).otherwise(F.col("c")))
    with pytest.raises(PySparkException, match="not constant"):
        grouping.collapse(broken, ["k"], [], {}, ["c"]).collect()


def test_pivot_rejects_repeats_and_keeps_null(spark):
    df = spark.createDataFrame([("g", "x", 1.0), ("g", "y", None), ("h", "y", 2.0)], "k string, c string, v double")
    assert rows(grouping.pivot_once(df, "k", "c", ["x", "y"], ["v"])) == [("g", 1.0, None), ("h", None, 2.0)]
    with pytest.raises(PySparkException, match="repeated"):
        grouping.pivot_once(df.union(df), "k", "c", ["x", "y"], ["v"]).collect()


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.5, 0.50001, 1.0, None)], "v double")
    got = {r["bin"]: r["n"] for r in grouping.equal_width_bins(df, "v", 2, lo=0, hi=1).collect()}
    assert got == {1: 3, 2: 2}
    with pytest.raises(PySparkException, match="outside"):
        grouping.equal_width_bins(df, "v", 2, lo=0, hi=0.9).collect()


def test_frequent_values_break_ties_alphabetically(spark):
    df = spark.createDataFrame([(v,) for v in "ccbbaad"], "v string")
    got = {r["h"] for r in grouping.frequent_or_other(df, "v", 2, "h").collect()}
    assert got == {"a", "b", "other"}


def test_gap_ranking_skips_missing(spark):
    data = [("a", "r", 1.0), ("a", "s", 5.0), ("b", "r", 1.0), ("b", "t", 9.0), ("c", "r", 0.0)]
    df = spark.createDataFrame(data, "k string, c string, v double")
    got = {r["k"]: r["gap"] for r in grouping.gap_ranking(df, "k", "c", "v", "r", ["s", "t"], 3).collect()}
    assert got == {"a": 4.0, "b": 8.0, "c": None}


def test_text_expressions(spark):
    df = spark.createDataFrame([(" A ", "x| |y", "1.5"), ("NA", "", "bad"), ("", None, "NaN")], "s string, t string, n string")
    got = df.select(
        S.is_named("s").alias("named"), F.array_join(S.tokens("t"), ",").alias("t"), S.number("n").alias("n"),
        S.well_formed(F.trim("s")).alias("w"),
    ).collect()
    assert [tuple(r) for r in got] == [(True, "x,y", 1.5, True), (False, "", None, True), (False, None, None, False)]
    one = spark.range(1).select(
        S.joined_distinct(F.array(F.lit("b"), F.lit(""), F.lit("a"), F.lit("b"), F.lit(None))).alias("j"),
        S.exponent_text(F.lit(4.2e-24)).alias("e"), S.rate_text(F.lit(72), F.lit(505)).alias("r"),
        S.signed_log10(F.lit(-2.0), F.lit(0.0)).alias("sl"), S.same_sign(F.lit(None).cast("double"), F.lit(1.0)).alias("ss"),
        S.max_abs(F.lit(-3.0), F.lit(None).cast("double")).alias("m"), S.text_flag(F.lit("True")).alias("tf"),
        S.decoded(F.lit(-1), F.array(F.lit("a"))).alias("d"), S.stage_number(F.lit("PHASE_2_3")).alias("st"),
        S.stage_label(F.lit("unknown")).alias("sl2"), S.is_finite(F.lit(float("inf"))).alias("fi"),
        S.not_in(F.lit(None).cast("string"), ["x"]).alias("ni"),
    ).first()
    assert tuple(one) == ("b; a", "4e-24", "72 / 505 = 14.3%", -300.0, False, 3.0, True, None, 2.5, "", False, True)
