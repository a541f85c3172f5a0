import json

import pytest
from pyspark.sql import functions as F

from paratope.operators import relational
from paratope.plans import jobs
from paratope.schema import ANTIGEN_COLUMNS, IEDB_CSV, STCR_TSV, TRIAD_COLUMNS

ALLELES = [("A*02:01:01:01", "s" * 24 + "H" * 284 + "tail"), ("DQA1*03:02:01", "s" * 23 + "Q" * 193 + "t"), ("DQB1*03:01:01", "s" * 32 + "R" * 198 + "t"), ("DRA*01:02", "s" * 26 + "D" * 190 + "t"), ("DRB1*15:01", "s" * 29 + "E" * 198 + "t")]


@pytest.fixture(scope="module")
def alleles(spark):
    return spark.createDataFrame(ALLELES, "name string, sequence string")


@pytest.fixture(scope="module")
def numbering(spark):
    rows = []
    for seq, chain in (("ALPHA", "alpha"), ("BETAB", "beta")):
        rows += [(seq, chain, "human", i, n) for i, n in enumerate([27, 38, 56, 82, 104])]
    return spark.createDataFrame(rows, "seq string, chain string, species string, pos int, imgt_num int")


def test_class_one(spark, alleles, numbering):
    raw = spark.createDataFrame([("PEP", "ALPHA", "BETAB", "HLA-A*02:01", "http://x/1,http://x/2", "7,8"), ("PEP", "ALPHA", "BETAB", "HLA-A*02:01", None, "9"), ("PEP", None, "BETAB", "HLA-A*02:01", "u/3", "1")], IEDB_CSV)
    triads, antigens = jobs.clean_class_one(raw, alleles, numbering, "LIGHT")
    (row,) = triads.collect()
    assert (row.mhc_1_name, row.mhc_1_seq, row.mhc_2_seq, row.references, row.receptor_id) == ("A*02:01", "H" * 284, "LIGHT", ["1", "2"], ["7", "8", "9"])
    assert (row.tcr_1_cdr_1, row.tcr_1_cdr_2, row.tcr_1_cdr_2_5, row.tcr_1_cdr_3, row.tcr_2_cdr_1) == ("AL", "P", "H", "A", "BE")
    (antigen,) = antigens.collect()
    assert antigen.job_name != row.job_name and antigens.columns == ["job_name", *ANTIGEN_COLUMNS] and triads.columns[: len(TRIAD_COLUMNS)] == TRIAD_COLUMNS


def test_class_two(spark, alleles, numbering):
    raw = spark.createDataFrame([("P1", "ALPHA", "BETAB", "HLA-DQB1*03:01", "a/b", "1"), ("P2", "ALPHA", "BETAB", "HLA-DRB1*15:01", "a/c", "2"), ("P3", "ALPHA", "BETAB", "HLA-DQA1*03:02/DQB1*03:01", None, "3"), ("P4", "ALPHA", "BETAB", "HLA-DQB1*99:01", None, "4")], IEDB_CSV)
    found = {r.peptide: r for r in jobs.clean_class_two(raw, alleles, numbering)[0].collect()}
    assert sorted(found) == ["P1", "P2", "P3"]
    assert (found["P1"].mhc_1_name, found["P1"].mhc_1_seq, found["P1"].mhc_2_seq) == ("DQA1*03:02", "Q" * 193, "R" * 198)
    assert (found["P2"].mhc_1_name, found["P2"].mhc_1_seq, found["P2"].mhc_2_seq) == ("DRA*01:02", "D" * 190, "E" * 198) and found["P3"].references == []


def test_structures(spark, numbering):
    rows = [
        ("1abc", "GA", "protein | peptide", "X | P", "A", "B", "D", "E", None, None, "homo sapiens", "homo sapiens", None, "mus musculus"),
        ("1abc", "GA", None, "P", "A2", "B2", "D2", "E2", None, None, "homo sapiens", None, None, "mus musculus"),
        ("2abc", "MH1", "protein", "P", "A", "B", "D", "E", None, None, None, None, None, None),
        ("3abc", "MH1", "peptide", "P", "A", None, "D", "E", None, None, "rattus", None, None, None),
    ]
    summary = spark.createDataFrame(rows, STCR_TSV)
    found = {r.pdb: r for r in jobs.summary_of_structures(summary).collect()}
    one = found["1abc"]
    assert sorted(found) == ["1abc", "3abc"] and (one.mhc_class, one.peptide_segid, one.mhc_1_segid, one.tcr_2_species, one.mhc_1_chain) == ("II", "P", "A", "mouse", "alpha")
    assert (found["3abc"].mhc_class, found["3abc"].mhc_1_species, found["3abc"].mhc_2_chain) == ("I", None, "light")
    fasta = spark.createDataFrame([("1abc", "1|Chain P|x", "GGPEPGG"), ("1abc", "2|Chains A[auth A], Z|x", "MMPEPKK"), ("1abc", "3|Chain B|x", "NN"), ("1abc", "4|Chain D|x", "ALPHA"), ("1abc", "5|Chain E|x", "")], "pdb string, description string, sequence string")
    frame = lambda s: spark.createDataFrame([], s)
    triads, _ = jobs.clean_structures(summary.filter("pdb = '1abc'"), frame("pdb string, pdb_date timestamp"), fasta, numbering, frame("pdb string, mhc_1_name string, mhc_2_name string"), frame("pdb string, replication boolean"), {}, {"1abc": {"peptide": "PEP"}})
    (row,) = triads.collect()
    assert (row.peptide, row.mhc_1_seq, row.mhc_2_seq, row.tcr_1_seq, row.tcr_2_seq, row.tcr_1_species) == ("PEP", "KK", "NN", "ALPHA", None, "human")
    mixed = spark.createDataFrame([rows[0], ("1abc", "MH1", *rows[1][2:])], STCR_TSV)
    with pytest.raises(Exception, match="several values of mhc_type"):
        jobs.summary_of_structures(mixed).collect()


def test_corrections_keep_all_rows(spark):
    df = spark.createDataFrame([("a", "1"), (None, "2"), ("b", None)], "k string, v string")
    assert [tuple(r) for r in relational.corrected(df, "k", {"b": {"v": "9"}, "zz": {"v": "0"}}).collect()] == [("a", "1"), (None, "2"), ("b", "9")]


def test_identity_matches(spark):
    queries = spark.createDataFrame([("p", "I", "m", None), ("p", "II", "m", "n"), ("q", "I", "m", None)], "peptide string, mhc_class string, mhc_1_seq string, mhc_2_seq string")
    hits = spark.createDataFrame([("p", "X", 99.0), ("m", "X", 96.0), ("p", "Y", 99.0), ("m", "Y", 97.0), ("n", "X", 95.0), ("n", "Y", 94.9), ("q", "Z", 100.0)], "query_id string, pdb string, per_identity double")
    found = {(r.peptide, r.mhc_class): r for r in relational.identity_matches(queries, hits).collect()}
    assert found["p", "I"].pmhc_match_id == ["Y", "X"] and found["p", "I"].pmhc_match_mhc_1_per_identity == 97.0
    assert found["p", "II"].pmhc_match_id == ["X"] and found["p", "II"].pmhc_match_mhc_2_per_identity == 95.0 and not found["q", "I"].pmhc_match


def test_inference_inputs(spark):
    df = spark.createDataFrame([("j", "PEP", "M1", None, "T1", "T2")], "job_name string, peptide string, mhc_1_seq string, mhc_2_seq string, tcr_1_seq string, tcr_2_seq string")
    document = json.loads(jobs.inference_inputs(df, [1, 2]).first().document)
    assert [p["protein"]["id"] for p in document["sequences"]] == ["A", "B", "C", "D"] and document["modelSeeds"] == [1, 2] and document["sequences"][1]["protein"]["unpairedMsa"] == ">query\nM1\n"
    assert {tuple(r) for r in jobs.alignment_jobs(df).collect()} == {("peptide", "PEP"), ("mhc", "M1"), ("tcr", "T1"), ("tcr", "T2")}


def test_geometric_means(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 8.0), ("b", 0.0), ("b", 5.0)], "k string, v double")
    assert {r.k: r.g for r in df.groupBy("k").agg(relational.geometric_mean(F.col("v")).alias("g")).collect()} == {"a": pytest.approx(4.0), "b": 0.0}
    with pytest.raises(Exception, match="negative value"):
        spark.createDataFrame([(-1.0,)], "v double").agg(relational.geometric_mean(F.col("v"))).collect()
