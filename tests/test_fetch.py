"""Loaders against a table of answers."""

import json

import pytest

from paratope.sources import fetch, structures

ATOM = "ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f  1.00%6.2f\n"
ANSWERS = {
    "http://s/1abc.pdb": (ATOM % (1, 1, 1, 2, 3, 50)).encode(),
    "http://s/2abc.cif": b"data_x\nloop_\n_atom_site.group_PDB\n_atom_site.label_atom_id\n_atom_site.auth_asym_id\n_atom_site.auth_seq_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\n_atom_site.pdbx_PDB_model_num\nATOM \"O5'\" B 7 1.5 2 3 1\nATOM CA B 8 2.5 2 3 1\nATOM CA B 8 9.5 2 3 2\n#\n",
    "http://e/1abc": json.dumps({"rcsb_accession_info": {"initial_release_date": "2010-01-02T00:00:00+0000"}}).encode(),
    "http://f/1abc": b">1ABC_1|Chain A|x\r\nMA\r\nKK\n>1ABC_2|Chains B, C[auth D]|y\nGG\n",
    "http://a?query=or(startsWith(name,'A*01:'),eq(name,'A*01'))": json.dumps({"data": [{"accession": "X1", "name": "A*01:01N"}, {"accession": "X2", "name": "A*01:02"}, {"accession": "X3", "name": "A*01:03"}]}).encode(),
    "http://a?query=or(startsWith(name,'B*01:'),eq(name,'B*01'))": json.dumps({"data": []}).encode(),
    "http://a/X2": json.dumps({"status": "Private", "sequence": {"protein": "NO"}}).encode(),
    "http://a/X3": json.dumps({"status": "Public", "sequence": {"protein": "YES"}}).encode(),
}


def test_structures_fall_back_to_the_other_format(spark):
    ids = spark.createDataFrame([("1abc",), ("2abc",), ("2abc",), (None,)], "pdb string")
    rows = fetch.structure_contents(ids, ANSWERS.get, ["http://s/{}.pdb", "http://s/{}.cif"])
    assert {r.pdb: r.suffix for r in rows.collect()} == {"1abc": "pdb", "2abc": "cif"}
    atoms = structures.read_atoms(rows).orderBy("job_name", "resindex").collect()
    assert [(a.job_name, a.segid, a.resindex, a.name, a.x) for a in atoms] == [("1abc", "A", 0, "CA", 1.0), ("2abc", "B", 0, "O5'", 1.5), ("2abc", "B", 1, "CA", 2.5)]
    with pytest.raises(Exception, match="no structure file for 9xyz"):
        fetch.structure_contents(spark.createDataFrame([("9xyz",)], "pdb string"), ANSWERS.get, ["http://s/{}.pdb"]).collect()


def test_dates_sequences_and_alleles(spark):
    ids = spark.createDataFrame([("1abc",)], "pdb string")
    assert str(fetch.release_dates(ids, ANSWERS.get, "http://e/{}").selectExpr("CAST(pdb_date AS STRING) AS d").first().d) == "2010-01-02 00:00:00"
    assert sorted((r.description, r.sequence) for r in fetch.entry_sequences(ids, ANSWERS.get, "http://f/{}").collect()) == [("1ABC_1|Chain A|x", "MAKK"), ("1ABC_2|Chains B, C[auth D]|y", "GG")]
    names = spark.createDataFrame([("A*01",), ("A*01",)], "name string")
    assert [tuple(r) for r in fetch.allele_sequences(names, ANSWERS.get, "http://a").collect()] == [("A*01", "YES", "X3")]
    with pytest.raises(Exception, match="no public sequence"):
        fetch.allele_sequences(spark.createDataFrame([("B*01",)], "name string"), ANSWERS.get, "http://a").collect()


def test_retries_pause_longer_each_time():
    pauses, calls = [], []

    def action():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("not yet")
        return "done"

    assert fetch.retried(action, attempts=5, first=0.5, sleep=pauses.append) == "done" and pauses == [0.5, 1.0, 2.0]
    calls.clear()
    with pytest.raises(OSError):
        fetch.retried(action, attempts=3, sleep=pauses.append)
