import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paratope.schema import ALLELE_STATUS_CSV, DOCKING_COLUMNS, STCR_TSV
from paratope.sources import fasta, jobs, structures, tables
from paratope.streaming.incremental import process_new, process_once


def test_delimited_files(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("pdb\tmhc_type\textra\tGchain\n1abc\tNA\tx\tunknown\n2abc\tMH1\ty\tNOT\n")
    rows = tables.read_csv(spark, str(tmp_path / "s.tsv"), STCR_TSV, "\t", ("NA", "unknown", "NOT", "")).collect()
    assert [(r.pdb, r.mhc_type, r.Gchain, r.Achain) for r in rows] == [("1abc", None, None, None), ("2abc", "MH1", None, None)]
    (tmp_path / "a.csv").write_text("# note\nAllele,Partial\nA*01,Full\n")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv"), ALLELE_STATUS_CSV, comment="#").collect()] == [("A*01", "Full")]


def test_parquet_and_docking_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "job_name string, v int")
    tables.write_parquet(df, str(tmp_path / "t"), partition_by=("v",))
    assert tables.read_parquet(spark, str(tmp_path / "t")).count() == 2
    (tmp_path / "a.tsv").write_text("\t".join(DOCKING_COLUMNS) + "\n" + "\t".join("123456") + "\n")
    rows = {r.job_name: r for r in tables.docking_features(spark, df, str(tmp_path / "*.tsv")).collect()}
    assert (rows["a"].d, rows["a"].mhc_unit_z, rows["b"].d) == (1.0, 6.0, None)


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">HLA:1 A*01:01 365 bp\nMAV\nMAP\n>HLA:2 A*02:01N 1 bp\nMM\n\n>HLA:3 B*07\r\nKK\r\n")
    rows = fasta.read_fasta(spark, str(tmp_path / "x.fasta")).orderBy("at").collect()
    assert [(r.description, r.sequence) for r in rows] == [("HLA:1 A*01:01 365 bp", "MAVMAP"), ("HLA:2 A*02:01N 1 bp", "MM"), ("HLA:3 B*07", "KK")]
    assert {tuple(r) for r in fasta.allele_proteins(spark, str(tmp_path / "x.fasta")).collect()} == {("A*01:01", "MAVMAP"), ("B*07", "KK")}
    fasta.write_fasta(spark.createDataFrame([(["AA", "CC"],)], "s array<string>"), "s", str(tmp_path / "out"))
    assert [(r.description, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "out")).orderBy("at").collect()] == [("1", "AA"), ("2", "CC")]


def test_registry(spark):
    old = spark.createDataFrame([("s1", "p1", 1), ("s2", "p2", 5)], "k string, path string, date int")
    fresh = spark.createDataFrame([("s1", "q1", 3), ("s2", "q2", 5), ("s3", "q3", 1)], "k string, path string, date int")
    assert {r.k: r.path for r in jobs.upsert(old, fresh, ["k"], "date").collect()} == {"s1": "q1", "s2": "q2", "s3": "q3"}
    with pytest.raises(Exception, match="several rows"):
        jobs.exactly_one(old.union(old), ["k"]).collect()
    assert [r.k for r in jobs.missing(fresh, old, ["k"]).collect()] == ["s3"]
    assert [r.path for r in jobs.exactly_one(old, ["k"], fresh.filter("k = 's2'").union(fresh.filter("k = 's2'"))).collect()] == ["p2"]
    with pytest.raises(Exception, match="no row: s3"):
        jobs.exactly_one(old, ["k"], fresh).collect()
    names = spark.createDataFrame([("peptide", "AB"), ("tcr", "AB")], "kind string, s string").select(jobs.registry_name(F.col("kind"), F.col("s")).alias("n")).collect()
    assert names[0].n == "AB" and len(names[1].n) == 64


def test_batches(spark):
    rows = jobs.batches(spark.range(1234).repartition(7), ["id"]).collect()
    assert all(r.batch == r.id // 50 for r in rows) and len(rows) == 1234


def test_structure_files(spark, tmp_path):
    line = "ATOM  %5d  CA  ALA %s%4d    %8.3f%8.3f%8.3f  1.00%6.2f\n"
    (tmp_path / "1abc.pdb").write_text("".join(line % (i, c, i, i, 2.0, 3.0, 50 + i) for i, c in enumerate("ABDE")) + "END\n")
    (tmp_path / "1abc.cif").write_text("x")
    (tmp_path / "2abc.cif").write_text("y")
    files = structures.structure_files(spark, str(tmp_path / "*"))
    assert {r.pdb: r.path[-3:] for r in files.collect()} == {"1abc": "pdb", "2abc": "cif"}
    atoms = structures.read_atoms(files.filter("suffix = 'pdb'"))
    assert [(r.segid, r.resindex, r.x, r.plddt) for r in atoms.orderBy("resindex").collect()] == [(c, i, float(i), 50.0 + i) for i, c in enumerate("ABDE")]
    laid = structures.docking_layout(atoms, spark.createDataFrame([("1abc", "I")], "job_name string, mhc_class string"))
    text = structures.pdb_text(laid).first().text.splitlines()
    assert [t[21] for t in text[:-1]] == list("ABCD") and float(text[0][30:38]) == 1.0 and text[-1] == "END"


def test_new_files_are_worked_on_once(spark, tmp_path):
    source, target, schema = str(tmp_path / "in"), str(tmp_path / "out"), "k long, v string"
    run = lambda: process_new(spark, source, spark.createDataFrame([], schema).schema, target, "k", lambda d: d.withColumn("done", F.upper("v")), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(source)
    run()
    spark.createDataFrame([(2, "again"), (3, "c")], schema).write.mode("append").parquet(source)
    run()
    assert sorted((r.k, r.done) for r in spark.read.parquet(target).collect()) == [(1, "A"), (2, "B"), (3, "C")]


@pytest.mark.parametrize("time", [None, "t"])
def test_keys_are_worked_on_once_by_state(spark, tmp_path, time):
    """Files that come again, keys that come again in one batch or later, and a batch that is run again; the target isn't read."""
    source, target, schema = str(tmp_path / "in"), str(tmp_path / "out"), "k long, v string, t timestamp"
    seen = []

    def run():
        with_mark = lambda d: seen.append(d.count()) or d.select("k", F.upper("v").alias("done"))
        process_once(spark, source, spark.createDataFrame([], schema).schema, target, "k", with_mark, str(tmp_path / "c"), time=time).awaitTermination()

    day = datetime.datetime(2024, 5, 1)
    put = lambda rows: spark.createDataFrame([(k, v, day + datetime.timedelta(hours=k)) for k, v in rows], schema).write.mode("append").parquet(source)
    put([(1, "a"), (2, "b"), (2, "b")])
    run()
    put([(1, "a"), (2, "b"), (3, "c")])
    run()
    run()
    assert sorted((r.k, r.done) for r in spark.read.parquet(target).collect()) == [(1, "A"), (2, "B"), (3, "C")]
    assert sum(seen) == 3
    # the last batch once more, as after a failure before it was committed
    last = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for path in (last, last.with_name(f".{last.name}.crc")):
        path.unlink(missing_ok=True)
    run()
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_files_are_copied_once(spark, tmp_path):
    import gzip

    from paratope.sources import files

    for name, content in (("a/x.json", b"one"), ("a/b/y.json", b"two!"), ("a/b/z.txt", b"no")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    run = lambda **o: sorted(tuple(r) for r in files.copy_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), "*.json", **o).collect())
    assert run() == [("a/b/y.json", 4, True), ("a/x.json", 3, True)] and run() == [("a/b/y.json", 4, False), ("a/x.json", 3, False)]
    assert (tmp_path / "out/a/x.json").read_bytes() == b"one" and not (tmp_path / "out/a/b/z.txt").exists()
    assert all(r[2] for r in run(codec="gzip")) and gzip.decompress((tmp_path / "out/a/x.json.gz").read_bytes()) == b"one"


def test_ranking_scores(spark, tmp_path):
    from paratope.sources import files

    h5py = pytest.importorskip("h5py")
    with h5py.File(tmp_path / "j.h5", "w") as f:
        f["ranking_scores/seed"], f["ranking_scores/ranking_score"] = [1, 2], [0.5, 0.25]
    assert sorted(tuple(r) for r in files.ranking_scores(spark, str(tmp_path / "*.h5")).collect()) == [("j", 1, 0.5), ("j", 2, 0.25)]


def test_references_of_matching(spark, tmp_path):
    from paratope.functions import hla, sequences

    (tmp_path / "a.fasta").write_text(">HLA:1 A*01:01 3 bp\nMAV\n>HLA:2 A*02:01N 3 bp\nMAA\n>HLA:3 A*03:01 3 bp\nMAC\n")
    (tmp_path / "b.fasta").write_text(">HLA:4 DRB1*01:01 3 bp\nGGG\n")
    statuses = spark.createDataFrame([("A*01:01", "Full"), ("A*03:01", "Partial"), ("DRB1*01:01", "Full")], "Allele string, Partial string")
    rows = fasta.allele_reference(spark, {"heavy": [str(tmp_path / "a.fasta")], "beta": [str(tmp_path / "b.fasta")]}, statuses).orderBy("ord").collect()
    assert [(r.chain, r.name, r.status) for r in rows] == [("heavy", "A*01:01", "Full"), ("heavy", "A*03:01", "Partial"), ("beta", "DRB1*01:01", "Full")]
    df = spark.createDataFrame([("H2-Kb", "heavy"), ("B2M", "light"), ("H2-Kb", "beta")], "n string, c string")
    found = {(r.n, r.c): (r.s, r.top) for r in hla.with_mouse_sequence(hla.with_mouse_sequence(df, sequences.mouse_chains(spark), "n", "c", "s", top_only=False), sequences.mouse_chains(spark), "n", "c", "top").collect()}
    assert found["H2-Kb", "beta"] == (None, None) and found["H2-Kb", "heavy"][1] == found["H2-Kb", "heavy"][0][21:305] and found["B2M", "light"][0] == found["B2M", "light"][1]
    known = hla.with_sequence(spark.createDataFrame([("DRA*01:02",), ("B2M",)], "n string"), sequences.human_constants(spark), "n", "s").collect()
    assert {r.n: len(r.s) for r in known} == {"DRA*01:02": 190, "B2M": len(sequences.HUMAN["B2M"])}
    assert {r.species for r in sequences.light_chains(spark).collect()} == {"human", "mouse"} and len(sequences.MOUSE) == 12


def test_cache_fetches_each_key_once(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("seq", T.StringType())])
    fetched = []

    def fetch(missing):
        fetched.append(sorted(r.k for r in missing.collect()))
        return missing.filter("k <> 'none'").withColumn("seq", F.concat("k", F.lit("!")))

    path = str(tmp_path / "cache")
    ask = lambda *keys: sorted(tuple(r) for r in tables.cached_rows(spark.createDataFrame([(k,) for k in keys], "k string"), path, "k", schema, fetch).collect())
    assert ask("a", "b", "a", None) == [("a", "a!"), ("b", "b!")]
    assert ask("b", "c") == [("b", "b!"), ("c", "c!")] and ask("c", "a") == [("a", "a!"), ("c", "c!")]
    assert fetched == [["a", "b"], ["c"]]
    assert ask("none") == [] == ask(None) and fetched[-1] == ["none"]


def test_trimmed_rows(spark):
    df = spark.createDataFrame([(" A b\t", None, " X ")], "u string, v string, w string")
    assert tuple(tables.trimmed(df, ["u", "v"], lower=True).first()) == ("a b", None, " X ")
