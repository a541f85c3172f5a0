import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paratope.functions import distance, hla, keys, text
from paratope.operators import alleles


def one(spark, *columns, row=None):
    df = spark.range(1) if row is None else spark.createDataFrame([row])
    return df.select(*columns).first()


def test_hashes_and_job_names(spark):
    row = one(spark, keys.hash_sequence(F.lit("CASSL")), keys.hash_sequence(F.lit("CASSL"), "SHA1"), keys.hash_sequence(F.lit("CASSL"), "sha256"))
    assert list(row) == [hashlib.new(h, b"CASSL").hexdigest() for h in ("md5", "sha1", "sha256")]
    with pytest.raises(ValueError, match="unsupported"):
        keys.hash_sequence("x", "crc")
    df = spark.createDataFrame([("a", None, "b")], "x string, y string, z string")
    assert keys.with_job_name(df, ["x", "y", "z"]).first().job_name == hashlib.md5(b"ab").hexdigest()


def test_key_ids_tell_boundaries_and_nulls_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("abc", None), ("abc", "")], "x string, y string")
    assert df.select(keys.key_id(["x", "y"]).alias("k")).distinct().count() == 4


def test_string_and_list_expressions(spark):
    lit = F.lit
    row = one(
        spark, text.after(lit("HLA-A*02:01"), "HLA-"), text.after(lit("A2"), "HLA-"), text.last_parts(F.split(lit("u/1,u/2/3"), ",")), text.index_of(text.stripped(F.split(lit("protein | peptide"), r"\|")), "peptide"), text.index_of(F.array(lit("x")), "peptide"),
        text.item(F.array(lit("a")), lit(4)), text.blank_to_null(lit("")), text.drop_through(lit("GGPEPLINK"), lit("PEP")), text.drop_through(lit("GGG"), lit("PEP")), text.drop_through(F.lit(None).cast("string"), lit("PEP")), text.chain_letter(lit(3)),
    )
    assert list(row) == ["A*02:01", None, ["1", "3"], 1, None, None, None, "LINK", "GGG", None, "D"]


def test_chain_ids(spark):
    names = ["1ABC_1|Chain A|x", "1ABC_2|Chains A[auth B], C|x", "7Q9B|Chains D[auth FFF], E[auth GGG]|x", "2|Chain  Q|y"]
    df = spark.createDataFrame([(n,) for n in names], "d string")
    assert [r[0] for r in df.select(text.chain_ids(F.col("d"))).collect()] == [["A"], ["B", "C"], ["FFF", "GGG"], ["Q"]]


def test_scaling_of_a_flat_column(spark):
    assert one(spark, text.zero_to_one(F.lit(2.0), F.lit(2.0), F.lit(2.0)))[0] is None
    assert one(spark, text.zero_to_one(F.lit(3.0), F.lit(2.0), F.lit(6.0), rising=False))[0] == 0.75


def test_partner_chains(spark):
    cases = {
        (None, "DRB1*15:01:01"): ("DRA*01:02", "DRB1*15:01", "neither"), (None, "DQB1*03:01"): ("DQA1*03:02", "DQB1*03:01", "chain_1"), ("DQA1*05:01:01", "DQB1*02:01"): ("DQA1*05:01", "DQB1*02:01", "neither"),
        ("DQA1*05", "DQB1*02:01"): ("DQA1*05:01", "DQB1*02:01", "chain_1"), (None, "DQB1*77:01"): (None, None, None), (None, "DPB1*04:01"): ("DPA1*01:03", "DPB1*04:01", "chain_1"), (None, "DRB1"): (None, None, None), ("x", "A*02:01"): (None, None, None), (None, None): (None, None, None),
    }
    df = spark.createDataFrame(list(cases), "a string, b string")
    assert [tuple(r[0]) for r in df.select(hla.infer_chains(F.col("a"), F.col("b"))).collect()] == list(cases.values())


def test_domains(spark):
    seq = "".join(chr(33 + i % 90) for i in range(400))
    for name, start, stop in hla.HUMAN_DOMAINS:
        full = name if name == hla.LIGHT else name + "*01:01"
        assert one(spark, hla.human_domain(F.lit(full), F.lit(seq)))[0] == seq[start:stop]
    for name, chain, start, stop in hla.MOUSE_DOMAINS:
        assert one(spark, hla.mouse_domain(F.lit(name), F.lit(chain), F.lit(seq)))[0] == seq[start:stop]
    with pytest.raises(Exception, match="no topological domain"):
        one(spark, hla.human_domain(F.lit("XYZ"), F.lit(seq)))


def test_sequence_lookup(spark):
    reference = spark.createDataFrame([("A*02:01:01", "x" * 24 + "M" * 400), ("A*02:01:02", "y" * 400), ("A*03:01N", "z" * 400)], "name string, sequence string")
    df = spark.createDataFrame([("A*02:01",), ("A*03:01",), (None,)], "n string")
    assert [r.s for r in hla.with_sequence(df, reference, "n", "s").orderBy(F.col("n").asc_nulls_last()).collect()] == ["M" * 284, None, None]


def test_loop_distances():
    d = lambda a, b, **k: int(distance.loop_distance([a], [b], **k)[0])
    assert d("AAA", "AAA") == 0 and d("AAA", "AAS") == 3 and d("AAA", "AAW") == 4 and d("IIV", "VII") == 2
    assert d("", "AAAA") == 16 and d(None, None) == 0
    third = distance.LOOPS["cdr_3"]
    assert d("CASSLGQAYEQYF", "CASSLGQAYEQYF", **third) == 0
    assert d("CASSLGQAYEQYF", "XASSLGQAYEQYX", **third) == 0  # the ends are trimmed
    assert d("CASSLGQAYEQYF", "CASSLWQAYEQYF", **third) == 12
    assert d("CASSLGQAYEQYF", "CASSLGGQAYEQYF", **third) == 12
    matrix = distance.substitution_matrix()
    assert (matrix == matrix.T).all() and matrix.max() == 4


def test_receptor_distance_is_a_symmetric_sum():
    rng = np.random.default_rng(0)
    word = lambda n: "".join(rng.choice(list(distance.AMINO), n))
    make = lambda: {f"tcr_{c}_{r}": [word(rng.integers(5, 8) if r != "cdr_3" else rng.integers(10, 16)) for _ in range(30)] for c in (1, 2) for r in distance.LOOPS}
    a, b = make(), make()
    d = distance.receptor_distance(a, b)
    assert (d == distance.receptor_distance(b, a)).all() and (distance.receptor_distance(a, a) == 0).all()
    parts = sum(distance.loop_distance(a[k], b[k], **distance.LOOPS[k[6:]]) for k in a)
    assert (d == parts).all()
    bound = [12 * (abs(len(a["tcr_1_cdr_3"][i]) - len(b["tcr_1_cdr_3"][i])) + abs(len(a["tcr_2_cdr_3"][i]) - len(b["tcr_2_cdr_3"][i]))) for i in range(30)]
    assert (d >= bound).all()


def test_common_substrings_and_alleles(spark):
    assert distance.longest_common_substring("GILGFVFTL", "XXGFVFYY") == 4 and distance.longest_common_substring("", "A") == 0
    reference = spark.createDataFrame([("heavy", "human", "A*01", "MMABCDEF", "Partial", 1), ("heavy", "human", "A*02", "NNABCDEF", "Full", 2), ("heavy", "human", "A*03", "ABC", "Full", 3), ("alpha", "human", "D", "ABCDEFG", "Full", 4)], "chain string, species string, name string, sequence string, status string, ord int")
    chains = spark.createDataFrame([("XABCDEFX", "heavy", "human"), (None, "heavy", "human")], "seq string, chain string, species string")
    (row,) = alleles.match_alleles(chains, reference).collect()
    assert (row.name, row.size, row.proportion) == ("A*02", 6, 0.75)


def test_superposition():
    rng = np.random.default_rng(1)
    fit, own = rng.normal(size=(20, 3)), rng.normal(size=(9, 3))
    angle = 1.1
    turn = np.array([[math.cos(angle), -math.sin(angle), 0], [math.sin(angle), math.cos(angle), 0], [0, 0, 1]])
    assert distance.superposed_rmsd(fit @ turn + 5, fit, own @ turn + 5, own) == pytest.approx(0, abs=1e-9)
    assert distance.superposed_rmsd(fit, fit, own + [0, 0, 2], own) == pytest.approx(2)


def brute_linkage(d, cut):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min((max(d[a][b] for a in x for b in y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(tuple(sorted(g)) for g in groups)


def test_complete_linkage_equals_brute_force():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        points, cut = rng.random((rng.integers(2, 20), 2)), rng.random()
        d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
        labels = distance.complete_linkage(d, cut)
        assert sorted(tuple(np.flatnonzero(labels == k).tolist()) for k in set(labels)) == brute_linkage(d, cut)


def test_mahalanobis():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(10, 3))
    inverse = np.linalg.inv(np.cov(x, rowvar=False))
    d = distance.mahalanobis(x, inverse)
    assert d[2, 7] == pytest.approx(math.sqrt((x[2] - x[7]) @ inverse @ (x[2] - x[7]))) and np.allclose(d, d.T)


def test_matches_of_both_chains(spark):
    from paratope.operators import alleles

    reference = spark.createDataFrame(
        [("heavy", "human", "A*01:01:01", "MAAAACDEFG", "Partial", 0), ("heavy", "human", "A*02:01:03", "MAAAACDEFH", "Full", 1), ("beta", "human", "DRB1*01:01:01", "GGGHIKL", "Full", 2), ("heavy", "mouse", "H2-Kb", "CDEFGHIKL", "Full", 3)],
        "chain string, species string, name string, sequence string, status string, ord int",
    )
    light = spark.createDataFrame([("human", "B2M", "LIGHTSEQ"), ("mouse", "B2M", "MOUSELIGHT")], "species string, name string, sequence string")
    rows = [("j1", "human", "I", "heavy", "xAAACDEFx", "light", "anything"), ("j2", "human", "I", "heavy", "ACDEFG", "light", None), ("j3", "human", "II", "heavy", "MAAA", "beta", "GGHI"), ("j4", "mouse", "I", "heavy", "CDEFG", "light", "x")]
    df = spark.createDataFrame(rows, "j string, mhc_1_species string, mhc_class string, mhc_1_chain string, mhc_1_seq string, mhc_2_chain string, mhc_2_seq string")
    found = {r.j: r for r in alleles.with_matches(df, reference, light).collect()}
    assert (found["j1"].mhc_1_name, found["j1"].mhc_1_match_size, found["j1"].mhc_1_status, found["j1"].mhc_1_name_maxres) == ("A*02:01", 7, "Full", "A*02:01:03")
    assert found["j1"].mhc_1_match_proportion == 7 / 9 and (found["j1"].mhc_2_name, found["j1"].mhc_2_match_seq, found["j1"].mhc_2_match_size, found["j1"].mhc_2_status) == ("B2M", "LIGHTSEQ", None, "Full")
    assert (found["j2"].mhc_1_name, found["j2"].mhc_2_name, found["j2"].mhc_2_match_seq, found["j2"].mhc_2_status) == ("A*01:01", None, None, None)
    assert (found["j3"].mhc_2_name, found["j3"].mhc_2_match_proportion, found["j3"].mhc_2_maxres) == ("DRB1*01:01", 1.0, "DRB1*01:01:01")
    assert (found["j4"].mhc_1_name, found["j4"].mhc_2_match_seq) == ("H2-Kb", "MOUSELIGHT") and len(found) == 4


def test_a_status_must_be_there_once(spark):
    import pytest

    from paratope.operators import alleles

    names = spark.createDataFrame([("a",), ("b",)], "name string")
    one = spark.createDataFrame([("a", "Full"), ("b", "Partial"), ("c", "Full")], "Allele string, Partial string")
    assert {r.name: r.status for r in alleles.with_status(names, one).collect()} == {"a": "Full", "b": "Partial"}
    for statuses in (one.filter("Allele <> 'b'"), one.unionByName(one)):
        with pytest.raises(Exception, match="exactly one status"):
            alleles.with_status(names, statuses).collect()
