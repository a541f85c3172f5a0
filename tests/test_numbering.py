import random

import pytest
from pyspark.sql import functions as F

from paratope.functions.banded import placed
from paratope.operators import numbering
from paratope.operators.features import region_sequences
from paratope.plans import receptors
from tests.conftest import SF

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
rng = random.Random(11)


def gapped_v(gaps):
    text = ["." if i in gaps else rng.choice(LETTERS) for i in range(1, 109)]
    text[103] = "C"
    return "".join(text)


V = {"V1": gapped_v({10, 31, 32, 60}), "V2": gapped_v({10, 33, 34, 35, 61, 62}), "V3": gapped_v({73})}
J = {f"J{k}": "." * 112 + "".join(rng.choice(LETTERS) for _ in range(5)) + "F" + "".join(rng.choice(LETTERS) for _ in range(9)) for k in (1, 2)}
GERMLINE = [("human", "alpha", k, g, t) for k, table in (("V", V), ("J", J)) for g, t in table.items()]
WHERE = {g: [(i, c) for i, c in enumerate(t, 1) if c != "."] for g, t in (V | J).items()}


def domain(v, j, loop, lead="MK", tail="", swaps=0, drop=None, insert=None):
    """(sequence, its numbers by place)"""
    part = [(n, c) for n, c in WHERE[v] if n <= 104]
    for i in rng.sample(range(20, 80), swaps):
        part[i] = (part[i][0], rng.choice(LETTERS.replace(part[i][1], "")))
    if drop is not None:
        part = [x for x in part if x[0] != drop]
    if insert is not None:
        at = next(i for i, x in enumerate(part) if x[0] == insert)
        part.insert(at + 1, (insert, "W"))
    n = len(loop)
    left = [105 + i for i in range(7)] + [111] * ((n - 13) // 2) if n > 13 else [105 + i for i in range((n + 1) // 2)]
    right = [112] * (n - 13 - (n - 13) // 2) + [112, 113, 114, 115, 116, 117] if n > 13 else [118 - n // 2 + i for i in range(n // 2)]
    numbers = [x[0] for x in part] + left + right + [x[0] for x in WHERE[j] if x[0] >= 118]
    body = "".join(c for _, c in part) + loop + "".join(c for x, c in WHERE[j] if x >= 118)
    return lead + body + tail, {len(lead) + i: x for i, x in enumerate(numbers)}


def loop_of(n):
    return "".join(rng.choice("GSTA") for _ in range(n))


@pytest.fixture(scope="module")
def germline(spark):
    return spark.createDataFrame(GERMLINE, "species string, chain string, kind string, gene string, gapped string")


def asked(spark, sequences):
    return spark.createDataFrame([(s, "alpha", "human") for s in sequences], "seq string, chain string, species string")


def test_numbers_and_genes_equal_the_fixture(spark, germline):
    cases = {}
    for i, n in enumerate([1, 2, 5, 8, 11, 12, 13, 14, 15, 18, 21]):
        v, j = list(V)[i % 3], list(J)[i % 2]
        s, numbers = domain(v, j, loop_of(n), lead="MKLV"[: i % 5], tail="TVSPNIQ" * (i % 3), swaps=i)
        cases[s] = (v, j, numbers)
    told = dict(WHERE["V1"])
    lost = next(n for n in range(66, 90) if told[n] not in (told[n - 1], told[n + 1]))  # its place can be told
    s, numbers = domain("V1", "J1", loop_of(9), drop=lost)
    cases[s] = ("V1", "J1", numbers)
    told = dict(WHERE["V2"])
    s, numbers = domain("V2", "J2", loop_of(10), insert=next(n for n in range(42, 60) if "W" not in (told[n], told[n + 1])))
    cases[s] = ("V2", "J2", numbers)
    df = asked(spark, [*cases, *cases, None])
    genes = {r.seq: (r.v_gene, r.j_gene) for r in numbering.genes(df, germline).collect()}
    assert genes == {s: c[:2] for s, c in cases.items()}
    found = {}
    for r in numbering.numbered(df, germline).collect():
        assert r.pos not in found.setdefault(r.seq, {})
        found[r.seq][r.pos] = r.imgt_num
    for s, (_, _, numbers) in cases.items():
        assert found[s] == numbers, s


def test_regions_from_raw_sequences(spark, germline):
    s, numbers = domain("V3", "J2", "GASGTS", swaps=3)
    rows = numbering.numbered(asked(spark, [s]), germline).withColumn("aa", F.substring("seq", F.col("pos") + 1, F.lit(1)))
    (r,) = region_sequences(rows, ["seq"]).collect()
    text = lambda lo, hi: "".join(s[p] for p, x in sorted(numbers.items()) if lo <= x <= hi)
    assert (r.cdr_1, r.cdr_2, r.cdr_2_5, r.cdr_3, r.fwr_4) == (text(27, 38), text(56, 65), text(81, 86), text(104, 118), text(119, 129))


def test_no_domain_and_two_domains_raise(spark, germline):
    one, _ = domain("V1", "J1", loop_of(8))
    two = one + "GGGSGGGSGGGS" + domain("V2", "J2", loop_of(7))[0]
    noise = "".join(rng.choice(LETTERS) for _ in range(130))
    with pytest.raises(Exception, match="no domain found"):
        numbering.numbered(asked(spark, [one, noise]), germline).collect()
    with pytest.raises(Exception, match="several domains"):
        numbering.numbered(asked(spark, [two]), germline).collect()
    kept = numbering.genes(asked(spark, [one, two, noise, "", "AC"]), germline, strict=False).collect()
    assert [r.seq for r in kept] == [one]
    assert numbering.genes(asked(spark, []), germline).collect() == []


def test_best_template_equals_all_templates_and_compares_few(spark):
    """Related templates, ties among them, and sequences near to none."""
    base = [rng.choice("ACDE") for _ in range(60)]
    many = {}
    for g in range(40):
        t = list(base) if g % 4 else [rng.choice("ACDE") for _ in range(60)]
        for i in rng.sample(range(60), g % 9):
            t[i] = rng.choice("ACDE")
        many[f"G{g:02}"] = "".join(t)
    many["G99"] = many["G05"]
    sequences = [s[: rng.randint(40, 60)] for s in many.values()] + ["".join(rng.choice("ACDE") for _ in range(rng.randint(3, 80))) for _ in range(20)] + ["WWWWW"]

    def best(s):
        out = []
        for g, t in many.items():
            for d in range(1 - len(t), len(s)):
                out.append((-sum(0 <= i + d < len(s) and s[i + d] == c for i, c in enumerate(t)), g, d))
        return min(out)

    genes = spark.createDataFrame([("h", "a", g, t, [1]) for g, t in many.items()], "species string, chain string, gene string, residues string, numbers array<int>")
    df = spark.createDataFrame([(i, "h", "a", s) for i, s in enumerate(sequences)], "id long, species string, chain string, seq string")
    found = {r.id: r for r in numbering.best_templates(df, genes)[0].collect()}
    for i, s in enumerate(sequences):
        score, gene, diagonal = best(s)
        assert (-found[i].score, found[i].gene, found[i].diagonal) == (score, gene, diagonal)
    near = [found[i].compared for i in range(41)]
    assert sum(near) / len(near) < 60  # of about 4,600 diagonals of each sequence


def test_banded_alignment():
    assert placed("XXABCDEFG", "ABCDEFG", 0, 4) == [2, 3, 4, 5, 6, 7, 8]
    assert placed("ABCXDEFGHIJ", "ABCDEFGHIJ", -2, 3) == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]
    assert placed("ABCDEGHIJ", "ABCDEFGHIJ", -3, 2) == [0, 1, 2, 3, 4, -1, 5, 6, 7, 8]


def test_templates_are_not_spelled_anew_for_each_sequence(spark):
    """A condition on the template as an expression of its gene would be carried over a join by gene."""
    table = spark.createDataFrame([("G1",), ("G2",)], "gene string").select(F.lit("human").alias("species"), F.lit("alpha").alias("chain"), F.lit("V").alias("kind"), "gene", F.sha2("gene", 256).alias("gapped"))
    calls = spark.createDataFrame([("G1", 1), ("G2", 2), ("G3", 3)], "gene string, n int")
    joined = calls.join(F.broadcast(numbering.templates(table, "V")), "gene")
    assert sorted((r.n, len(r.residues)) for r in joined.collect()) == [(1, 64), (2, 64)]
    conditions = [x for x in joined._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert conditions and not any("sha2" in x for x in conditions)


def test_templates_of_gaps_only_and_of_no_letters(spark):
    rows = [("h", "a", "V", "G1", "A.-C"), ("h", "a", "V", "G2", "...."), ("h", "a", "V", "G3", ""), ("h", "a", "V", "G4", None), (None, "a", "V", "G5", "." * 103 + "CW"), ("h", "a", "J", "G6", "." * 116 + "AFG")]
    df = spark.createDataFrame(rows, "species string, chain string, kind string, gene string, gapped string")
    assert sorted((r.gene, r.residues, r.numbers) for r in numbering.templates(df, "V").collect()) == [("G1", "AC", [1, 4]), ("G5", "C", [104])]
    assert [(r.gene, r.residues, r.numbers) for r in numbering.templates(df, "J").collect()] == [("G6", "FG", [118, 119])]


def test_few_bytes_of_sequences_go_to_many_tasks(spark, germline, monkeypatch):
    seen, best = [], numbering.best_templates
    monkeypatch.setattr(numbering, "best_templates", lambda asked, genes: seen.append(asked.rdd.getNumPartitions()) or best(asked, genes))
    numbering.genes(asked(spark, [domain("V1", "J1", loop_of(8))[0]]), germline).collect()
    assert seen[0] >= 4 * spark.sparkContext.defaultParallelism


def test_receptors_of_one_file_are_spelled_in_many_tasks(spark):
    df = receptors.receptors(spark, SF)
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert df.count() == spark.read.parquet(f"{SF}/supplier.parquet").count()
