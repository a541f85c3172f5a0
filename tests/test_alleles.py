import random

import pytest

from paratope.functions.distance import longest_common_substring
from paratope.functions.substrings import SubstringIndex
from paratope.operators import alleles


@pytest.mark.parametrize("letters", ["ab", "abé日"])
def test_index_equals_all_pairs(letters):
    rng = random.Random(len(letters))
    for _ in range(300):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 7))]
        index = SubstringIndex(texts)
        for asked in ("", "x", texts[0], *("".join(rng.choice(letters + "xñ") for _ in range(rng.randint(0, 14))) for _ in range(4))):
            sizes = [longest_common_substring(asked, t) for t in texts]
            assert index.best(asked) == (max(sizes), sizes.index(max(sizes)))


def test_lookups_grow_with_the_sequence_not_with_the_alleles():
    rng = random.Random(2)
    base = [rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(200)]
    related = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") if rng.random() < 0.03 else c for c in base) for _ in range(400)]
    asked = related[17][:90] + "W" + related[17][91:]
    probes = []
    for n in (50, 400):
        index = SubstringIndex(related[:n])
        index.best(asked)
        probes.append(index.probes)
    assert max(probes) < 4 * len(asked)


def reference(spark):
    rows = [("alpha", "human", "A1", "GGGWWWCDE", "Partial", 1), ("alpha", "human", "A2", "GGGWWWHHH", "Full", 2), ("beta", "human", "B1", "GGGWWWCDE", "Full", 1), ("heavy", "human", "H1", "KKKLLLMMM", "Full", 1), ("alpha", "mouse", "M1", "GGGWWWCDEFGH", "Full", 1), ("heavy", "human", "H0", None, "Full", 0)]
    return spark.createDataFrame(rows, "chain string, species string, name string, sequence string, status string, ord int")


@pytest.mark.parametrize("most", [1, 100])
def test_matches_by_chain_and_of_unknown_chains(spark, most):
    """By the index and, where the reference is too large for it, by pairs."""
    rows = [("xGGGWWWy", "alpha", "human"), ("GGGWWWCD", "alpha", "human"), ("GGGWWWCD", None, "human"), ("KKKLLx", None, "human"), ("GGGWWWCDEF", None, "mouse"), ("GGG", "light", "human"), (None, "alpha", "human"), ("GGG", "alpha", "rat"), ("zz", "heavy", "human"), ("zz", None, "human")]
    df = spark.createDataFrame(rows, "seq string, chain string, species string")
    found = {(r.seq, r.chain, r.species): (r["name"], r["size"]) for r in alleles.match_alleles(df, reference(spark), most).collect()}
    assert found == {
        ("xGGGWWWy", "alpha", "human"): ("A2", 6), ("GGGWWWCD", "alpha", "human"): ("A1", 8), ("GGGWWWCD", None, "human"): ("B1", 8), ("KKKLLx", None, "human"): ("H1", 5),
        ("GGGWWWCDEF", None, "mouse"): ("M1", 10), ("zz", "heavy", "human"): ("H0", 0), ("zz", None, "human"): ("A2", 0),
    }


@pytest.mark.parametrize("most", [1, 3])
def test_equal_sequences_are_indexed_once(spark, monkeypatch, most):
    """Many alleles of few sequences: the preferred of each is indexed, however many rows the reference has."""
    rows = [("alpha", "human", f"A{i:03}", ("GGGWWWCDE", "KKKLLLMMM", None)[i % 3], "Full" if i > 90 else "Partial", i) for i in range(120)]
    ref = spark.createDataFrame(rows, "chain string, species string, name string, sequence string, status string, ord int")
    calls = []
    monkeypatch.setattr(alleles, "common_size", lambda a, b, plain=alleles.common_size: (calls.append(1), plain(a, b))[1])
    df = spark.createDataFrame([("xGGGWW", "alpha", "human"), ("KKKL", None, "human"), ("zz", "alpha", "human")], "seq string, chain string, species string")
    found = {r.seq: (r["name"], r["size"], r.status) for r in alleles.match_alleles(df, ref, most).collect()}
    assert found == {"xGGGWW": ("A093", 5, "Full"), "KKKL": ("A091", 4, "Full"), "zz": ("A091", 0, "Full")}
    assert bool(calls) == (most == 1)
