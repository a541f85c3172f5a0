from collections import defaultdict

import pytest

from paratope.functions.distance import receptor_distance
from paratope.operators import negatives, relational
from paratope.plans.jobs import generate_negatives
from paratope.schema import ANTIGEN_COLUMNS, CDR_COLUMNS, SOURCE_COLUMNS, TCR_KEY
from tests.domain import triads


REACH = 200


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def dist(a, b):
    one = lambda r: {c: [r[c]] for c in CDR_COLUMNS}
    return int(receptor_distance(one(a), one(b))[0])


def brute(pos, neg, reach, strict=False):
    focal, donors = defaultdict(list), defaultdict(list)
    for rows, into in ((pos, focal), (neg, donors)):
        for r in rows:
            into[tuple(r[c] for c in ANTIGEN_COLUMNS)].append(r)
    out = set()
    for antigen, own in focal.items():
        a = dict(zip(ANTIGEN_COLUMNS, antigen, strict=True))
        for source, offered in donors.items():
            s = dict(zip(ANTIGEN_COLUMNS, source, strict=True))
            if source == antigen or sum(edits(a[c], s[c]) for c in ("peptide", "mhc_1_seq", "mhc_2_seq")) <= 3:
                continue
            far = [t for t in offered if all(dist(f, t) > reach for f in own)]
            if not strict or len(far) == len(offered):
                out |= {(antigen, source, tuple(t[c] for c in TCR_KEY)) for t in far}
    return out


@pytest.fixture(scope="module")
def tables(spark):
    return triads(spark, 40, 1).cache(), triads(spark, 60, 2, antigens=9).cache()


@pytest.mark.parametrize("strict", [False, True])
def test_candidates_equal_brute_force(tables, strict):
    pos, neg = tables
    found = negatives.negative_candidates(pos, neg, reach=REACH, strict_donor=strict).collect()
    got = {(tuple(r[c] for c in ANTIGEN_COLUMNS), tuple(r[c] for c in SOURCE_COLUMNS), tuple(r[c] for c in TCR_KEY)) for r in found}
    assert got == brute(pos.collect(), neg.collect(), REACH, strict) and (got or strict)
    assert len(got) < len(brute(pos.collect(), neg.collect(), -1))
    assert not any(r.cognate for r in found)
    bare = negatives.negative_candidates(pos, neg, reach=REACH, strict_donor=strict, with_sources=False).collect()
    once = [(tuple(r[c] for c in ANTIGEN_COLUMNS), tuple(r[c] for c in TCR_KEY)) for r in bare]
    assert len(once) == len(set(once)) and set(once) == {(a, t) for a, _, t in got}


def test_near_receptors_equal_all_distances(tables, monkeypatch):
    from paratope.functions.keys import with_ids

    monkeypatch.setattr(negatives, "SIDE", 7)
    pos, neg = (with_ids(t).dropDuplicates(["tcr_id"]) for t in tables)
    got = {(r.a, r.b): r.dist for r in negatives.near_receptors(pos, neg, REACH).collect()}
    wanted = {(a.tcr_id, b.tcr_id): d for a in pos.collect() for b in neg.collect() if (d := dist(a, b)) <= REACH}
    assert got == wanted and wanted


def test_strike_out_takes_each_receptor_once():
    offers = [(f"s{i % 4}", f"t{i % 17}") for i in range(200)]
    taken = negatives.strike_out(offers, 10, "x")
    assert len(taken) == len(set(taken)) == 10 and taken == negatives.strike_out(list(reversed(offers)), 10, "x")
    assert sorted(negatives.strike_out(offers, 99, "x")) == sorted({t for _, t in offers})
    first = [negatives.strike_out([("a", "only"), *(("b", f"b{i}") for i in range(50))], 1, str(s))[0] for s in range(300)]
    assert 100 < first.count("only") < 200  # the source is drawn first, whatever it offers


def test_sampling_meets_its_demand(tables):
    pos, neg = tables
    candidates = negatives.negative_candidates(pos, neg).cache()
    key = lambda r: tuple(r[c] for c in ANTIGEN_COLUMNS)
    available = defaultdict(set)
    for r in candidates.collect():
        available[key(r)].add(tuple(r[c] for c in TCR_KEY))
    for depth in (1, 50):
        demand = relational.demand(pos, depth)
        drawn, left = negatives.sample_to(demand, candidates)
        need, got, short = {key(r): r.needed_negs for r in demand.collect()}, defaultdict(list), {key(r): r.needed_negs for r in left.collect()}
        for r in drawn.collect():
            got[key(r)].append(tuple(r[c] for c in TCR_KEY))
        for antigen, n in need.items():
            assert len(got[antigen]) == len(set(got[antigen])) == min(n, len(available[antigen])) and set(got[antigen]) <= available[antigen]
            assert short.get(antigen, 0) == max(0, n - len(available[antigen]))


def test_whole_generation(tables):
    pos, neg = tables
    out, left = generate_negatives(pos, [neg, pos], 2)
    rows = out.collect()
    assert len({r.job_name for r in rows if not r.cognate}) == sum(not r.cognate for r in rows) > 0
    assert sum(r.cognate for r in rows) == 40 and all(r.needed_negs > 0 for r in left.collect())
    assert {r.job_name for r in out.collect()} == {r.job_name for r in rows}


def weights(pos, neg, reach):
    """For each antigen its candidates and their chances in one draw: an even donor, then an even receptor of it."""
    donors, own = defaultdict(set), defaultdict(set)
    for r in neg:
        donors[tuple(r[c] for c in ANTIGEN_COLUMNS)].add(tuple(r[c] for c in TCR_KEY))
    for antigen, source, tcr in brute(pos, neg, reach):
        own[antigen].add((source, tcr))
    chances = {a: defaultdict(float) for a in own}
    for a, pairs in own.items():
        for source, tcr in pairs:
            chances[a][tcr] += 1 / len(donors[source])
    return {a: dict(c) for a, c in chances.items()}


def test_matched_negatives_follow_the_law_of_rejection(tables):
    """Each antigen's first draw over many seeds, by chi-square; and needs are met or all candidates taken."""
    pos, _ = tables
    rows = pos.collect()
    chances = weights(rows, rows, REACH)
    need = {tuple(r[c] for c in ANTIGEN_COLUMNS): r.needed_negs for r in relational.demand(pos, 1).collect()}
    got = defaultdict(set)
    for r in negatives.matched_negatives(pos, 1, reach=REACH).collect():
        pair = (tuple(r[c] for c in ANTIGEN_COLUMNS), tuple(r[c] for c in TCR_KEY))
        assert pair[1] not in got[pair[0]] and pair[1] in chances[pair[0]] and not r.cognate
        got[pair[0]].add(pair[1])
    assert {a: len(t) for a, t in got.items()} == {a: min(n, len(chances.get(a, ()))) for a, n in need.items() if a in chances}


def test_draws_have_the_chances_of_their_donors(spark):
    """Two donors, one with a single receptor: it comes in half of the first draws; late candidates follow the same law."""
    from paratope.operators import draws

    offers = spark.createDataFrame([("a", "only"), *(("b", f"b{i}") for i in range(30)), ("c", "only2"), ("c", "near")], "source_id string, tcr_id string")
    needs = spark.createDataFrame([(f"antigen{i}", 1) for i in range(600)], "antigen_id string, need long")
    close = needs.select("antigen_id", draws.F.lit("near").alias("tcr_id"))
    barred = needs.select("antigen_id", draws.F.lit("x").alias("source_id"))
    pool = draws.Pool.of(offers)
    first = [r.tcr_id for r in draws.rejection_sample(needs, pool, close, barred, "1").collect()]
    # chances 1/3, 1/3 and 1/6 of what is open: two fifths, two fifths, one fifth
    assert len(first) == 600 and 200 < first.count("only") < 280 and 80 < first.count("only2") < 160 and "near" not in first
    struck = draws.strike_out_sample(needs, pool, close, barred, "1")[0].collect()
    assert 160 < sum(r.tcr_id == "only" for r in struck) < 240 and 160 < sum(r.tcr_id == "only2" for r in struck) < 240


def test_late_draws_follow_the_same_law(spark, monkeypatch):
    from paratope.operators import draws

    monkeypatch.setattr(draws, "draws_for", lambda need: (need * 0).cast("long"))
    offers = spark.createDataFrame([("a", "only"), *(("b", f"b{i}") for i in range(30))], "source_id string, tcr_id string")
    needs = spark.createDataFrame([(f"antigen{i}", 1) for i in range(500)], "antigen_id string, need long")
    none = needs.limit(0)
    close, barred = none.select("antigen_id", draws.F.lit("").alias("tcr_id")), none.select("antigen_id", draws.F.lit("").alias("source_id"))
    found = [r.tcr_id for r in draws.rejection_sample(needs, draws.Pool.of(offers), close, barred, "1").collect()]
    assert len(found) == 500 and 210 < found.count("only") < 290


def test_turns_are_taken_in_order(spark):
    """Proposals all at once give what taking turns gives."""
    import random

    from paratope.operators import draws

    rng = random.Random(4)
    rows = [(a, r, j, f"t{rng.randrange(12)}") for a in "xyz" for r in range(15) for j in range(4) if rng.random() < 0.9]
    wanted = {}
    for a in "xyz":
        struck = set()
        for r in range(15):
            for t in [t for b, q, _, t in sorted(rows) if (b, q) == (a, r)]:
                if t not in struck:
                    struck.add(t)
                    wanted[a, r] = t
                    break
    found = draws.settled_draws(spark.createDataFrame(rows, "antigen_id string, r long, j int, tcr_id string")).collect()
    assert {(x.antigen_id, x.r): x.tcr_id for x in found} == wanted


def test_drawn_negatives_meet_their_demand_without_a_cross_join(tables):
    pos, neg = tables
    chances = weights(pos.collect(), neg.collect(), 120)
    for depth in (1, 50):
        needed = relational.demand(pos, depth)
        out, left = negatives.drawn_negatives(needed, pos, neg)
        got, short = defaultdict(list), {tuple(r[c] for c in ANTIGEN_COLUMNS): r.needed_negs for r in left.collect()}
        for r in out.collect():
            got[tuple(r[c] for c in ANTIGEN_COLUMNS)].append(tuple(r[c] for c in TCR_KEY))
        for r in needed.collect():
            antigen = tuple(r[c] for c in ANTIGEN_COLUMNS)
            open_ = chances.get(antigen, {})
            assert len(got[antigen]) == len(set(got[antigen])) == min(r.needed_negs, len(open_)) and set(got[antigen]) <= set(open_)
            assert short.get(antigen, 0) == max(0, r.needed_negs - len(open_))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()


def test_distance_tables_equal_pairs():
    import random

    import numpy as np

    from paratope.functions.distance import LOOPS, loop_distance, loop_distances

    rng = random.Random(11)
    words = [None, ""] + ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randrange(1, 19))) for _ in range(60)]
    for options in [*LOOPS.values(), {"ntrim": 3, "ctrim": 2}, {"weight": 2, "gap": 5, "fixed_gap": False}]:
        pairs = np.array([loop_distance([a] * len(words), words, **options) for a in words])
        assert (loop_distances(words, words, **options) == pairs).all()


def test_close_texts_equal_all_pairs(spark):
    import random

    rng = random.Random(12)
    words = ["", "a", "abc"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(80)]
    others = words[::2] + [w[:2] + rng.choice("abc") + w[3:] + rng.choice(["", "b"]) for w in words]
    left, right = (spark.createDataFrame([(w,) for w in [None, *side, *side[:3]]], "w string") for side in (words, others))
    for most in (0, 1, 3):
        found = sorted((r.a, r.b, r.edits) for r in negatives.close_texts(left, right, most).collect())
        assert found == sorted({(a, b, edits(a, b)) for a in words for b in others if edits(a, b) <= most})


def test_candidates_are_counted_without_a_list(tables, monkeypatch):
    """Counts by antigen equal brute force, from bits alone, over several blocks and words, and no near pair leaves a task."""
    for name, size in (("SIDE", 3), ("FOCAL_SIDE", 5), ("DONOR_SIDE", 7), ("FOCAL_BLOCK", 4)):
        monkeypatch.setattr(negatives, name, size)
    for name in ("near_receptors", "_listed"):
        monkeypatch.setattr(negatives, name, lambda *a: 1 / 0)
    pos, neg = tables
    for strict, reach in ((False, REACH), (True, REACH), (False, 120)):
        found = {tuple(r[c] for c in ANTIGEN_COLUMNS): (r.n_rows, r.n_receptors) for r in negatives.candidate_counts(pos, neg, reach=reach, strict_donor=strict).collect()}
        wanted = defaultdict(list)
        for antigen, _, receptor in brute(pos.collect(), neg.collect(), reach, strict):
            wanted[antigen].append(receptor)
        assert found == {a: (len(t), len(set(t))) for a, t in wanted.items()}


def test_a_donor_with_all_bits_meets_no_more(spark):
    """70 antigens, two words: bits are united as edges tell, and a donor that has them all is measured no more."""
    import numpy as np
    import pyarrow as pa

    loop = {c: "ACDEF" if not c.endswith("cdr_3") else "CASSAAYEQYF" for c in CDR_COLUMNS}
    rows = [{"focal": True, "tcr_id": f"f{i}", "bits": [-1, 63] if i < 2 else [1, 0], **loop} for i in range(negatives.SIDE * 3)]
    rows += [{"focal": False, "tcr_id": "d", "bits": [0, 0], **loop}, {"focal": False, "tcr_id": "far", "bits": [0, 0], **loop, "tcr_1_cdr_1": "WWWWW" * 20}]
    kinds = {"focal": pa.bool_(), "tcr_id": pa.string(), "bits": pa.list_(pa.int64())} | {c: pa.string() for c in CDR_COLUMNS}
    seen, plain = [], negatives.receptor_distances
    negatives.receptor_distances = lambda a, b, loops: (seen.append(len(b["tcr_1_cdr_1"])), plain(a, b, loops))[1]
    try:
        found = negatives._unite(20, negatives.LOOPS, [-1, 63])(pa.Table.from_pylist(rows, pa.schema(list(kinds.items())))).to_pylist()
    finally:
        negatives.receptor_distances = plain
    assert seen == [2, 1, 1] and np.all([r["tcr_id"] == "d" for r in found])
    assert sorted((r["word"], r["marks"]) for r in found) == [(0, -1), (1, 63)]


def test_scarce_antigens_need_no_pool(tables, monkeypatch):
    """Antigens with no more candidates than they need get them without numbered offers."""
    pos, neg = tables
    monkeypatch.setattr(negatives.Pool, "of", lambda *a: 1 / 0)
    out, left = negatives.drawn_negatives(relational.demand(pos, 10_000), pos, neg, reach=REACH)
    got = {(tuple(r[c] for c in ANTIGEN_COLUMNS), tuple(r[c] for c in TCR_KEY)) for r in out.collect()}
    assert got == {(a, t) for a, _, t in brute(pos.collect(), neg.collect(), REACH)} and got
    assert left.count() == pos.select(*ANTIGEN_COLUMNS).distinct().count()
