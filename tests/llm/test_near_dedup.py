import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paratope.llm import near_dedup
from tests.llm.conftest import documents


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d)) for d in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.random()}"
    return " ".join(out)


def test_families_equal_brute_force(spark):
    rng = random.Random(5)
    rows, next_id = [], 0
    for family in range(12):
        base = [f"f{family}x{rng.randrange(400)}" for _ in range(rng.choice([6, 40, 150, 300]))]
        for _ in range(rng.choice([1, 2, 5, 9])):
            rows.append((next_id, edited(rng, base, rng.choice([0, 0, 1, 2, 4]))))
            next_id += 1
    rng.shuffle(rows)
    assert result(near_dedup.near_duplicates(documents(spark, rows))) == brute(rows)


def test_one_large_family_with_links_only_through_some_members(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, edited(rng, base, rng.choice([1, 2, 3]))) for i in range(120)]
    old = near_dedup.BLOCK, near_dedup.SMALL_BUCKET
    near_dedup.BLOCK, near_dedup.SMALL_BUCKET = 20, 4
    try:
        assert result(near_dedup.near_duplicates(documents(spark, rows))) == brute(rows)
    finally:
        near_dedup.BLOCK, near_dedup.SMALL_BUCKET = old


def test_blocks_give_the_components_of_their_links():
    rng = random.Random(3)
    base = [f"b{i}" for i in range(100)]
    texts = [edited(rng, base, rng.choice([0, 1, 2, 6])) for _ in range(40)]
    sets = near_dedup.shingle_sets([t.encode() for t in texts])
    table = pa.table({
        "key": pa.array([1] * 40), "i": pa.array([0] * 40), "j": pa.array([0] * 40), "side": pa.array([2] * 40),
        "id": pa.array(range(40)), "root": pa.array(range(40)), "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
    })
    links = near_dedup._block_links(table).to_pylist()
    wanted = brute(list(enumerate(texts)))
    root = list(range(40))
    for link in links:
        a, b = root[link["a"]], root[link["b"]]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert root == [wanted[i][1] for i in range(40)]
    assert len(links) <= 39


def test_cases(spark):
    long_text = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one\ttwo"), (6, "one two three four five"), (7, long_text), (8, long_text + " tail"), (9, "x" * 3_000_000)]
    got = result(near_dedup.near_duplicates(documents(spark, rows, extra=True)))
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (59_996, 7), 8: (59_997, 7), 9: (1, 9)}


def test_rows_without_id_and_repeated_rows(spark):
    rows = near_dedup.near_duplicates(documents(spark, [(None, "a b c"), (None, "a b c"), (2, "a b c"), (2, "a b c"), (1, "a b c")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False)]


def test_empty_table_and_dropping(spark, empty):
    assert near_dedup.near_duplicates(empty).collect() == []
    kept = near_dedup.drop_near_duplicates(documents(spark, [(3, "a b c"), (1, "A b C"), (2, "d")], extra=True))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and "bands" in kept.columns


def test_odd_sketch_estimates_similarity():
    rng = random.Random(1)
    base = [f"v{i}" for i in range(1000)]
    sets = near_dedup.shingle_sets([" ".join(base).encode(), *(edited(rng, base, n).encode() for n in (5, 15, 40))])
    _, _, sketch = near_dedup.signatures(sets)
    for i in (1, 2, 3):
        flips = sum(bin(int(a) ^ int(b) & (2**64 - 1)).count("1") if a >= 0 and b >= 0 else bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") for a, b in zip(sketch[:, 0], sketch[:, i], strict=True))
        k, n = near_dedup.BANDS * near_dedup.ROWS, near_dedup.SKETCH_BITS
        guess = 1 + n / (4 * k) * np.log(1 - 2 * flips / n)
        true = len(np.intersect1d(sets[0], sets[i])) / len(np.union1d(sets[0], sets[i]))
        assert abs(guess - true) < 0.13


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 501)], "a long, b long")
    found = {r.id: r.root for r in near_dedup.components(links).collect()}
    assert all(found[i] == 1 for i in range(2, 201)) and found[501] == 500


def test_rows_of_one_id_stay_together(spark):
    rows = [(1, "a b c"), (2, "a b c"), (2, "other words"), (3, "a b c"), (None, "a b c")]
    kept = near_dedup.drop_near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "a b c"), (1, "a b c"), (2, "a b c"), (2, "other words")]


def test_tables_can_be_dropped(spark):
    from paratope.llm import common

    df = common.materialize(spark.range(5), "test-drop")
    path = df.inputFiles()[0].removeprefix("file://")
    import os

    assert os.path.exists(path)
    common.drop_tables(spark)
    assert not os.path.exists(path) and common._WRITTEN.paths == []


def kept_by_brute_force(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, d), d)
    return sorted(least.values())


def test_the_stage_links_at_four_fifths(spark):
    import corpus_pipeline

    rng = random.Random(11)
    rows = []
    for family in range(60):
        base = [f"f{family}x{i}" for i in range(100)]
        rows += [(3 * family + copy, edited(rng, base, copy)) for copy in range(3)]
    stage = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "unused").collect())
    query = sorted(r.doc_id for r in near_dedup.near_duplicates(documents(spark, rows), 85).filter("kept").collect())
    assert stage == kept_by_brute_force(rows, 80) and query == kept_by_brute_force(rows, 85) and len(stage) < len(query)


def test_bands_follow_the_level():
    for percent, bands in ((85, 30), (80, 45)):
        assert near_dedup.bands_for(percent) == bands and (1 - (percent / 100) ** near_dedup.ROWS) ** bands < 2.5e-8
    assert near_dedup.most_flips(80) > near_dedup.most_flips(85)


def test_a_bucket_of_many_ranges_is_cut_evenly(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 1000)
    n = 100_000
    members = spark.range(n).selectExpr("IF(id % 100 = 0, id % 7, -1) AS key", "id", "id DIV 50 AS root", "1 AS size")
    placed = near_dedup._blocks(members).cache()
    assert placed.count() == n and placed.select("id").distinct().count() == n
    found = {(r.key, r.block): (r.n, r.lo, r.hi) for r in placed.groupBy("key", "block").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).collect()}
    hot = [v for (k, _), v in sorted(found.items()) if k == -1]
    assert [v[0] for v in hot] == [1000] * 99 and all(a[2] <= b[1] for a, b in zip(hot, hot[1:], strict=False))
    assert sum(v[0] for v in found.values()) == n
