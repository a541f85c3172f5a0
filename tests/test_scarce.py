"""Antigens whose candidates don't suffice, and bits of antigens, as they are common in large tables."""

from paratope.operators import draws, negatives


def test_scarce_antigens_are_not_drawn(spark, monkeypatch):
    offers = spark.createDataFrame([(s, f"t{i}") for s in "pq" for i in range(5)], "source_id string, tcr_id string")
    needs = spark.createDataFrame([("a", 9)], "antigen_id string, need long")
    close = spark.createDataFrame([("a", "t0")], "antigen_id string, tcr_id string")
    barred = spark.createDataFrame([("a", "p")], "antigen_id string, source_id string")
    monkeypatch.setattr(draws.Pool, "drawn", lambda *a: 1 / 0)
    found = draws.rejection_sample(needs, draws.Pool.of(offers), close, barred, "1").collect()
    assert sorted((r.antigen_id, r.tcr_id) for r in found) == [("a", f"t{i}") for i in range(1, 5)]


def test_an_item_has_one_row_for_64_antigens(spark):
    rows = [(f"r{i % 3}", f"a{i:03}") for i in range(150)]
    pairs = spark.createDataFrame(rows, "tcr_id string, antigen_id string")
    place = spark.createDataFrame([(f"a{i:03}", i) for i in range(150)], "antigen_id string, no long")
    marks = negatives.marked(pairs, "tcr_id", place)
    assert marks.count() == 9
    assert sorted((r.tcr_id, r.antigen_id) for r in negatives.unmarked(marks, "tcr_id", place).collect()) == sorted(rows)
