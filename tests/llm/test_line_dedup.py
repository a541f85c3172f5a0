import random
import zlib
from collections import defaultdict

import numpy as np

from paratope.llm import line_dedup
from tests.llm.conftest import documents


def key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def brute(rows, min_chars=20, min_docs=3):
    """rows: distinct doc_ids."""
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    hot = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if hot.get(key(x), d) == d]
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def result(df):
    return {r.doc_id: (r.text, r._n_lines, r._n_dropped) for r in df.collect()}


def test_equals_brute_force_over_many_partitions(spark):
    rng = random.Random(4)
    common = [f"  Common line number {i} with words \t" for i in range(12)] + ["short", "x" * 20, "é" * 20, "X" * 20]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.6 else f"own line {rng.random()} of the text" for _ in range(rng.randrange(1, 12)))) for i in range(400)]
    rows += [(1000 + i, "the very common line of all documents\n" * rng.randrange(1, 5) + "tail") for i in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(line_dedup.dedup_lines(documents(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_runs_longer_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOLD", 10)
    stream = line_dedup._stream_runs(3)
    import pyarrow as pa

    n = 100
    cols = [np.repeat([1, 2, 3], [5, n, 5]), np.zeros(n + 10, np.int64), np.ones(n + 10, bool), np.r_[np.arange(5), np.arange(n) // 2, np.arange(5)], np.zeros(n + 10, np.int64), np.zeros(n + 10, np.int32)]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "has_doc", "doc", "th", "pos"])
    out = [r for b in stream(iter([whole.slice(i, 7) for i in range(0, n + 10, 7)])) for r in b.to_pylist()]
    opened = [r for r in out if r["kind"] == line_dedup.OPEN and r["h1"] == 2]
    summary = [r for r in out if r["kind"] == line_dedup.SUMMARY and r["h1"] == 2]
    assert len(opened) == n and summary[0]["doc"] == 49 and len(summary[0]["docs"]) == 3
    assert {r["h1"] for r in out if r["kind"] == line_dedup.SUMMARY} == {1, 2, 3}


def test_cases(spark, empty):
    shared = "a line that three documents share"
    rows = [(1, None), (2, ""), (3, shared), (4, f"{shared}\nown\n{shared.upper()}"), (5, f" {shared}\t"), (6, "\n" * 5), (7, "z" * 500_000 + "\n" + "y" * 19), (8, shared.replace("a", "é"))]
    assert result(line_dedup.dedup_lines(documents(spark, rows, extra=True))) == brute(rows)
    assert line_dedup.dedup_lines(empty).collect() == [] and line_dedup.keep_bitmaps(empty).collect() == []


def test_repeated_and_missing_ids(spark):
    shared = "a line that some documents share"
    rows = [(None, shared), (2, shared), (2, shared + "\nx"), (2, shared), (1, shared)]
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.text, r._n_dropped) for r in line_dedup.dedup_lines(documents(spark, rows)).collect())
    assert found == [(-1, "", 1), (1, "", 1), (2, shared, 0), (2, shared, 0), (2, shared + "\nx", 0)]


def test_bitmaps_are_compressed_and_hold_the_lines_that_go(spark):
    shared = [f"shared line of text number {i}" for i in range(3)]
    rows = [(d, "\n".join(["first", *shared, "last"])) for d in range(4)]
    maps = {r.doc: r for r in line_dedup.keep_bitmaps(documents(spark, rows)).collect()}
    assert sorted(maps) == [0, 1, 2] and all(m.n_dropped == 3 for m in maps.values())
    bits = np.unpackbits(np.frombuffer(zlib.decompress(maps[0].keep), np.uint8), bitorder="little")
    assert bits[:5].tolist() == [1, 0, 0, 0, 1]
