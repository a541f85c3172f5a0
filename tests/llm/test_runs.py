import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from paratope.llm import queries, runs
from tests.conftest import SF
from tests.llm.conftest import documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=runs.LEAST):
    """All periods, each stretch of equal words that far apart; the smallest period of a stretch counts."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            seg = w[i : j + q]
            if len(seg) >= max(least, 2 * q) and not any(seg[d:] == seg[:-d] for d in range(1, q)):
                out.append((i, len(seg), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plant(w, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n = len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def answer(doc_id, text, planted=True):
    w = WORDS.findall(text or "")
    w = plant(w, doc_id) if planted and doc_id is not None else w
    found = brute(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    exponent = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, exponent, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("seed", range(4))
def test_sequences_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, kinds, kind = rng.randint(0, 60), rng.randint(1, 4), rng.random()
            w = [rng.randrange(kinds) for _ in range(n)]
            if kind < 0.5 and n:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w * 2 if kind < 0.2 else w)
        least = rng.choice([1, 2, 3, 5, 12])
        flat = np.array([x for w in texts for x in w], np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        begins = np.r_[0, np.cumsum([len(w) for w in texts])]
        got = list(zip(*(x.tolist() for x in runs.find_runs(flat, owner, least)), strict=True))
        assert got == [(int(begins[i]) + a, b, c) for i, w in enumerate(texts) for a, b, c in brute(w, least)]


def test_structured_sequences():
    """Words of Fibonacci, powers of one word and nested powers have the most repeats."""
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    for w in (b, [0] * 500, ([0] * 7 + [1]) * 20, (([0, 1] * 3 + [2]) * 4 + [3]) * 5, list(range(30)) * 3 + list(range(5, 30)) * 2):
        got = list(zip(*(x.tolist() for x in runs.find_runs(np.array(w), np.zeros(len(w), np.int64), 2)), strict=True))
        assert got == brute(w, 2)


def test_collapsed_texts_and_cases(spark):
    long = "same words again and " * 3000
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a " * 11), (6, "\ta\n" * 12), (7, "x " + "b c d\x0b" * 7 + "x"),
        (8, long), (8, long), (9, "A a " * 8), (10, ("a" * 17 + " " + "a" * 18 + " b ") * 6), (11, "a\0 a " * 8), (None, "a " * 30), (12, "é è " * 9 + "tail"), (13, "w " * 12 + "v w " * 6),
    ]
    df = documents(spark, rows, extra=True).selectExpr("*", "1 AS n_runs", "'x' AS runs", "2 AS start", "'y' AS collapsed")
    got = runs.repeat_runs(df, outputs=COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted((answer(i, t, False) for i, t in rows), key=str)
    full = {r["doc_id"]: r for r in runs.repeat_runs(df.filter("doc_id = 13 or doc_id = 2")).collect()}
    assert [tuple(x) for x in full[13]["runs"]] == brute(("w " * 12 + "v w " * 6).split())
    assert full[13]["collapsed"] == "w v"
    assert full[2]["collapsed"] == "" and full[2]["runs"] == []
    assert runs.repeat_runs(documents(spark, [])).count() == 0


def test_planted_texts(spark):
    rows = [(i, " ".join(f"w{j * j % 37}" for j in range(i % 90))) for i in range(300)] + [(20, None), (None, "a b c"), (54, "")]
    df = documents(spark, rows)
    got = df.select("doc_id", runs.planted(df.text, df.doc_id).alias("t")).collect()
    for (i, text), r in zip(rows, got, strict=True):
        words = WORDS.findall(text or "")
        assert WORDS.findall(r["t"] or "") == (plant(words, i) if i is not None else words)


def test_query_equals_brute_force(spark, docs):
    got = queries.QUERIES["op13_repeat_runs"](spark, SF).collect()
    want = [answer(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(r["n_runs"] for r in got)
