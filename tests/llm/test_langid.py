import zlib

import numpy as np
import pytest

from paratope.llm import langid
from tests.llm.conftest import documents


def plain_probabilities(net, text):
    """(bytes, L): the labels' probabilities, step by step as the equations have them."""
    data, out = text.encode(), []
    squash = lambda x: 1 / (1 + np.exp(-x))

    def step(d, byte, state):
        x, g, h = net.table[d][:, byte].astype(float), net.u[d].astype(float) @ state, net.h
        z, r = squash(x[:h] + g[:h]), squash(x[h : 2 * h] + g[h : 2 * h])
        return (1 - z) * state + z * np.tanh(x[2 * h :] + r * g[2 * h :])

    for a in range(0, len(data), langid.WINDOW):
        window, sides = data[a : a + langid.WINDOW], []
        for d, order in ((0, window), (1, window[::-1])):
            state, states = np.zeros(net.h), []
            for byte in order:
                state = step(d, byte, state)
                states.append(state)
            sides.append(states if d == 0 else states[::-1])
        for forward, backward in zip(*sides, strict=True):
            e = np.exp(net.v.astype(float) @ np.concatenate([forward, backward]) + net.c)
            out.append(e / e.sum())
    return np.array(out).reshape(-1, len(net.langs))


def plainly_identified(net, text):
    return any(c.isalpha() for c in text or "") and plain_probabilities(net, text).max(1).mean() >= langid.LEAST_CERTAINTY


@pytest.fixture(scope="module")
def net(docs):
    return langid.fit(docs)


def test_held_out_accuracy(spark, docs, net):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = langid.predict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), net).collect()
    judged = [(r.lang_pred == truth[r.doc_id][0]) for r in found if truth[r.doc_id][0] and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean(judged) > 0.97


def test_query_equals_plain_network(spark, docs):
    chosen = docs.filter("length(text) < 700").limit(60).unionByName(documents(spark, [(10**6, None), (10**6 + 1, "1 2"), (10**6 + 2, "é" * 70)]))
    net = langid.fit(chosen)
    found = {r.doc_id: r for r in langid.identify(chosen).collect()}
    for d in chosen.collect():
        r = found[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)
        if not any(c.isalpha() for c in d.text or ""):
            assert (r.lang_pred, r.score) == (langid.UNDETERMINED, 0.0)
            continue
        mean = plain_probabilities(net, d.text).mean(0)
        assert r.score == pytest.approx(mean.max(), abs=1e-4) and mean[net.langs.index(r.lang_pred)] > mean.max() - 1e-4


def test_columns_and_held_out(docs, net):
    rows = langid.predict(docs, net).withColumn("held_out", langid.held_out(langid.F.col("doc_id"))).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == docs.count()


def test_gradients_are_those_of_the_loss():
    net = langid.Network(["a", "b", "c"], hidden=3)
    net.table, net.u, net.v, net.c = (x.astype(np.float64) for x in (net.table, net.u, net.v, net.c))
    rows = langid._byte_rows([b"hello", b"x" * 64, b"abcab" * 12]).astype(np.int64)
    labels = np.array([0, 1, 2])

    def loss():
        states, w, total = net.states(rows), rows != langid.PAD, 0.0
        for t in range(langid.WINDOW):
            total -= (np.log(net.probabilities(states, t)[labels, np.arange(3)]) * w[t]).sum()
        return total / w.sum()

    for values, grads in zip((net.table, net.u, net.v, net.c), net.gradients(rows, labels), strict=True):
        at = np.unravel_index(np.abs(grads[..., : langid.PAD] if values is net.table else grads).argmax(), grads[..., : langid.PAD].shape if values is net.table else grads.shape)
        step, old = 1e-2, values[at]
        values[at] = old + step
        up = loss()
        values[at] = old - step
        down = loss()
        values[at] = old
        assert (up - down) / (2 * step) == pytest.approx(grads[at], rel=0.02, abs=1e-5)


def test_pooling_covers_every_byte_and_ignores_neighbours(net):
    text = ("the and of " * 40).encode()
    alone, together = net.pooled([text])[0], net.pooled([b"la de un", text, b""])
    assert np.allclose(alone, together[1], atol=1e-5) and not together[2].any()
    windows = [text[i : i + langid.WINDOW] for i in range(0, len(text), langid.WINDOW)]
    sums = net.label_sums(langid._byte_rows(windows).astype(np.int64)).sum(0)
    assert np.allclose(alone, sums / len(text), atol=1e-5) and alone[:-1].sum() == pytest.approx(1, abs=1e-4)


def test_cases(spark, net, empty):
    rows = [(1, None), (2, ""), (3, "123 $$ \n"), (4, "The and of the " * 20_000), (4, "a"), (None, "der und die")]
    found = langid.predict(documents(spark, rows, extra=True), net).collect()
    assert [(r.lang_pred, r.score) for r in found[:3]] == [("und", 0.0)] * 3
    assert all(r.lang_pred in net.langs for r in found[3:])
    assert langid.predict(empty, net).collect() == []


def test_nothing_to_learn_from(spark, empty):
    assert langid.identify(empty).collect() == []
    assert {(r.lang_pred, r.score) for r in langid.identify(documents(spark, [(1, "abc"), (2, None)])).collect()} == {("und", 0.0)}


def test_texts_of_several_languages_stay(spark, docs):
    by_lang = {}
    for r in docs.filter("lang IS NOT NULL AND length(text) > 400").collect():
        by_lang.setdefault(r.lang, r.text[:400])
    mixed = documents(spark, [(10**6, "\n".join(by_lang.values()))])
    assert len(by_lang) > 2 and langid.keep_identified(docs.unionByName(mixed)).filter("doc_id = 1000000").count() == 1


def test_keeping_identified_documents(spark, docs):
    kept = langid.keep_identified(docs.unionByName(documents(spark, [(10**6, "12 34"), (10**6 + 1, None)])))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and not ids & {10**6, 10**6 + 1} and len(ids) == docs.count()
