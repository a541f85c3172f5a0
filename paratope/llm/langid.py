"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here in numpy, by backpropagation through time, on windows of a bounded sample of
labelled documents (at most `SAMPLE_DOCS` a language, `SAMPLE_WINDOWS` windows spread over each whole
text). At prediction every byte of every text is labelled: texts are cut into windows of WINDOW bytes, both
directions run over each window, and a document's probabilities are the means over all its bytes.

Cases: null texts and texts without a letter are `und` with score 0, and so is every text when nothing is
labelled; null languages aren't learned; repeated rows are predicted each; an empty table gives an empty
result; extra columns are ignored; texts are whole, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paratope.llm.common import ship, worker_cache

UNDETERMINED = "und"
WINDOW = 64
HIDDEN = 8
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 6
#: Steps of training, whatever the sample's size.
STEPS, BATCH, RATE, SEED = 240, 256, 0.02, 7
#: Mean of the bytes' highest probabilities under which keep_identified() takes a text for no language that it knows; it doesn't fall with the number of languages in a text.
LEAST_CERTAINTY = 0.5
HAS_LETTER = r"\p{L}"
PAD = 256
BLOCK = 4096
GROUP_BYTES = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _windows(text: Column) -> Column:
    """SAMPLE_WINDOWS pieces of WINDOW characters, spread evenly over the text."""
    last = F.greatest(F.char_length(text) - WINDOW, F.lit(0))
    return F.array(*(F.substring(text, F.floor(last * (j / max(1, SAMPLE_WINDOWS - 1))).cast("int") + 1, F.lit(WINDOW)) for j in range(SAMPLE_WINDOWS)))


def training_sample(documents: DataFrame) -> list[tuple[str, list[str]]]:
    """(language, windows) of at most SAMPLE_DOCS documents a language, chosen by a hash of their ids."""
    labelled = documents.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("langid:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    counts = labelled.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return []
    below = None
    for r in counts:
        share = int(min(1.0, 1.5 * SAMPLE_DOCS / r["count"]) * 2**32)
        below = F.when(F.col("lang") == r["lang"], share) if below is None else below.when(F.col("lang") == r["lang"], share)
    drawn = labelled.withColumn("_draw", draw).filter(F.col("_draw") < below).select("lang", "_draw", _windows(F.col("text")).alias("w"))
    rows = drawn.orderBy("_draw", "lang", "w").limit(2 * SAMPLE_DOCS * len(counts)).collect()
    taken: dict[str, int] = {}
    out = []
    for r in rows:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= SAMPLE_DOCS:
            out.append((r["lang"], list(dict.fromkeys(r["w"]))))
    return out


def _byte_rows(pieces: list[bytes]) -> np.ndarray:
    """(WINDOW, pieces) byte numbers, PAD after each piece's end."""
    out = np.full((len(pieces), WINDOW), PAD, np.int16)
    for i, p in enumerate(pieces):
        out[i, : len(p)] = np.frombuffer(p, np.uint8)
    return np.ascontiguousarray(out.T)


class Network:
    """Both directions stand side by side: table (2, 3H, 257) holds a byte's input to the gates z, r, n; u (2, 3H, H) the recurrent weights; v (L, 2H) and c (L) the output."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.langs, self.h = langs, hidden
        self.table, self.u = f(2, 3 * hidden, PAD + 1, scale=0.3), f(2, 3 * hidden, hidden, scale=hidden**-0.5)
        self.v, self.c = f(len(langs), 2 * hidden, scale=0.3), np.zeros(len(langs), np.float32)
        self._still()

    def _still(self) -> None:
        """On a pad byte the update gate is shut, so a state stays as it is."""
        self.table[:, :, PAD] = 0
        self.table[:, : self.h, PAD] = -60

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        np.negative(x, out=x)
        np.exp(x, out=x)
        x += 1
        return np.reciprocal(x, out=x)

    def states(self, rows: np.ndarray, keep: bool = False):
        """The states (2, T + 1, H, B) of both directions over rows (T, B); direction 1 reads from the end. keep: also the gates, for training."""
        steps, n = rows.shape
        h = self.h
        out = np.zeros((2, steps + 1, h, n), np.float32)
        kept = []
        for d in range(2):
            table, u = self.table[d], self.u[d]
            for t in range(steps):
                state = out[d, t]
                x = np.take(table, rows[t if d == 0 else steps - 1 - t], axis=1)
                g = u @ state
                zr = x[: 2 * h]
                zr += g[: 2 * h]
                np.maximum(zr, -60, out=zr)
                self._sigmoid(zr)
                cand = g[2 * h :] * zr[h:]
                cand += x[2 * h :]
                np.tanh(cand, out=cand)
                if keep:
                    kept.append((zr, cand, g[2 * h :]))
                new = out[d, t + 1]
                np.subtract(cand, state, out=new)
                new *= zr[:h]
                new += state
        return (out, kept) if keep else out

    def probabilities(self, states: np.ndarray, t: int) -> np.ndarray:
        """(L, B) at position t."""
        steps = states.shape[1] - 1
        p = self.v[:, : self.h] @ states[0, t + 1] + self.v[:, self.h :] @ states[1, steps - t] + self.c[:, None]
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        return p

    def label_sums(self, rows: np.ndarray) -> np.ndarray:
        """(B, L + 1): each window's probabilities, and the highest of each byte, added up over its bytes."""
        states, total = self.states(rows), np.zeros((len(self.langs) + 1, rows.shape[1]), np.float32)
        real = rows != PAD
        for t in range(rows.shape[0]):
            p = self.probabilities(states, t)
            p *= real[t]
            total[:-1] += p
            total[-1] += p.max(0)
        return total.T

    def train(self, rows: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> None:
        """Adam on the mean cross-entropy of all bytes; gradients flow back through every step of a window."""
        rng = np.random.default_rng(SEED)
        params = [self.table, self.u, self.v, self.c]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if not len(order):
                order = rng.permutation(len(labels))
            pick, order = order[:BATCH], order[BATCH:]
            grads = self.gradients(rows[:, pick], labels[pick])
            rate = RATE * (1 - 0.9 * step / steps)
            for p, g, m, s in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            self._still()

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        steps, n = rows.shape
        h = self.h
        states, kept = self.states(rows, keep=True)
        real = (rows != PAD).astype(np.float32)
        weight = real / real.sum()
        d_out = np.zeros((2, steps, h, n), np.float32)
        g_v, g_c = np.zeros_like(self.v), np.zeros_like(self.c)
        for t in range(steps):
            e = self.probabilities(states, t)
            e[labels, np.arange(n)] -= 1
            e *= weight[t]
            g_c += e.sum(1)
            for d, at in ((0, t), (1, steps - 1 - t)):
                g_v[:, d * h : (d + 1) * h] += e @ states[d, at + 1].T
                d_out[d, at] = self.v[:, d * h : (d + 1) * h].T @ e
        g_table, g_u = np.zeros_like(self.table), np.zeros_like(self.u)
        for d in range(2):
            back = np.zeros((h, n), np.float32)
            flat = g_table[d].T.copy()
            for t in reversed(range(steps)):
                zr, cand, gn = kept[d * steps + t]
                z, r, state = zr[:h], zr[h:], states[d, t]
                back = back + d_out[d, t]
                d_cand = back * z * (1 - cand * cand)
                d_g = np.concatenate([back * (cand - state) * z * (1 - z), d_cand * gn * r * (1 - r), d_cand * r])
                d_x = d_g.copy()
                d_x[2 * h :] = d_cand
                np.add.at(flat, rows[t if d == 0 else steps - 1 - t], d_x.T)
                g_u[d] += d_g @ state.T
                back = back * (1 - z) + self.u[d].T @ d_g
            g_table[d] = flat.T
        return [g_table, g_u, g_v, g_c]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, L + 1): mean probabilities over all bytes of each text, and the mean of the highest ones; empty texts give zeros."""
        out = np.zeros((len(texts), len(self.langs) + 1), np.float64)
        joined = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        n_windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), n_windows)
        starts = np.repeat(ends - sizes - WINDOW * (np.cumsum(n_windows) - n_windows), n_windows) + WINDOW * np.arange(n_windows.sum())
        for a in range(0, len(owner), BLOCK):
            at, own = starts[a : a + BLOCK], owner[a : a + BLOCK]
            place = at[None, :] + np.arange(WINDOW)[:, None]
            rows = joined[np.minimum(place, len(joined) - 1)].astype(np.int64)
            rows[place >= ends[own][None, :]] = PAD
            np.add.at(out, own, self.label_sums(rows))
        return out / np.maximum(sizes, 1)[:, None]


def fit(documents: DataFrame) -> Network | None:
    """Trains on the driver, on the bounded sample; None when nothing is labelled."""
    sample = training_sample(documents)
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return None
    net = Network(langs)
    pieces, labels = [], []
    for lang, windows in sample:
        for w in windows:
            pieces.append(w.encode()[:WINDOW])
            labels.append(langs.index(lang))
    net.train(_byte_rows(pieces).astype(np.int64), np.array(labels))
    return net


def predict(documents: DataFrame, net: Network | None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns, lang_pred, score and certainty, the mean of the bytes' highest probabilities."""
    spark = documents.sparkSession
    chosen = documents.select(*keys, F.when(F.regexp_like("text", F.lit(HAS_LETTER)), F.col("text")).alias("text"))
    if net is None:
        return chosen.select(*keys, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("certainty"))
    ship(spark)
    shared = spark.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("langid")
        own = shared.value
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch.column(len(keys)).to_pylist()]
            langs, scores, certainties, a = [], [], [], 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= GROUP_BYTES):
                    size += len(texts[b])
                    b += 1
                p = own.pooled(texts[a:b])
                for t, row in zip(texts[a:b], p, strict=True):
                    best = int(row[:-1].argmax())
                    langs.append(own.langs[best] if t else UNDETERMINED)
                    scores.append(min(1.0, float(row[best])) if t else 0.0)
                    certainties.append(float(row[-1]) if t else 0.0)
                a = b
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(certainties, pa.float64())], names=[*keys, "lang_pred", "score", "certainty"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{fields}, lang_pred string, score double, certainty double")


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a network fit on the labelled documents that aren't held out."""
    return predict(documents, fit(documents)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(documents: DataFrame, least: float = LEAST_CERTAINTY) -> DataFrame:
    """The documents whose language can be told: those with a letter whose bytes' labels reach the least certainty; all their columns stay. Where nothing is labelled, all with a letter stay."""
    net = fit(documents)
    if net is None:
        return documents.filter(F.regexp_like("text", F.lit(HAS_LETTER)))
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), "text")
    judged = predict(rows, net, ("row",))
    return judged.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("certainty") >= least)).select("row.*")
