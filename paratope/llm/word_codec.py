"""Encoding and decoding for merge vocabularies with word ends, by a lexicon of the corpus's frequent words.

Texts are cut at white space and where letters meet signs, wherever no token can span the cut. All chunks of
the corpus are counted; the most frequent ones, up to WORDS, are encoded once on the driver and compiled into a
minimal acyclic transducer (`lexicon`), which is sent to the executors as a file and mapped into memory
there. Chunks outside it are normalised and cut into words as the tokenizer's file says and merged here,
by rank and from the left; how many words the lexicon holds changes the cost, never the ids.

Cases: null and empty texts have no ids and decode to an empty text; special tokens in a text are tokens, as
the library has it; repeated rows are encoded each; an empty table gives an empty result; only `key` columns
are carried; texts are whole, of any length. Tokenizers with other parts than this kind's raise.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paratope.llm.chunks import KeyTable, byte_groups
from paratope.llm.common import drop_tables, materialize, ship, worker_cache, written
from paratope.llm.lexicon import Lexicon, compile_lexicon
from paratope.llm.runs import numbered

#: Words of the lexicon at most: what the driver sees of the corpus.
WORDS = 1 << 17
#: Counts that are told apart one by one when the lexicon is chosen.
EXACT = 4096
#: Bytes of the longest chunk that is counted and may enter the lexicon.
LONGEST = 64
#: Symbols of the longest word that is merged by looking at all its pairs; longer ones use a heap.
SCAN = 48
#: Chunks outside the lexicon whose ids a worker keeps.
KEPT = 300_000
END = "</w>"
NEVER = np.iinfo(np.int32).max
_U = np.uint64
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII signs that no word holds; an apostrophe may begin one.
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN[[39, *range(48, 58)]] = False
_SIGN &= ~_LETTER


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: its own where that is printable in Latin-1, else the next from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordCodec:
    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        j = json.loads(spec)
        model, steps = j["model"], j["normalizer"]["normalizers"] if (j["normalizer"] or {}).get("type") == "Sequence" else []
        cuts = (j["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
            and model["type"] == "BPE" and model["end_of_word_suffix"] == END and not model["dropout"] and not model["continuing_subword_prefix"] and not model.get("ignore_merges")
            and j["decoder"] is None and not any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in j["added_tokens"])
        )
        if not plain:
            raise ValueError("a lower-casing merge vocabulary with word ends, and no decoder, is needed")
        ids = model["vocab"]
        self.specials = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.special = re.compile("|".join(sorted(map(re.escape, self.specials), key=len, reverse=True))) if self.specials else None
        symbols = byte_symbols()
        self.inner, self.ends = [ids[s] for s in symbols], [ids[s + END] for s in symbols]
        self.of_symbol = {s: b for b, s in enumerate(symbols)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        left, right = np.array(list(self.merges), np.int64).reshape(-1, 2).T
        ranks, self.made = np.array(list(self.merges.values()), np.int64).reshape(-1, 2).T
        self.ranks = np.r_[ranks, NEVER].astype(np.int32)
        self.pairs = KeyTable(max(4, len(ranks).bit_length() + 1))
        self.pairs.insert(left.astype(_U) + _U(1), right.astype(_U), np.arange(len(ranks), dtype=np.int32))
        self.inner_row, self.ends_row = np.array(self.inner), np.array(self.ends)
        size = 1 + max([*ids.values(), *self.specials.values()])
        self.tokens, self.decimals = [""] * size, [str(i) for i in range(size)]
        for token, i in [*ids.items(), *self.specials.items()]:
            self.tokens[i] = token

    def merge(self, word: bytes) -> list[int]:
        """The ids of a normalised word."""
        ids = [self.inner[b] for b in word[:-1]] + [self.ends[word[-1]]]
        if len(ids) > SCAN:
            return self._merge_long(ids)
        get = self.merges.get
        pairs = [get(p) for p in zip(ids, ids[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, p in enumerate(pairs):
                if p is not None and (best is None or p < best):
                    best, at = p, i
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get((ids[at], ids[at + 1]))
            if at:
                pairs[at - 1] = get((ids[at - 1], ids[at]))

    def _pairs_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The numbers of pairs of ids that merge; -1, which is also the last rank, of others."""
        return self.pairs.find(left.astype(_U).ravel() + _U(1), right.astype(_U).ravel()).reshape(left.shape)

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """The ids of normalised words of one length: each step merges the best pair of every word that has one."""
        n, size = len(words), len(words[0])
        table = self.inner_row[np.frombuffer(b"".join(words), np.uint8).reshape(n, size)]
        table[:, -1] = self.ends_row[[w[-1] for w in words]]
        out: list[list[int]] = [[]] * n
        rows, pair = np.arange(n), self._pairs_of(table[:, :-1], table[:, 1:])
        while len(rows):
            at = np.arange(len(rows))
            best = self.ranks[pair].argmin(1) if pair.shape[1] else at * 0  # the leftmost of equals
            open_ = pair[at, best] >= 0 if pair.shape[1] else at < 0
            for i, ids in zip(rows[~open_].tolist(), table[~open_].tolist(), strict=True):
                out[i] = ids
            rows, table, pair, best = rows[open_], table[open_], pair[open_], best[open_]
            if not len(rows):
                break
            at = at[: len(rows)]
            table[at, best] = self.made[pair[at, best]]
            stays = np.ones(table.shape, bool)
            stays[at, best + 1] = False
            table = table[stays].reshape(len(rows), -1)
            pair = pair[stays[:, 1:]].reshape(len(rows), -1)
            for side in (best - 1, best):
                near = np.flatnonzero((side >= 0) & (side < pair.shape[1]))
                pair[near, side[near]] = self._pairs_of(table[near, side[near]], table[near, side[near] + 1])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i, p[1]) for i in range(n - 1) if (p := get((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            rank, i, made = heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or get((ids[i], ids[j])) != (rank, made):
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := get((made, ids[k]))) is not None:
                    heappush(heap, (p[0], i, p[1]))
            if (h := before[i]) >= 0 and (p := get((ids[h], made))) is not None:
                heappush(heap, (p[0], h, p[1]))
        return [i for i in ids if i >= 0]

    def chunk_ids(self, chunk: str) -> list[int]:
        """The ids of any text."""
        if chunk.isalpha() and max(chunk) <= "\xff":  # one word, which lower case alone normalises
            return self.merge(chunk.lower().encode())
        out, at = [], 0
        for m in self.special.finditer(chunk) if self.special else ():
            out += self._plain_ids(chunk[at : m.start()])
            out.append(self.specials[m[0]])
            at = m.end()
        return out + self._plain_ids(chunk[at:])

    def many_ids(self, chunks: list[bytes]) -> list[list[int]]:
        """The ids of chunks; single words of one length are merged side by side."""
        out: list[list[int]] = [[]] * len(chunks)
        by_size: dict[int, tuple[list[int], list[bytes]]] = {}
        for i, chunk in enumerate(chunks):
            text = chunk.decode()
            if len(chunk) <= SCAN and text.isalpha() and max(text) <= "\xff":
                own = by_size.setdefault(len(chunk), ([], []))
                own[0].append(i)
                own[1].append(text.lower().encode())
            else:
                out[i] = self.chunk_ids(text)
        for places, words in by_size.values():
            for i, ids in zip(places, self.merge_many(words), strict=True):
                out[i] = ids
        return out

    def _plain_ids(self, text: str) -> list[int]:
        if not text:
            return []
        text = self.library.normalizer.normalize_str(text)
        return [i for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text) if word for i in self.merge(bytes(self.of_symbol[s] for s in word))]

    def chunks(self, data: np.ndarray, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the chunks of texts begin and how long they are."""
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = at[at < len(data)]
        first[begins] = inside[begins]
        if not any(s.encode() in raw for s in self.specials):  # a special token may hold signs and letters
            letter, sign = _LETTER[data], _SIGN[data]
            first[1:] |= sign[:-1] & letter[1:]
            latin = np.flatnonzero(data[:-1] == 0xC3) + 1
            letter[latin] = (data[latin] != 0x97) & (data[latin] != 0xB7)
            first[1:] |= letter[:-1] & sign[1:]
        last = inside.copy()  # a chunk's last byte: white space, another chunk or the end of the text follows
        last[:-1] &= ~inside[1:] | first[1:]
        stops = at[at > 0] - 1
        last[stops] = inside[stops]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1 - starts

    def counted(self, texts: pa.Array) -> Iterator[tuple[list[str], np.ndarray]]:
        """Distinct chunks of groups of texts and how often they come."""
        for data, at in byte_groups(texts):
            raw = data.tobytes()
            starts, sizes = self.chunks(data, raw, at)
            short = sizes <= LONGEST
            starts, sizes = starts[short], sizes[short]
            if len(starts):
                place, n = distinct(raw, starts, sizes)
                yield [raw[a : a + s].decode() for a, s in zip(starts[place].tolist(), sizes[place].tolist(), strict=True)], np.bincount(n)

    def encode(self, texts: pa.Array, lexicon: Lexicon, kept: dict[bytes, list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For groups of neighbouring texts: the ids of all, and where each text's begin. kept: ids of chunks outside the lexicon."""
        for data, at in byte_groups(texts):
            raw = data.tobytes()
            starts, sizes = self.chunks(data, raw, at)
            place = lexicon.find(data, starts, sizes)
            new = np.flatnonzero(place < 0)
            pool, first = lexicon.pool, lexicon.first
            if len(new):
                heads, number = distinct(raw, starts[new], sizes[new])
                heads = new[heads]
                chunks = [raw[a : a + s] for a, s in zip(starts[heads].tolist(), sizes[heads].tolist(), strict=True)]
                if len(kept) + len(chunks) > KEPT:
                    kept.clear()
                unknown = [c for c in chunks if c not in kept]
                found = dict(zip(unknown, self.many_ids(unknown), strict=True))
                own = [found[c] if c in found else kept[c] for c in chunks]
                kept.update((c, ids) for c, ids in found.items() if len(c) <= LONGEST)
                place[new] = len(first) - 1 + number
                more = np.fromiter((i for ids in own for i in ids), np.int32)
                first = np.r_[first, first[-1] + np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))]
                pool = np.r_[pool, more]
            begin = first[place].astype(np.int64)
            n = first[place + 1] - begin
            ends = np.r_[0, np.cumsum(n)]
            yield pool[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])], ends[np.searchsorted(starts, at)]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder the library puts spaces between tokens."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


def distinct(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct chunk of bytes, and the number of each chunk among them."""
    raw += b"\0" * 16
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    a, b = words[starts] & _KEEP[np.minimum(sizes, 8)], words[starts + 8] & _KEEP[np.clip(sizes - 8, 0, 8)]
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(sizes > 16).tolist():
        a[i], b[i] = seen.setdefault(raw[starts[i] : starts[i] + sizes[i]], len(seen)), 0
    number = numbered(a, b, sizes.astype(_U))
    place = np.zeros(int(number.max()) + 1, np.int64)
    place[number] = np.arange(len(starts))
    return place, number


def codec(spec: str) -> WordCodec:
    """This worker's codec of a tokenizer; it outlives tasks."""
    name, kept = hashlib.sha256(spec.encode()).hexdigest(), worker_cache("words")
    if name not in kept:
        kept.clear()
        kept[name] = WordCodec(spec)
    return kept[name]


def frequent_words(documents: DataFrame, spec: str, most: int = WORDS) -> list[str]:
    """The chunks of all texts from some count on, the smallest for which they are `most` at most; most frequent first, then in order.

    The driver gets a histogram of counts, exact below EXACT and then by eighths of a power of two, and the chunks above the count.
    """
    shared = documents.sparkSession.sparkContext.broadcast(spec)  # a fixed file of a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            for words, counts in own.counted(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    mark = written()
    counts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("level", F.when(F.col("n") < EXACT, F.col("n")).otherwise(EXACT + F.floor(8 * F.log2(F.col("n") / EXACT))).cast("int")), "words")
    total, least = 0, None
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    rows = counts.filter(F.col("level") >= least).select("word", "n").toPandas() if least is not None else None
    drop_tables(documents.sparkSession, mark)
    return [] if rows is None else [w for _, w in sorted(zip((-rows["n"]).tolist(), rows["word"].tolist(), strict=True))]


#: Files that an application has, by their content's hash.
_SENT: set[tuple[str, str]] = set()


def shipped_lexicon(documents: DataFrame, spec: str, most: int = WORDS) -> str:
    """Compiles the lexicon of the corpus's frequent words and sends it to the executors; the file's name there."""
    own = WordCodec(spec)
    words = sorted({w.encode() for w in frequent_words(documents, spec, most)})
    data = compile_lexicon(words, own.many_ids(words))
    name, application = f"lexicon-{hashlib.sha256(data).hexdigest()[:32]}.bin", documents.sparkSession.sparkContext.applicationId
    if (application, name) in _SENT:
        return name
    folder = tempfile.mkdtemp(prefix="paratope-lexicon-")  # of the driver, which serves it to the executors
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    documents.sparkSession.sparkContext.addFile(path)
    _SENT.add((application, name))
    return name


OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_documents(documents: DataFrame, tokenizer_path: str, keys: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), most: int = WORDS) -> DataFrame:
    """The key columns and the wanted OUTPUTS of each row's text. The tokenizer is read here and sent to the executors once."""
    spark = documents.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    name = shipped_lexicon(documents, spec, most)
    shared = spark.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        lexicon = Lexicon(SparkFiles.get(name))
        cache = worker_cache("words").setdefault(name, {})
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            done = 0
            for ids, at in own.encode(batch.column(len(keys)), lexicon, cache):
                n = len(at) - 1
                lists = [ids[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                made = {
                    "n_tokens": lambda at=at: pa.array(np.diff(at).astype(np.int64)),
                    "ids": lambda lists=lists: pa.array(lists, pa.list_(pa.int32())),
                    "ids_sha256": lambda lists=lists: pa.array([sha(" ".join([own.decimals[i] for i in row])) for row in lists], pa.string()),
                    "decoded": lambda lists=lists: pa.array([own.decode(row) for row in lists], pa.string()),
                    "decoded_sha256": lambda lists=lists: pa.array([sha(own.decode(row)) for row in lists], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(done, n) for i in range(len(keys))), *(made[o]() for o in outputs)], names=[*keys, *outputs])
                done += n

    chosen = documents.select(*keys, F.col("text").cast("string").alias("text"))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]] + [f"{o} {OUTPUTS[o]}" for o in outputs])
    return chosen.mapInArrow(run, fields)
