"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder is our own: an agenda of adjacent symbol pairs, ordered by score and then from the left,
merges the best pair that is still current until none is left; symbols outside the vocabulary fall back
to bytes. Texts are cut first between characters that no piece holds side by side, and each distinct
chunk is encoded once a worker: short chunks many at a time, each with its own agenda as one row of a
table of pairs, long ones by a heap. Every chunk that is encoded is checked against the sentencepiece
library, and so is one whole text of each Arrow batch, whatever its length; a difference raises.
Decoding is the library's.

Cases: null and empty texts have no ids and decode to an empty text; repeated rows are encoded each; an
empty table gives an empty result; only `key` columns are carried; texts are whole, of any length. Models
with user-defined or unused pieces, another normaliser than identity or no byte fallback raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from paratope.llm.chunks import ChunkCodes, KeyTable, PairCuts
from paratope.llm.common import ship, worker_cache

SPACE = "▁"
#: Characters of the longest chunk whose agenda is a row of a table.
ROW = 24
NEVER = np.iinfo(np.int32).max
_U = np.uint64


class PieceCodec:
    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        types = {p.type for p in spec.pieces}
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or types - {1, 2, 3, 6}:
            raise ValueError("a merge-type model with byte fallback and plain pieces is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("a model with the identity normaliser and a dummy prefix is needed")
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.cost = {p.piece: -p.score for p in spec.pieces if p.type == 1}
        self.bytes = [0] * 256
        for i, p in enumerate(spec.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
        self._number_pairs()
        cuts = PairCuts([p.replace(SPACE, " ").encode() for p in self.ids])
        # with line feeds alone, chunks can be shown to the library behind one; else only whole texts can
        self.cache = ChunkCodes(cuts if cuts.apart(10) else lambda data, last: np.zeros(len(data), bool), self._checked)
        self.decimals = np.zeros((len(spec.pieces), len(str(len(spec.pieces))) + 1), np.uint8)
        for i, row in enumerate(self.decimals):
            text = f"{i},".encode()
            row[: len(text)] = np.frombuffer(text, np.uint8)

    def _number_pairs(self) -> None:
        """Numbers of symbols (pieces by id, then the characters in pieces that are none; other characters follow by code point), and for each pair that makes a piece its place in the order of scores."""
        n = 1 + max(self.ids.values(), default=0)
        loose = sorted({c for p in self.ids for c in p} - self.ids.keys())
        self.loose = {n + i: c for i, c in enumerate(loose)}
        number = self.ids | {c: i for i, c in self.loose.items()}
        self.strange = n + len(loose)
        self.symbol = self.strange + np.arange(0x110000, dtype=np.int64)
        for c, i in number.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        pairs = [(number[p[:k]], number[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        left, right, self.made = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = KeyTable(max(4, len(pairs).bit_length() + 1))
        self.pairs.insert(left.astype(_U) + _U(1), right.astype(_U), np.arange(len(pairs), dtype=np.int32))
        self.made = np.r_[self.made, 0]
        piece = {i: p for p, i in self.ids.items()}
        costs = np.array([self.cost[piece[i]] for i in self.made[:-1].tolist()])
        self.place = np.r_[np.unique(costs, return_inverse=True)[1].astype(np.int32), NEVER]

    def _pairs_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The numbers of pairs of symbols; -1, which is also the last place, where they make no piece."""
        return self.pairs.find(left.astype(_U).ravel() + _U(1), right.astype(_U).ravel()).reshape(left.shape)

    def merge_rows(self, symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merges the rows of a table of symbols, one pair of each row at a time: (rows, what is left of them), by the number of symbols left."""
        rows, done = np.arange(len(symbols)), []
        pair = self._pairs_of(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            if not pair.shape[1]:
                done.append((rows, symbols))
                break
            place = self.place[pair]
            best = place.argmin(1)  # the leftmost of equals
            at = np.arange(len(rows))
            open_ = place[at, best] != NEVER
            if not open_.all():
                done.append((rows[~open_], symbols[~open_]))
                rows, symbols, pair, best = rows[open_], symbols[open_], pair[open_], best[open_]
                at = at[: len(rows)]
                if not len(rows):
                    break
            symbols[at, best] = self.made[pair[at, best]]
            stays = np.ones(symbols.shape, bool)
            stays[at, best + 1] = False
            symbols = symbols[stays].reshape(len(rows), -1)
            pair = pair[stays[:, 1:]].reshape(len(rows), -1)
            for side in (best - 1, best):
                near = np.flatnonzero((side >= 0) & (side < pair.shape[1]))
                k = side[near]
                pair[near, k] = self._pairs_of(symbols[near, k], symbols[near, k + 1])
        return done

    def merge(self, text: str) -> list[str]:
        """The pieces of a normalised text."""
        symbols, cost = list(text), self.cost
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            c = cost.get(symbols[i] + symbols[i + 1])
            if c is not None:
                agenda.append((c, i, 2))
        heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            left = symbols[i]
            j = after[i]
            if not left or j >= n or len(left) + len(symbols[j]) != size:
                continue
            symbols[i] = both = left + symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                c = cost.get(both + symbols[k])
                if c is not None:
                    heappush(agenda, (c, i, size + len(symbols[k])))
            h = before[i]
            if h >= 0:
                c = cost.get(symbols[h] + both)
                if c is not None:
                    heappush(agenda, (c, h, size + len(symbols[h])))
        return [s for s in symbols if s]

    def chunk_ids(self, chunk: str) -> list[int]:
        """By the heap."""
        out: list[int] = []
        for piece in self.merge(chunk):
            i = self.ids.get(piece)
            if i is None:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(i)
        return out

    def agendas(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of normalised chunks that aren't empty, and how many each has."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        counts = np.zeros(len(chunks), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # chunks, and a table of their ids
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            if size > ROW:
                parts += [(own[i : i + 1], np.array([self.chunk_ids(chunks[at])])) for i, at in enumerate(own.tolist())]
                continue
            points = np.frombuffer("".join([chunks[i] for i in own.tolist()]).encode("utf-32-le"), "<u4").reshape(len(own), size)
            for rows, left in self.merge_rows(self.symbol[points]):
                odd = (left >= self.strange).any(1) | np.isin(left, list(self.loose)).any(1) if self.loose else (left >= self.strange).any(1)
                parts.append((own[rows[~odd]], left[~odd]))
                for i, symbols in zip(own[rows[odd]], left[odd].tolist(), strict=True):
                    parts.append((np.array([i]), np.array([[b for s in symbols for b in self._fallback(s)]])))
        for at, table in parts:
            counts[at] = table.shape[1]
        begins = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.uint32)
        for at, table in parts:
            ids[begins[at][:, None] + np.arange(table.shape[1])] = table
        return ids, counts

    def _fallback(self, symbol: int) -> list[int]:
        if symbol >= self.strange:
            return [self.bytes[b] for b in chr(symbol - self.strange).encode()]
        return [self.bytes[b] for b in self.loose[symbol].encode()] if symbol in self.loose else [symbol]

    def _checked(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.agendas([c.replace(" ", SPACE) for c in chunks])
        # the library puts a space before each text: it stands for a chunk's own, or a line feed keeps it apart
        theirs = self.library.encode([c[1:] if c[0] == " " else "\n" + c for c in chunks], num_threads=1)
        theirs = [t if c[0] == " " and c != " " else t[2:] if c != " " else [self.ids[SPACE]] for c, t in zip(chunks, theirs, strict=True)]
        flat = np.fromiter((i for t in theirs for i in t), np.uint32)
        if not np.array_equal(flat, ids) or not np.array_equal(counts, np.fromiter(map(len, theirs), np.int64, len(theirs))):
            ours = np.split(ids, np.cumsum(counts)[:-1])
            c, a, b = next((c, a.tolist(), b) for c, a, b in zip(chunks, ours, theirs, strict=True) if a.tolist() != b)
            raise RuntimeError(f"the agenda's ids differ from the library's for {c[:80]!r}: {a[:20]} and {b[:20]}")
        return ids, counts

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For groups of neighbouring texts: the ids of all, and where each text's begin."""
        texts = pc.replace_substring(texts, SPACE, " ") if pc.any(pc.match_substring(texts, SPACE)).as_py() else texts
        return self.cache.encoded(pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", texts.type), texts, " ")))

    def joined(self, ids: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
        """For each text its ids in decimal, joined by commas."""
        table = self.decimals[ids]
        sizes = np.r_[0, np.cumsum((table != 0).sum(1))]
        text = table.ravel()
        text = text[text != 0].tobytes()
        for a, b in zip(sizes[at[:-1]].tolist(), sizes[at[1:]].tolist(), strict=True):
            yield text[a : b - 1] if b > a else b""

    def check_whole(self, text: str, ids: list[int]) -> None:
        if ids != self.library.encode(text):
            raise RuntimeError(f"the agenda's ids differ from the library's for a text that begins {text[:80]!r}")


def codec(model: bytes) -> PieceCodec:
    """This worker's codec of a model; it and its cache outlive tasks."""
    name, kept = hashlib.sha256(model).hexdigest(), worker_cache("pieces")
    if name not in kept:
        kept.clear()
        kept[name] = PieceCodec(model)
    return kept[name]


OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_documents(documents: DataFrame, model_path: str, keys: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """The key columns and the wanted OUTPUTS of each row's text. The model is read here and sent to the executors once."""
    spark = documents.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # a fixed file of under a few MB

    decodes = {"decoded", "decoded_sha256"} & set(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            column, done, checked = batch.column(len(keys)).fill_null(""), 0, False
            for ids, at in own.encode(column):
                n = len(at) - 1
                lists = [ids[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] if decodes or not checked else []
                if not checked and len(ids):
                    first = int(np.flatnonzero(np.diff(at))[0])
                    own.check_whole(column[done + first].as_py(), lists[first])
                    checked = True
                decoded = [own.library.decode(i) if i else "" for i in lists] if decodes else []
                made = {
                    "n_tokens": lambda at=at: pa.array(np.diff(at)),
                    "ids": lambda at=at, ids=ids: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))),
                    "ids_sha256": lambda at=at, ids=ids: pa.array([sha(t) for t in own.joined(ids, at)], pa.string()),
                    "decoded": lambda decoded=decoded: pa.array(decoded, pa.string()),
                    "decoded_sha256": lambda decoded=decoded: pa.array([sha(t.encode()) for t in decoded], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(done, n) for i in range(len(keys))), *(made[o]() for o in outputs)], names=[*keys, *outputs])
                done += n

    chosen = documents.select(*keys, "text")
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]] + [f"{o} {OUTPUTS[o]}" for o in outputs])
    return chosen.mapInArrow(run, fields)
