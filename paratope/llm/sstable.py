"""Token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by identifier; each partition writes one shard to the shared
folder, under a name of the attempt until it is whole. A shard holds prefix-compressed entries in
compressed, checksummed blocks, then a sparse index with each block's last key, a Bloom filter of the
identifiers and a footer of fixed size. The driver keeps one row a shard (first key, ids), from which
each shard's start follows. A shard can be streamed, or searched by identifier: filter, binary search in
the index, one block.

    shard  = block* index bloom footer
    block  = u32 crc32(body), u32 length(body), body = u32 length(entries), zstd(entries)
    entry  = varint shared, varint rest, varint len(value), key[shared:], value
    key    = 1 byte (0: null id), 8 bytes big-endian id with its sign flipped, 8 bytes hash of the text, 4 bytes count
    value  = ids as little-endian unsigned 16-bit integers, or 32-bit where the shard's vocabulary needs them
    index  = zlib of (u32 length, last key, u64 offset)*
    bloom  = u32 hashes, bits
    footer = u64 at of index, u64 at of bloom, u64 documents, u64 ids, u32 bytes an id, u32 version, 8 bytes magic

Cases: null and empty texts hold the end id only; rows that repeat a doc_id are kept each, ordered by
their text's hash, and rows equal in both stand in one shard, whose task streams them; a null doc_id comes first; an empty table writes no shard and gives an empty result;
extra columns are ignored; texts are whole, of any length.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paratope.llm.chunks import ChunkCodes, byte_level_cuts
from paratope.llm.common import shared_dir, ship, worker_cache

END_ID = 2
BLOCK_BYTES = 1 << 16
BITS_PER_KEY, HASHES = 10, 7
MAGIC, VERSION = b"PSSTABLE", 2
_FOOTER = struct.Struct("<QQQQII8s")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def id_key(doc_id: int | None) -> bytes:
    return b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def _id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _bloom_bits(key: bytes, n_bits: int) -> list[int]:
    h = hashlib.blake2b(key, digest_size=16).digest()
    a, b = struct.unpack("<QQ", h)
    return [(a + i * (b | 1)) % n_bits for i in range(HASHES)]


class ShardWriter:
    """Writes entries in ascending key order to an open file."""

    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes = out, id_bytes
        self.at, self.n_docs, self.n_ids = 0, 0, 0
        self.body, self.last, self.index, self.ids = bytearray(), b"", [], []

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.body:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype("<u2" if self.id_bytes == 2 else "<u4").tobytes()
        self.body += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.ids or self.ids[-1] != key[:9]:
            self.ids.append(key[:9])
        self.last = key
        self.n_docs += 1
        self.n_ids += len(ids)
        if len(self.body) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.body:
            body = struct.pack("<I", len(self.body)) + pa.compress(bytes(self.body), codec="zstd", asbytes=True)
            self.index.append((self.last, self.at))
            self._put(struct.pack("<II", zlib.crc32(body), len(body)) + body)
            self.body = bytearray()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._put(zlib.compress(b"".join(struct.pack("<I", len(k)) + k + struct.pack("<Q", at) for k, at in self.index)))
        bloom_at, n_bits = self.at, max(64, BITS_PER_KEY * len(self.ids))
        bits = np.zeros(-(-n_bits // 8) * 8, np.uint8)
        for k in self.ids:
            bits[_bloom_bits(k, len(bits))] = 1
        self._put(struct.pack("<I", HASHES) + np.packbits(bits, bitorder="little").tobytes())
        self._put(_FOOTER.pack(index_at, bloom_at, self.n_docs, self.n_ids, self.id_bytes, VERSION, MAGIC))


class ShardReader:
    """Reads a shard from a seekable file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        self.index_at, self.bloom_at, self.n_docs, self.n_ids, self.id_bytes, version, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this version")
        raw, at, self.keys, self.offsets = zlib.decompress(self._read(self.index_at, self.bloom_at - self.index_at)), 0, [], []
        while at < len(raw):
            n = struct.unpack_from("<I", raw, at)[0]
            self.keys.append(raw[at + 4 : at + 4 + n])
            self.offsets.append(struct.unpack_from("<Q", raw, at + 4 + n)[0])
            at += 12 + n
        self.bloom = np.unpackbits(np.frombuffer(self._read(self.bloom_at + 4, size - _FOOTER.size - self.bloom_at - 4), np.uint8), bitorder="little")

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        crc, n = struct.unpack("<II", self._read(self.offsets[i], 8))
        packed = self._read(self.offsets[i] + 8, n)
        if zlib.crc32(packed) != crc:
            raise ValueError(f"block {i} is damaged")
        body, at, key = pa.decompress(packed[4:], struct.unpack_from("<I", packed)[0], codec="zstd", asbytes=True), 0, b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, np.frombuffer(body, "<u2" if self.id_bytes == 2 else "<u4", size // self.id_bytes, at)
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.offsets)):
            for key, ids in self._block(i):
                yield _id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row of doc_id, by filter, binary search and the blocks from there."""
        wanted, found = id_key(doc_id), []
        if not all(self.bloom[_bloom_bits(wanted, len(self.bloom))]):
            return found
        for i in range(bisect.bisect_left(self.keys, wanted), len(self.offsets)):
            for key, ids in self._block(i):
                if key[:9] == wanted:
                    found.append(ids)
                elif key[:9] > wanted:
                    return found
        return found


#: A chunk that the usual byte-level pattern leaves whole, so that it can go straight to the library's model.
_ONE_TOKEN = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n")


def byte_letters() -> dict[int, str]:
    """By code point, as Latin-1 has them, the letters in which byte-level vocabularies write bytes: visible ones as they are, the others in order from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _ByteEncoder:
    """The library's ids, each distinct chunk of text encoded once."""

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model.decode())
        self.id_bytes = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        added = self.library.get_added_tokens_decoder().values()
        spec = json.loads(model)
        pattern = spec["pre_tokenizer"] or {}
        plain = pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern["add_prefix_space"] and not spec["normalizer"]
        self.own = plain and spec["model"]["type"] == "BPE" and not spec["truncation"] and not any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.added = [t.content.encode() for t in added]
        self.letters = byte_letters()
        self.cache = ChunkCodes(self._cuts if self.own else lambda data, last: np.zeros(len(data), bool), self._codes)

    def _cuts(self, data: np.ndarray, last: np.ndarray) -> np.ndarray:
        cuts, raw = byte_level_cuts(data, last), data.tobytes()
        for token in self.added:  # the library takes them out of a text first
            at = raw.find(token)
            while at >= 0:
                cuts[at + 1 : at + len(token)] = False
                at = raw.find(token, at + 1)
        return cuts

    def _codes(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list = [None] * len(chunks)
        if self.own:
            whole, tokenize, letters = _ONE_TOKEN.fullmatch, self.library.model.tokenize, self.letters
            for i, c in enumerate(chunks):
                if whole(c):
                    ids[i] = [t.id for t in tokenize((c if c.isascii() else c.encode().decode("latin-1")).translate(letters))]
        rest = [i for i, v in enumerate(ids) if v is None]
        for i, e in zip(rest, self.library.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for ids, at in self.cache.encoded(texts):
            yield from np.split(ids, at[1:-1])


def _encoder(model: bytes) -> _ByteEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    name, kept = hashlib.sha256(model).hexdigest(), worker_cache("bytes")
    if name not in kept:
        kept.clear()
        kept[name] = _ByteEncoder(model)
    return kept[name]


def _drop_attempts(spark, folder: str) -> None:
    """Deletes what attempts that died have left."""
    left = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_attempt-*")
    store = left.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.globStatus(left) or []:
        store.delete(status.getPath(), False)


def write_shards(documents: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> list[tuple[str, int, int]]:
    """Writes all documents' ids in ascending doc_id order; returns (file, start, ids) of each shard in order, a row a partition."""
    spark = documents.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # a fixed file of under a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, part = f"{base}/shard-{task.partitionId():06d}.sst", f"{base}/_attempt-{task.taskAttemptId()}"
        encoder, writer, first, last, count = _encoder(model.value), None, None, None, 0
        end = np.asarray([end_id], "<u4")
        with store.open_output_stream(part) as out:
            for batch in batches:
                ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                writer = writer or ShardWriter(out, encoder.id_bytes)
                for doc_id, th, tokens in zip(ids, hashes, encoder.encode(batch.column(2)), strict=True):
                    key = id_key(doc_id) + struct.pack(">Q", th + (1 << 63))
                    count = count + 1 if key == last else 0
                    last = key
                    first = first or key
                    writer.add(key + struct.pack(">I", count), np.concatenate([tokens, end]))
            if writer:
                writer.close()
        if writer is None:
            store.delete_file(part)
            return
        store.move(part, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.binary()), pa.array([writer.n_ids])], names=["file", "first", "n_ids"])

    keyed = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    ranged = keyed.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th")
    shards = sorted(ranged.mapInArrow(run, "file string, first binary, n_ids long").collect(), key=lambda r: bytes(r["first"]))
    _drop_attempts(spark, folder)
    starts = np.cumsum([0, *(r["n_ids"] for r in shards)]).tolist()
    return [(r["file"], starts[i], r["n_ids"]) for i, r in enumerate(shards)]


def read_shards(spark, folder: str, shards: list[tuple[str, int, int]], with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the shards; a task a shard."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)

        def batch(rows):
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=False)]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(file) as source:
                    rows, held = [], 0
                    for doc_id, ids in ShardReader(source):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.tolist()] if with_ids else [])))
                        start += len(ids)
                        held += len(ids) if with_ids else 1
                        if held >= 1 << 16 or len(rows) >= 4096:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    listed = spark.createDataFrame([(f, s) for f, s, _ in shards], "file string, start long")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return listed.repartition(max(1, len(shards)), "file").mapInArrow(run, schema)


def new_folder(spark) -> str:
    base = shared_dir(spark)
    base = base if "://" in base else "file://" + base
    return f"{base}/sstable-{uuid.uuid4().hex}"
