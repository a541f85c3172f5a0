import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from paratope.llm import chunks, piece_codec, sstable
from tests.llm.conftest import documents

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["  a  b ", "", " ", "   ", "a\n\n b\n", "▁x ▁▁ y", "\n", "x\n", "日本 語é \t\n x", "<s> <0x0A> </s>", " \n a", "a" * 500, "é" * 40, "a　b\xa0c\x1cd \x85 e", "don't 's 'S I'll\n\t we\r\n x", "a!\x1c ! y", "x, y. z!! (a) ..b ,c #,", "<|endoftext|> a<|endoftext|>", "x!<|endoftext|>'s 1<|endof", "Привет, мир! ÷a×b œuvre", "“q” — don’t…", "\x00\x01"]


def fuzz(n, seed):
    rng = random.Random(seed)
    marks = list(" \n\t\r\xa0\x1c\x85　​ ab1!'sé日́.,;:|)#")
    return ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(own, texts):
    return [ids[a:b].tolist() for ids, at in own.encode(pa.array(texts, pa.string())) for a, b in zip(at[:-1], at[1:], strict=True)]


def test_agenda_equals_the_library():
    own = piece_codec.PieceCodec(open(PIECES, "rb").read())
    texts = ODD + fuzz(5000, 1)
    wanted = own.library.encode(texts, num_threads=1)
    assert encoded(own, texts) == wanted
    assert encoded(own, texts) == wanted  # from the cache
    uncut = piece_codec.PieceCodec(open(PIECES, "rb").read())
    uncut.cache.cuts = lambda data, last: np.zeros(len(data), bool)
    assert encoded(uncut, texts[:500]) == wanted[:500]
    for ids, at in own.encode(pa.array(texts)):
        assert [t.decode() for t in own.joined(ids, at)] == [",".join(map(str, w)) for w in wanted]


def test_rows_of_agendas_equal_the_heap():
    own = piece_codec.PieceCodec(open(PIECES, "rb").read())
    rng = random.Random(5)
    words = list(dict.fromkeys("".join(rng.choice("abcdeinorst▁é日́") for _ in range(rng.randrange(1, 30))) for _ in range(4000)))
    ids, counts = own.agendas(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [own.chunk_ids(w) for w in words]


def test_chunks_are_kept_within_bounds():
    calls = []

    def encode(words):
        calls.extend(words)
        return np.array([ord(c) for w in words for c in w], np.uint32), np.array([len(w) for w in words], np.int64)

    rng = random.Random(7)
    texts = [" ".join(rng.choice("abc") * rng.randrange(1, 40) + str(rng.randrange(50)) for _ in range(rng.randrange(30))) for _ in range(400)] + ["", "\0", "a\0", "a", "a\0\0b"]
    cache = chunks.ChunkCodes(chunks.byte_level_cuts, encode, bits=8)
    for _ in range(2):
        for t in (texts, texts[::-1]):
            got = [ids[a:b] for ids, at in cache.encoded(pa.array(t)) for a, b in zip(at[:-1], at[1:], strict=True)]
            assert ["".join(map(chr, g)) for g in got] == t
    roomy = chunks.ChunkCodes(chunks.byte_level_cuts, encode)
    calls.clear()
    list(roomy.encoded(pa.array(texts))), list(roomy.encoded(pa.array([None, *texts]).slice(1)))
    assert len(calls) == len(set(calls))


def test_key_table_finds_what_was_inserted():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 40, 5000).astype(np.uint64), rng.integers(0, 40, 5000).astype(np.uint64)
    pairs = np.unique(np.c_[a, b], axis=0)
    keys = chunks.KeyTable((2 * len(pairs)).bit_length() + 1)
    for part in np.array_split(np.arange(len(pairs), dtype=np.int32), 3):
        keys.insert(pairs[part, 0], pairs[part, 1], part)
    assert keys.find(pairs[:, 0], pairs[:, 1]).tolist() == list(range(len(pairs)))
    assert (keys.find(pairs[:, 0] + np.uint64(100), pairs[:, 1]) == -1).all()
    with pytest.raises(ValueError, match="full"):
        keys.insert(np.arange(1, keys.limit, dtype=np.uint64), np.full(keys.limit - 1, 99, np.uint64), np.arange(keys.limit - 1, dtype=np.int32))


def test_a_wrong_agenda_is_found():
    own = piece_codec.PieceCodec(open(PIECES, "rb").read())
    own.place[:-1] = own.place[:-1].max() - own.place[:-1]
    with pytest.raises(RuntimeError, match="differ"):
        encoded(own, ["unbelievable reconsideration of interdisciplinary information"])
    with pytest.raises(RuntimeError, match="differ"):
        own.check_whole("word " * 30_000, [1, 2])


def test_encoding_documents(spark, docs, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(i, t) for i, t in enumerate([None, *ODD])] + [(3, "again"), (None, "none"), (99, "long text " * 30_000)]
    df = documents(spark, rows, extra=True).unionByName(docs, allowMissingColumns=True)
    found = piece_codec.encode_documents(df, PIECES, outputs=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")).collect()
    wanted = [(r.doc_id, library.encode(r.text or "")) for r in df.collect()]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.ids) for r in found), key=key) == sorted(wanted, key=key)
    for r in found:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == sha(",".join(map(str, r.ids)))
        assert r.decoded == (library.decode(r.ids) if r.ids else "") and r.decoded_sha256 == sha(r.decoded)
    assert piece_codec.encode_documents(empty, PIECES).collect() == []


def test_byte_encoder_equals_the_library():
    own, library = sstable._ByteEncoder(open(BYTES, "rb").read()), Tokenizer.from_file(BYTES)
    texts = ODD + fuzz(5000, 2)
    assert [ids.tolist() for ids in own.encode(pa.array(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_shard_round_trip_and_lookup():
    rng = random.Random(3)
    ids = sorted(rng.sample(range(-(10**12), 10**12), 3000))
    values = {i: np.array([rng.randrange(50_000) for _ in range(rng.randrange(1, 200))], "<u4") for i in ids}
    out = io.BytesIO()
    writer = sstable.ShardWriter(out, 2)
    for i in ids:
        writer.add(sstable.id_key(i) + b"\0" * 12, values[i])
    writer.close()
    reader = sstable.ShardReader(io.BytesIO(out.getvalue()))
    assert [(i, v.tolist()) for i, v in reader] == [(i, values[i].tolist()) for i in ids]
    assert len(reader.keys) > 5 and reader.n_docs == 3000 and reader.n_ids == sum(map(len, values.values()))
    assert all(reader.get(i)[0].tolist() == values[i].tolist() for i in ids[::97])
    absent = [i for i in rng.sample(range(-(10**12), 10**12), 2000) if i not in values]
    assert all(reader.get(i) == [] for i in absent)
    passed = sum(bool(all(reader.bloom[sstable._bloom_bits(sstable.id_key(i), len(reader.bloom))])) for i in absent)
    assert passed < 0.05 * len(absent)


def test_damage_is_found():
    out = io.BytesIO()
    writer = sstable.ShardWriter(out, 2)
    writer.add(sstable.id_key(1) + b"\0" * 12, np.arange(100, dtype="<u4"))
    writer.close()
    data = bytearray(out.getvalue())
    data[20] ^= 255
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.ShardReader(io.BytesIO(bytes(data))))


def round_trip(spark, df, with_ids=False):
    folder = sstable.new_folder(spark)
    shards = sstable.write_shards(df, BYTES, folder)
    return sstable.read_shards(spark, folder, shards, with_ids).collect(), shards


def test_shards_hold_every_document_in_order(spark, docs, empty):
    library = Tokenizer.from_file(BYTES)
    df = docs.unionByName(documents(spark, [(10**6 + i, t) for i, t in enumerate([None, *ODD])] + [(-5, "x")], extra=True), allowMissingColumns=True)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found, shards = round_trip(spark, df, True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    start, got = 0, {r.doc_id: r for r in found}
    for r in sorted(df.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32, g.ids) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    assert len(shards) > 1
    with open(shards[0][0], "rb") as f:
        assert sstable.ShardReader(f).get(-5)[0].tolist() == [87, 2]
    assert round_trip(spark, empty)[0] == []


def test_repeated_and_missing_ids_are_kept(spark):
    found, _ = round_trip(spark, documents(spark, [(None, "a"), (1, "b"), (1, "b"), (1, "c d e"), (None, None)]))
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in found) == [(0, 1), (0, 2), (1, 2), (1, 2), (1, 4)]
    order = sorted(found, key=lambda r: r.start)
    assert order[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(order, order[1:], strict=False)) and order[0].doc_id is None


def test_many_equal_rows_are_streamed_into_one_shard(spark):
    found, shards = round_trip(spark, documents(spark, [(7, "the same words again")] * 3000 + [(i, "x") for i in range(5)]))
    same = sorted((r.start, r.n_tokens) for r in found if r.doc_id == 7)
    assert len(same) == 3000 and all(a + n == b for (a, n), (b, _) in zip(same, same[1:], strict=False)) and sum(s[2] for s in shards) == sum(r.n_tokens for r in found)
