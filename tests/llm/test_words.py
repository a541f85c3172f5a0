import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from paratope.llm import lexicon, queries, word_codec
from tests.conftest import SF
from tests.llm.conftest import documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(spec):
    return Tokenizer.from_str(spec)


@pytest.fixture(scope="module")
def codec(spec):
    return word_codec.WordCodec(spec)


def written_lexicon(tmp_path, words, ids):
    path = tmp_path / "words.bin"
    path.write_bytes(lexicon.compile_lexicon(words, ids))
    return lexicon.Lexicon(str(path))


def places(lex, words):
    data = np.frombuffer(b"".join(words) or b"\0", np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    return lex.find(data, np.cumsum(sizes) - sizes, sizes).tolist()


@pytest.mark.parametrize("seed", range(3))
def test_lexicon_finds_its_words_and_no_others(tmp_path, seed):
    rng = random.Random(seed)
    letters = [b"a", b"b", b"\0", b"\xff", "é".encode(), b"z"][: 2 + 2 * seed]
    drawn = {b"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(600)}
    words = sorted(rng.sample(sorted(drawn), len(drawn) // 2))
    lex = written_lexicon(tmp_path, words, [[i, 7] for i in range(len(words))])
    known = {w: i for i, w in enumerate(words)}
    asked = sorted(drawn) + [w + b"a" for w in words] + [w[:-1] for w in words if len(w) > 1]
    assert places(lex, asked) == [known.get(w, -1) for w in asked]
    assert lex.pool[lex.first[3] : lex.first[4]].tolist() == [3, 7]


def test_lexicon_shares_suffixes(tmp_path):
    stems, ends = [b"walk", b"talk", b"stalk"], [b"", b"ed", b"er", b"ing", b"s"]
    words = sorted(s + e for s in stems for e in ends)
    states = lexicon.minimal_states(words)
    # the start, one after s, then a, l, k and the endings, which all share, with n, g, e|i|s and the end
    assert len(states) == 10
    assert places(written_lexicon(tmp_path, words, [[]] * len(words)), words) == list(range(len(words)))
    assert places(written_lexicon(tmp_path, [], []), [b"a"]) == [-1]
    with pytest.raises(ValueError, match="sorted"):
        lexicon.minimal_states([b"b", b"a"])


def test_fuzzed_texts_equal_the_library(codec, library, tmp_path):
    rng = random.Random(5)
    pieces = [*"abcdeEZ ,.'<|>09sStT \t\n\x0b\x0c\r\x1c\x85 éÉß×÷µªº̸́ŉİıΣσς日本٣½²​😀\0", "<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "the ", "̈́", "ﬁ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    texts += ["a" * 5000, "'" * 300, "ab" * 400 + ",", "it',s ,'s", "≮ a", "Σας ΑΣ", "é,é ×a ÷,a÷ Ã×,", "<|startoftext|", "a,́b"]
    words = sorted({w.encode() for w in ["the", "a", ",", "It's", "éé", "a<|endoftext|>"]})
    lex = written_lexicon(tmp_path, words, codec.many_ids(words))
    kept = {}
    together = [ids[a:b].tolist() for ids, at in codec.encode(pa.array(texts), lex, kept) for a, b in zip(at[:-1], at[1:], strict=True)]
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for text, ours, theirs in zip(texts, together, wanted, strict=True):
        assert ours == theirs, text
        assert codec.decode(ours) == library.decode(theirs, skip_special_tokens=False)
    for text, theirs in list(zip(texts, wanted, strict=True))[::7]:
        alone = [i for ids, _ in codec.encode(pa.array([text]), lex, {}) for i in ids.tolist()]
        assert alone == theirs, text


def test_many_equals_one(codec):
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinéèü") for _ in range(rng.randint(1, 20))).encode() for _ in range(2000)]
    assert codec.many_ids(words) == [codec.merge(w.decode().encode()) for w in words]
    long = ("tion" * 40).encode()
    scanned = [codec.inner[b] for b in long[:-1]] + [codec.ends[long[-1]]]
    assert codec.merge(long) == codec._merge_long(scanned)


def test_cases(spark, library):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "The the THE the, the."), (4, "The the THE the, the."), (5, "<|endoftext|> x<|startoftext|>y"), (6, "wörter " * 20000), (None, "no id"), (7, "x" * 200000), (8, "日本 ΣΑΣ İ")]
    df = documents(spark, rows, extra=True).selectExpr("*", "1 AS n_tokens", "'x' AS ids", "2 AS decoded")
    for most in (2, word_codec.WORDS, 2):  # an application gets the same file once
        got = sorted(map(tuple, word_codec.encode_documents(df, PATH, most=most).collect()), key=str)
        ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
        want = [(k, len(i), i, library.decode(i, skip_special_tokens=False)) for (k, _), i in zip(rows, ids, strict=True)]
        assert got == sorted(want, key=str)
    assert word_codec.encode_documents(documents(spark, []), PATH).count() == 0


def test_frequent_words_count_all_texts(spark, spec):
    df = documents(spark, [(i, "b a, a\na") for i in range(50)] + [(99, "c " * 60), (100, "x" * 65 + " é, it's")])
    assert word_codec.frequent_words(df, spec, 5) == word_codec.frequent_words(df, spec, 4) == ["a", "c", ",", "b"]  # both words of the next count are too many
    assert word_codec.frequent_words(df.limit(0), spec, 4) == word_codec.frequent_words(df.filter("doc_id = 100"), spec, 1) == []
    assert word_codec.frequent_words(df, spec) == ["a", "c", ",", "b", "it's", "é"]


def test_other_tokenizers_raise():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises((ValueError, KeyError, TypeError)):
        word_codec.WordCodec(f.read())


def test_query_equals_the_library(spark, docs, library):
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_word_codec"](spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        assert tuple(got[r["doc_id"]])[1:] == want
