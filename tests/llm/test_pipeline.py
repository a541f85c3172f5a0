"""The whole pipeline against plain versions of its stages, and its cases."""

import hashlib
import re

import duckdb
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from paratope.llm import common, langid, mixing
from tests.llm.conftest import documents
from tests.llm.test_langid import plainly_identified
from tests.llm.test_near_dedup import kept_by_brute_force


def fixture(docs):
    """Short texts of the test table, with copies, near copies, shared lines, nulls, empty texts and repeated ids."""
    short = [tuple(r) for r in docs.filter("length(text) BETWEEN 200 AND 900").orderBy("doc_id").select("doc_id", "text", "lang", "source").limit(90).collect()]
    rows = list(short)
    for i, (d, t, lang, source) in enumerate(short[:30]):
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        rows.append((10_000 + d, " ".join(words) if i % 2 else t, lang, source))
    shared = "This line of more than twenty characters stands in many documents."
    rows += [(20_000 + d, f"{shared}\n{t}\n  {shared.upper()} ", lang, None) for d, t, lang, source in short[30:40]]
    return [*rows, (30_000, None, "en", "web"), (30_001, "", "en", "web"), (30_002, "12 34 !?", None, "web"), rows[3], (rows[5][0], "Other words under a number that is taken already, and enough of them to be told.", "en", rows[5][3]), (rows[6][0], "The same number again with words of its own, kept by another source of texts than the first.", "en", "elsewhere")]


def lines_dropped(rows):
    holders, largest = {}, {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(d)
                largest[key(line)] = max(largest.get(key(line), d), d)
    gone = lambda d, line: len(holders.get(key(line), ())) >= 3 and largest[key(line)] != d
    return [(d, "\n".join(line for line in (t or "").split("\n") if not gone(d, line)), *rest) for d, t, *rest in rows]


WORDS = re.compile(r"[^\x20\x09-\x0D]")


def copies(spark, rows):
    """By row: equal rows share the copies of all of them; rows are told apart by id, text and source."""
    con = duckdb.connect()
    con.register("documents", documents(spark, rows).withColumn("n", F.monotonically_increasing_id()).toPandas())
    statement = mixing.ORACLE.replace("SELECT doc_id, source, CAST(coalesce(len(", "SELECT n, doc_id, source, CAST(coalesce(len(", 1).replace("SELECT d.doc_id, d.source,", "SELECT d.n, d.doc_id, d.source,", 1)
    head, tail = statement[: statement.rindex("SELECT doc_id, size")], statement[statement.rindex("FROM met") :]
    taken = dict(con.sql(f"{head} SELECT n, CAST(take // z + (size > 0 AND 2 * off + size < 2 * rest)::INTEGER AS BIGINT) {tail}").fetchall())
    order = [n for (n,) in con.sql("SELECT n FROM documents ORDER BY n").fetchall()]
    equal = {}
    for n, row in zip(order, rows, strict=True):
        equal.setdefault(tuple(row), []).append(taken[n])
    out = []
    for row, marks in equal.items():
        out += [row] * (sum(marks) if WORDS.search(row[1] or "") else 0)
    return out


def test_run_equals_plain_stages(spark, docs, tmp_path):
    rows = fixture(docs)
    documents(spark, rows, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    before = common.written()
    found = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert common.written() == before + 1  # what the last stage reads

    net = langid.fit(documents(spark, rows))
    left = [r for r in rows if plainly_identified(net, r[1])]
    assert {30_000, 30_001, 30_002}.isdisjoint(r[0] for r in left) and len(left) >= 70
    cut = lines_dropped(left)
    assert cut != left
    kept = set(kept_by_brute_force([(r[0], r[1]) for r in cut], 80))
    single = [r for r in cut if r[0] in kept]
    assert len(single) < len(cut) - 10
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = []
    for d, t, *_ in copies(spark, single):
        ids = library.encode(t)
        wanted.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert found == sorted(wanted)


def test_stages_return_the_columns_of_documents(spark, docs):
    given = docs.limit(40).withColumns({c: F.lit(None).cast("string") for c in ("_key", "_copy", "key", "row", "_th", "kept", "_text")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, "unused")
        assert out.columns == given.columns and out.count() > 0


def test_empty_table(spark, empty):
    out = empty
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "unused")
    assert out.collect() == []


def test_unlabelled_documents_stay(spark):
    rows = [(1, "Some text without a language.", None), (2, "12 !", None), (3, None, None)]
    kept = corpus_pipeline.identify_languages(spark, documents(spark, rows), "unused").collect()
    assert [r.doc_id for r in kept] == [1]


