"""Licences, URLs, mixing and quality rules: cases beside the SQL comparison."""

import random

import pytest
from pyspark.sql import functions as F

from paratope.llm import license_scan, mixing, quality, url_filter
from tests.llm.conftest import documents

NATIVE = [
    lambda d: mixing.mix_sources(d),
    lambda d: quality.apply_policy(quality.ledger(d)),
    lambda d: license_scan.scan_licenses(d.selectExpr("doc_id AS id", "source AS path", "text")),
    lambda d: url_filter.judge_urls(d.selectExpr("doc_id AS page_id", "text AS url")),
]


@pytest.mark.parametrize("run", NATIVE)
def test_plans_hold_no_python(spark, docs, run):
    plan = run(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("run", NATIVE)
def test_empty_tables(spark, empty, run):
    assert run(empty).collect() == []


def mix(spark, rows, **options):
    return {(r.doc_id, r.size): r for r in mixing.mix_sources(documents(spark, rows, extra=True), **options).collect()}


def test_mix_reaches_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(0, 400), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    found = mix(spark, rows, shard_docs=50)
    by_source = {}
    source = {r[0]: r[3] for r in rows}
    for r in found.values():
        t = by_source.setdefault(source[r.doc_id], [0, r.target, r.source_size])
        t[0] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for taken, target, size in by_source.values():
        assert abs(taken - target) <= mixing.BLOCK_WORDS and target <= 3 * size
    assert sum(t[0] for t in by_source.values()) == pytest.approx(sum(r.size for r in found.values()), abs=2 * mixing.BLOCK_WORDS)
    assert {k: r.taken for k, r in found.items()} == {k: r.taken for k, r in mix(spark, rows, shard_docs=50).items()}


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(1)
    votes = [rng.randrange(0, 10_000) for _ in range(60)]
    most = [rng.choice([v // 40, v // 90, 10**6]) for v in votes]
    seats = 137
    df = spark.createDataFrame([(0, i, float(v), seats, m, len(votes)) for i, (v, m) in enumerate(zip(votes, most, strict=True))], "g int, o int, votes double, seats long, most long, n int")
    found = {r.o: r.quota for r in mixing.apportion(df, ["g"], "o", "votes", "seats", "most", mixing.F.col("n")).collect()}
    wanted = dict.fromkeys(range(60), 0)
    for _ in range(seats):
        open_ = [i for i in wanted if wanted[i] < most[i] and votes[i] > 0]
        wanted[min(open_, key=lambda i: (-votes[i] / (2 * wanted[i] + 1), i))] += 1
    assert found == wanted


def test_mix_cases(spark):
    found = mix(spark, [(1, None, "en", "a"), (2, "", "en", None), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (None, "x " * 300_000, "en", "b")])
    assert found[1, 0].taken == 0 and found[2, 0].target == 0.0 and found[None, 300_000].taken <= 900_000


def test_mixed_documents_repeat_whole_rows(spark):
    rows = [(i, "w " * 200, "en", "a" if i < 300 else "b") for i in range(330)]
    out = mixing.mixed_documents(documents(spark, rows, extra=True)).collect()
    counts = {}
    for r in out:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 3 and sum(counts.values()) == pytest.approx(330, rel=0.1)


def test_quality_measures(spark):
    rows = [(1, None), (2, ""), (3, "a b c d a b c x # $"), (4, "line one\n\nline one\n \nline one\nLINE ONE"), (5, "wörd " * 60_000), (6, "x")]
    found = {r.doc_id: r for r in quality.apply_policy(quality.ledger(documents(spark, rows, extra=True))).collect()}
    assert (found[1].n_words, found[1].base_failed, found[1].kept) == (0, True, False) and found[2].n_words == 0
    assert (found[3].n_words, found[3].n_repeat_words, found[3].n_symbols, found[3].word_chars) == (10, 6, 2, 10)
    assert (found[4].n_dup_lines, found[4].n_lines) == (2, 4)
    assert (found[5].n_words, found[5].n_repeat_words, found[5].word_chars) == (60_000, 60_000, 240_000)
    assert found[6].failures & 1 == 1


def test_overlapping_windows_count_each_word_once(spark):
    text = "a a a a a b c d e f b c d e z"
    (row,) = quality.ledger(documents(spark, [(1, text)])).collect()
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 3)}
    assert row.n_repeat_words == len(covered)


def test_ablations_add_up(spark, docs):
    entries = quality.ledger(docs)
    rows = {r.rule: r for r in quality.ablations(entries).collect()}
    masks = [r.failures for r in entries.collect()]
    for i, rule in enumerate(quality.RULES):
        assert rows[rule].n_failed == sum(m >> i & 1 for m in masks) and rows[rule].n_only == sum(m == 1 << i for m in masks)
        assert rows[rule].n_documents == len(masks)


URLS = [
    (1, "http://WWW.Example.com/en/a?x"), (2, "https://a.example.com/en/"), (3, "http://example.com/fr/"), (4, "ftp://x.net/es/1#f"), (5, "http://x.net/en/1"), (6, None), (7, "no scheme/com/"),
    (8, "http://notexample.com/en/"), (9, "http://com"), (10, "a://b://c.com/x"), (11, ""), (12, "http://x.org/" + "p" * 100_000), (5, "http://x.net/en/1"),
]


def test_url_rules(spark):
    rows = url_filter.judge_urls(spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "'h' AS host", "'n' AS norm", "1 AS bucket")).collect()
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(URLS)
    assert found[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert found[2][2:] == ("example.com/en/", "block") and found[3][2:] == ("com/", "allow") and found[4] == ("x.net", "/es/1", "net/es/", "block")
    assert found[5][2] is None and found[6][:3] == ("", "", None) and found[7][:3] == ("", "", None)
    assert found[8][2] == "com/" and found[9][:3] == ("com", "", None) and found[10][0] == "b:" and all(r.verdict in ("allow", "block") for r in rows)


def test_language_models_tell_kinds_of_urls_apart(spark):
    rng = random.Random(2)
    good = lambda: "".join(rng.choice(["news", "blog", "wiki"]) for _ in range(2))
    bad = lambda: "".join(rng.choice("xqzj0") for _ in range(8))
    rows = [(i, f"http://a.com/{good()}") for i in range(300)] + [(1000 + i, f"http://a.net/es/{bad()}") for i in range(300)]
    rows += [(2000 + i, f"http://a.org/{good()}") for i in range(50)] + [(3000 + i, f"http://a.org/{bad()}") for i in range(50)]
    found = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(found[2000 + i] == "allow" for i in range(50)) > 40 and sum(found[3000 + i] == "block" for i in range(50)) > 40


def test_licences_and_inheritance(spark):
    rows = [
        (1, "repo/LICENSE", "Released under the MIT License.\nrest"), (2, "repo/a/b/file", "nothing"), (3, "repo/a/COPYING", "\n  Licensed under CC BY-NC 4.0.\n"), (4, "repo/file", None),
        (5, "other/x", "text"), (6, None, "Released under the MIT License."), (7, "top", "x"), (8, "repo/c/f", "text of many words, a program that does this and that for those who want it\nLicensed under the Apache License, Version 2.0."), (9, "repo/c/g", "x"), (2, "repo/a/b/file", "nothing"),
        (10, "repo2/a", "My licence plate is blue and this sentence is about nothing else at all."), (11, "repo/a/long", "w " * 100_000),
    ]
    df = spark.createDataFrame(rows, "id long, path string, text string").selectExpr("*", "1 AS pos", "'t' AS token", "0 AS dir")
    found = {r.id: (r.license, r.origin, r.license_dir) for r in license_scan.scan_licenses(df).collect()}
    assert found[1] == ("MIT", "own", None) and found[2] == ("CC-BY-NC-4.0", "inherited", "repo/a") and found[4] == ("MIT", "inherited", "repo")
    assert found[5] == (None, "none", None) and found[6][:2] == ("MIT", "own") and found[7][1] == "none"
    assert found[8][:2] == ("Apache-2.0", "own") and found[9] == ("MIT", "inherited", "repo") and found[10][1] == "none" and found[11][0] == "CC-BY-NC-4.0"


MIT = """MIT License

Copyright (c) 2019 Somebody Else

""" + license_scan._MIT_GRANT + "\n\n" + license_scan._MIT_WARRANTY + "\n"


def wrapped(text, mark="", width=70):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line += " " + word
    return "\n".join(mark + line for line in [*lines, line])


def test_licence_files_headers_and_tags(spark):
    code = "\n\nimport os\n\ndef main(arguments):\n    return os.path.join(*arguments)\n" * 30
    texts = {
        "MIT": MIT, "MIT/1": MIT[: MIT.index("THE SOFTWARE IS PROVIDED")], "MIT/2": wrapped(MIT), "MIT/3": "// SPDX-License-Identifier: MIT" + code, "MIT/4": "/*\n" + wrapped(license_scan._MIT_GRANT, " * ") + "\n */" + code,
        "Apache-2.0": "#!/bin/sh\n# Copyright 2020 The Authors\n#\n" + wrapped(license_scan._APACHE_HEADER, "# ") + code, "Apache-2.0/1": "Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS",
        "GPL-3.0": "/* " + wrapped(license_scan._GPL_HEADER.format(v=3), " * ") + " */" + code, "GPL-3.0/1": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n\nPreamble",
        "GPL-2.0": wrapped(license_scan._GPL_HEADER.format(v=2), "; "), "BSD-3-Clause": "Copyright (c) 2001, X\nAll rights reserved.\n\n" + wrapped(" ".join([license_scan._BSD_GRANT, license_scan._BSD_THIRD, license_scan._BSD_WARRANTY])),
        "BSD-2-Clause": "BSD 2-Clause License\n\n" + wrapped("Copyright (c) 2001, X All rights reserved. " + license_scan._BSD_GRANT + " " + license_scan._BSD_WARRANTY), "MPL-2.0": "/* " + wrapped(license_scan._MPL_HEADER, " * ", 75) + " */" + code, "ISC": "ISC License\n\nCopyright (c) 2010 Y\n\n" + wrapped(license_scan._ISC),
        "Unlicense": wrapped(license_scan._UNLICENSE), "CC0-1.0": "SPDX-License-Identifier: CC0-1.0", "Foo-9.9": "SPDX-License-Identifier: Foo-9.9" + code, "None": "You need a license to drive; the copyright of this song is ours.\n\nNo permission is hereby granted." + code,
    }
    df = spark.createDataFrame([(n, f"f{i}", t) for i, (n, t) in enumerate(texts.items())], "id string, path string, text string")
    found = {r.id: r.own_license for r in license_scan.scan_licenses(df).collect()}
    assert {n: v for n, v in found.items() if str(v) != n.split("/")[0]} == {}


def test_small_sources_and_rows_without_an_id_are_mixed(spark):
    rows = [(None, f"text {i} of some words here", "en", "a") for i in range(3000)] + [(i, "w " * 20, "en", "b") for i in range(2)] + [(99, "only these twelve words stand in the whole of this small source", "en", "c")]
    found = mixing.mix_sources(documents(spark, rows, extra=True), shard_docs=100).collect()
    taken, target = {}, {}
    for r in found:
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
        assert r.taken <= 3 * r.size
    assert target["b"] == 120 and target["c"] == 36 and all(0 < abs(taken[s] - target[s]) + 1 <= mixing.BLOCK_WORDS for s in "bc")
    shards = {}
    for r in found:
        if r.doc_id is None:
            shards[r.shard] = shards.get(r.shard, 0) + 1
    assert len(shards) > 20 and max(shards.values()) < 300
    mixed = mixing.mixed_documents(documents(spark, rows, extra=True), shard_docs=100)
    words = {r.source: r.n for r in mixed.groupBy("source").agg({"text": "count"}).withColumnRenamed("count(text)", "n").collect()}
    assert words["b"] == 6 and words["c"] == 3 and words["a"] * 6 == pytest.approx(taken["a"], rel=0.02)


def test_long_and_repeated_urls(spark):
    rows = [(i, None) for i in range(2000)] + [(5000 + i, "http://a.net/es/" + "x" * 50_000) for i in range(3)] + [(6000 + i, "http://b.org/same") for i in range(2000)] + [(9000, "http://c.org/" + "ab/" * 30_000), (9001, ""), (9001, "://"), (None, "http://com/x")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS norm", "1 AS bucket")
    found = url_filter.judge_urls(df).collect()
    assert len(found) == len(rows) and {r.verdict for r in found} <= {"allow", "block"}
    by_id = {r.page_id: r for r in found}
    assert (by_id[5000].rule, by_id[5000].verdict) == ("net/es/", "block") and by_id[None].rule == "com/" and (by_id[0].host, by_id[0].path, by_id[0].rule) == ("", "", None)
    assert len({r.verdict for r in found if r.page_id and 6000 <= r.page_id < 8000}) == 1 and len(by_id[9000].path) == 90_001


def test_copies_follow_rows_where_an_id_comes_in_two_sources(spark):
    rows = [(i, f"{s} " + "word " * 19, "en", s) for i in range(500) for s in "ac"] + [(i, "b " * 20, "en", "b") for i in range(1000, 1500)]
    mixed = {r.source: (r.target, r.words) for r in mixing.mix_sources(documents(spark, rows)).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("words")).collect()}
    out = mixing.mixed_documents(documents(spark, rows, extra=True))
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    for source, (target, taken) in mixed.items():
        assert abs(taken - target) <= mixing.BLOCK_WORDS
        assert abs(words[source] - target) <= 20  # a document


def test_equal_rows_share_their_copies(spark):
    rows = [(7, "same text of five words", "en", "a")] * 40 + [(i, f"text {i} of five words", "en", s) for i in range(100, 160) for s in "ab"]
    copies = sum(r.copies for r in mixing.mix_sources(documents(spark, rows)).filter("doc_id = 7").collect())
    assert mixing.mixed_documents(documents(spark, rows)).filter("doc_id = 7").count() == copies > 0


def test_many_shards_in_groups_reach_the_targets(spark):
    rows = [(i, "w " * (i % 37), "en", "abc"[i % 7 % 3]) for i in range(3000)]
    found = mixing.mix_sources(documents(spark, rows), shard_docs=20, group_shards=8).collect()
    for source in "abc":
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= mixing.BLOCK_WORDS
        assert all(r.taken <= 3 * r.size for r in own) and len({r.shard for r in own}) > 16


def test_blocks_are_drawn_over_the_whole_shard(spark):
    rows = [(i, "w " * 64, "en", "a") for i in range(400)] + [(i, "w " * 64, "en", "b") for i in range(400, 800)]
    by_source = {}
    for r in mixing.mix_sources(documents(spark, rows)).collect():
        by_source.setdefault(r.source, []).append(r.taken)
    # 1.43 and 0.57 rounds: an arc of the shard would take all documents but its two ends whole or not at all
    assert sum(64 < t < 128 for t in by_source["a"]) > 100 and sum(0 < t < 64 for t in by_source["b"]) > 100
