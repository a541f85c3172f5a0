"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

Templates are one-line statements, titles, the headers that licences ask for, and whole short licence
texts, several a licence. Lines and paragraphs that name a licence (ANCHOR) are compared with them as
headers, and a file that has such a line also as a whole. Weights are (1 + ln tf) * idf, with document
frequencies of the templates' words counted over all files; other words weigh as words of no file.

The cosine tells whether a piece declares a licence of a family; which one, names and versions decide:

* a tag (SPDX-License-Identifier at the start of a line) counts as it is written, expressions and unknown names too;
* a piece that names a family with a version (CLAIM) declares that version, whichever the template has; a
  template of another family doesn't count, nor does one of a versioned family where no version is named;
* a title (a template that declares nothing) must match word by word; other templates need a declaring word
  (DECLARES) and the score `least`, or NEAR where the piece names that licence itself, and a short piece with a
  word of doubt (DOUBTS) declares nothing.

The best piece, of equal ones the first, gives the file's own licence. A file that matches as a whole, or by
its first line or paragraph, is its directory's licence file, with the licence found there; files without a
licence of their own take that of the nearest directory on their path that has one. Directories are joined by
equal paths, one row a distinct directory and level.

Cases: null text has no licence of its own; a null path has no directory; of several licence files in
a directory the smallest id counts (null last); equal scores at one place go to the first licence by name;
repeated rows each get a result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paratope.llm.common import SPACE, finished, lower_ascii, materialize, written

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this
program. If not, see <https://www.gnu.org/licenses/>."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Statements, titles, headers and texts by which licences are declared.
TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", _GPL_HEADER.replace("General", "Affero General").format(v=3)],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", _APACHE_HEADER],
    "BSD-2-Clause": ["BSD 2-Clause License", f"BSD 2-Clause License Copyright (c) All rights reserved. {_BSD_GRANT} {_BSD_WARRANTY}"],
    "BSD-3-Clause": [
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
        "Licensed under the BSD 3-Clause License.",
        f"BSD 3-Clause License Copyright (c) All rights reserved. {_BSD_GRANT} {_BSD_THIRD} {_BSD_WARRANTY}",
        f"{_BSD_GRANT} {_BSD_THIRD}",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright; released under the CC0 1.0 public domain dedication.", "CC0 1.0 Universal"],
    "EPL-2.0": ["This program is made available and licensed under the terms of the Eclipse Public License 2.0."],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2.", _GPL_HEADER.format(v=2)],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GPL_HEADER.format(v=3)],
    "ISC": ["ISC License", "The ISC License", "Licensed under the ISC License.", f"ISC License Copyright (c) {_ISC}"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", _GPL_HEADER.replace("General", "Lesser General").replace("program", "library").format(v=3)],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "MIT License", "The MIT License", "The MIT License (MIT)", f"MIT License Copyright (c) {_MIT_GRANT} {_MIT_WARRANTY}", f"MIT License Copyright (c) {_MIT_GRANT}", _MIT_GRANT],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License, version 2.0.", _MPL_HEADER],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", _UNLICENSE],
}
#: Names of licences in titles, their versions and the dates of these.
TITLES = {
    ("GPL", "GNU GENERAL PUBLIC LICENSE"): {"1": "February 1989", "2": "June 1991", "3": "29 June 2007"},
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE"): {"2.1": "February 1999", "3": "29 June 2007"},
    ("LGPL", "GNU LIBRARY GENERAL PUBLIC LICENSE"): {"2": "June 1991"},
    ("AGPL", "GNU AFFERO GENERAL PUBLIC LICENSE"): {"3": "19 November 2007"},
    ("Apache", "Apache License"): {"2.0": "January 2004"},
    ("Apache", "Apache Software License"): {"1.0": "", "1.1": ""},
    ("MPL", "Mozilla Public License"): {"1.0": "", "1.1": "", "2.0": ""},
    ("EPL", "Eclipse Public License"): {"1.0": "", "2.0": ""},
}
_CC = {"": "", "-NC": "-NonCommercial", "-SA": "-ShareAlike", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}
for _short, _long in _CC.items():
    _name = f"Creative Commons Attribution{_long}"
    TITLES[f"CC-BY{_short}", _name] = {"3.0": "Unported", "4.0": "International"}
    TEMPLATES.setdefault(f"CC-BY{_short}-4.0", []).extend([f"Licensed under CC BY{_short} 4.0.", f"This work is licensed under a {_name} 4.0 International License."])
for (_family, _name), _versions in TITLES.items():
    for _v, _more in _versions.items():
        _own = TEMPLATES.setdefault(f"{_family}-{_v if '.' in _v else _v + '.0'}", [])
        _forms = [f"{_name} {_v}"] if _family.startswith("CC") else [f"{_name} Version {_v}", f"{_name} v{_v}"]
        _own += [t for f in _forms for t in ((f, f"{f} {_more}") if _more else (f,))]
ANCHOR = rf"(?i)licen[cs]|copyright|public[{SPACE}]+domain|spdx|creative[{SPACE}]+commons|cc0"
TOKEN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
#: Words that only say which version; they are left out of the comparison, as CLAIM decides it.
VERSION = r"^(v|version|v?[0-9](\.[0-9])?)$"
LEAST = 0.75
#: The score from which a piece counts as equal to a title, and that which suffices where a piece names the template's licence itself.
SAME, NEAR = 0.999, 0.4
#: Words by which a piece declares a licence, and words that make a short piece a remark about one.
DECLARES = r"(^| )(licensed|licenced|released|distributed|redistribute|redistribution|permission|permitted|subject to|waived|dedicated|unencumbered)( |$)"
DOUBTS = r"(^| )(not|never|no|isn|aren|wasn|weren|formerly|previously|was|were|once|unless|until|if|may|might|could|should)( |$)"
SHORT = 20
#: A family of versioned licences, up to twelve words, and the version; in words joined by single spaces.
CLAIM = (
    r"(?:^| )((?:lesser |library |affero )?general public licen[cs]e|[al]?gpl|apache (?:software )?licen[cs]e|apache|mozilla public licen[cs]e|mpl|eclipse public licen[cs]e|epl|"
    r"creative commons attribution[a-z-]*|cc[ -]by[a-z-]*?|creative commons zero|cc0)(?: [a-z-]+){0,12}?[ -]?v?([0-9](?:\.[0-9])?)(?: |$)"
)
CLAUSES = r"(?:^| )bsd[ -]([0-9])-clause(?: |$)"
#: Names of licences without a version.
PLAIN = r"(?:^| )(mit|isc) licen[cs]e(?: |$)"
#: A tag at the start of a line, behind signs of comments only.
TAG = r"^[^A-Za-z0-9]*SPDX-License-Identifier:[\x20\x09]*(\(*[A-Za-z0-9.+\-]*[A-Za-z0-9+]\)*(?:[\x20\x09]+(?:AND|OR|WITH)[\x20\x09]+\(*[A-Za-z0-9.+\-]*[A-Za-z0-9+]\)*)*)"
#: What parts paragraphs: line feeds with space only between them.
GAP = r"\n[\x20\x09\x0B-\x0D]*\n"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"({TOKEN})"), F.lit(1))


def _words(text: str) -> list[str]:
    """A template's words but for those of versions."""
    return [w for w in re.findall(TOKEN, text.lower()) if not re.search(VERSION, w)]


def template_rows(templates=TEMPLATES) -> list[tuple[str, int, str, float]]:
    """(licence, number of the text, token, times in it)."""
    numbered = enumerate((name, text) for name, texts in templates.items() for text in texts)
    return [(name, i, w, float(_words(text).count(w))) for i, (name, text) in numbered for w in sorted(set(_words(text)))]


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({r[2] for r in template_rows(templates)})


def prepared(files: DataFrame, words: list[str]) -> DataFrame:
    """One pass over the texts: id, dir, the text's hash _th, the templates' words in it, and the text itself where it names a licence."""
    known = F.filter(F.array_distinct(_tokens(F.coalesce("text", F.lit("")))), lambda w: w.isin(*words))
    return files.select("id", directory(F.col("path")).alias("dir"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_th"), known.alias("known"), F.when(F.regexp_like("text", F.lit(ANCHOR)), F.col("text")).alias("text"))


def idf_table(held: DataFrame, words: list[str]) -> DataFrame:
    """(token, idf) of the templates' words over all files; one row more, of the empty token, holds the weight of any other word."""
    counted = held.select(F.explode(F.concat("known", F.array(F.lit("")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    listed = held.sparkSession.createDataFrame([(w,) for w in [*words, ""]], "token string")
    joined = listed.join(F.broadcast(counted), "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    total = joined.filter("token = ''").select(F.col("df").alias("n"))
    df = F.when(F.col("token") == "", 0).otherwise(F.col("df"))
    return joined.crossJoin(F.broadcast(total)).select("token", (F.log((1.0 + F.col("n")) / (1.0 + df)) + 1.0).alias("idf"))


def claimed(words: Column) -> Column:
    """The versioned licence that a piece names first, from its words joined by spaces; null where it names none."""
    name, version = F.regexp_extract(words, CLAIM, 1), F.regexp_extract(words, CLAIM, 2)
    number = F.when(F.contains(version, F.lit(".")), version).otherwise(F.concat(version, F.lit(".0")))
    long_form = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^creative commons attribution", "by"), "noncommercial", "nc"), "sharealike", "sa"), "noderiv(ative)?s", "nd")
    family = (
        F.when(F.regexp_like(name, F.lit("^(affero|agpl)")), "AGPL").when(F.regexp_like(name, F.lit("^(lesser|library|lgpl)")), "LGPL").when(F.regexp_like(name, F.lit("^(general|gpl)")), "GPL")
        .when(F.startswith(name, F.lit("apache")), "Apache").when(F.regexp_like(name, F.lit("^(mozilla|mpl)")), "MPL").when(F.regexp_like(name, F.lit("^(eclipse|epl)")), "EPL")
        .when(F.regexp_like(name, F.lit("^(creative commons zero|cc0)")), "CC0").when(F.startswith(name, F.lit("creative")), F.concat(F.lit("CC-"), F.upper(long_form)))
        .otherwise(F.upper(F.regexp_replace(name, " ", "-")))
    )
    clauses = F.regexp_extract(words, CLAUSES, 1)
    return F.when(name != "", F.concat(family, F.lit("-"), number)).when(clauses != "", F.concat(F.lit("BSD-"), clauses, F.lit("-Clause")))


def kind_of(name: Column) -> Column:
    """The family of a licence's name; kinds of attribution are one, and so are those of BSD."""
    return F.when(F.startswith(name, F.lit("CC-BY")), "CC-BY").when(F.startswith(name, F.lit("BSD-")), "BSD").otherwise(F.regexp_replace(name, "-[0-9.]+$", ""))


def decided(template: Column, title: Column, score: Column, claim: Column, plain: Column, declares: Column, doubts: Column, least: float) -> Column:
    """The licence that a piece declares by its score with a template; null where it declares none."""
    itself = F.when(claim.isNotNull(), kind_of(claim) == kind_of(template)).otherwise(F.upper(plain) == template)
    fits = F.when(title, score >= SAME).otherwise(((score >= least) | itself) & declares & ~doubts)
    versioned = F.regexp_like(template, F.lit("[0-9]"))
    named = F.when(claim.isNotNull(), F.when(kind_of(claim) == kind_of(template), claim)).when(~versioned, template)
    # two and three clauses are told apart by the text where no number is named
    return F.when(fits, F.coalesce(named, F.when(claim.isNull() & F.startswith(template, F.lit("BSD-")), template)))


def own_licences(held: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, _th, own_license, own_score, file_license) of the files that have a licence of their own; file_license is that of a licence file."""
    spark = held.sparkSession
    idf = F.broadcast(materialize(idf_table(held, vocabulary(templates)), "licence-idf"))  # one row a word of the templates
    weight = (1.0 + F.log("tf")) * F.col("idf")
    sides = spark.createDataFrame(template_rows(templates), "name string, t int, token string, tf double").join(idf, "token").select("name", "t", "token", weight.alias("tw"))
    norms = sides.groupBy("t").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    titles = spark.createDataFrame([(t, not re.search(DECLARES, " ".join(_words(text)))) for t, text in enumerate(text for texts in templates.values() for text in texts)], "t int, title boolean")
    sides = F.broadcast(sides.join(F.broadcast(norms), "t").join(F.broadcast(titles), "t"))

    named = held.filter("text IS NOT NULL").select("id", "text", "_th").dropDuplicates(["id", "_th"])
    lines = F.filter(F.split("text", "\n"), lambda line: F.regexp_like(line, F.lit(f"[^{SPACE}]")))
    blocks = F.filter(F.split("text", GAP), lambda block: F.regexp_like(block, F.lit(f"[^{SPACE}]")))
    pieces = lambda kind, values: F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), v.alias("segment")))
    whole = F.array(F.struct(F.lit(2).alias("kind"), F.lit(0).alias("pos"), F.col("text").alias("segment")))
    cut = named.select("id", "_th", F.inline(F.concat(pieces(0, lines), F.filter(pieces(1, blocks), lambda s: F.contains(s["segment"], F.lit("\n"))), whole)))
    segments = cut.filter(F.regexp_like("segment", F.lit(ANCHOR)))
    at = ["id", "_th", "kind", "pos"]
    tags = segments.filter("kind = 0").select(*at, F.regexp_extract("segment", TAG, 1).alias("name"), F.lit(1.0).alias("score")).filter("name <> ''")
    worded = segments.select(*at, _tokens(F.col("segment")).alias("tokens")).withColumn("words", F.array_join("tokens", " "))
    doubts = (F.size("tokens") <= SHORT) & F.regexp_like("words", F.lit(DOUBTS))
    marked = worded.select(*at, "tokens", claimed(F.col("words")).alias("claim"), F.regexp_extract("words", PLAIN, 1).alias("plain"), F.regexp_like("words", F.lit(DECLARES)).alias("declares"), doubts.alias("doubts"))
    marks = ["claim", "plain", "declares", "doubts"]
    counts = marked.select(*at, *marks, F.explode(F.filter("tokens", lambda w: ~F.regexp_like(w, F.lit(VERSION)))).alias("token")).groupBy(*at, *marks, "token").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    other = F.broadcast(idf.filter("token = ''").select(F.col("idf").alias("other")))
    known = counts.join(idf, "token", "left").crossJoin(other).withColumn("idf", F.coalesce("idf", "other")).withColumn("sw", weight)
    norm = known.groupBy(*at).agg(F.sqrt(F.sum(F.col("sw") * F.col("sw"))).alias("sn"), *(F.first(m).alias(m) for m in marks))
    dots = known.join(sides, "token").groupBy(*at, "name", "t").agg(F.sum(F.col("sw") * F.col("tw")).alias("dot"), F.first("tn").alias("tn"), F.first("title").alias("title"))
    same = F.col("a.id").eqNullSafe(F.col("b.id"))
    for c in at[1:]:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    scored = dots.alias("a").join(norm.alias("b"), same).select("a.*", *marks, F.round(F.col("dot") / (F.col("tn") * F.col("sn")), 6).alias("score")).filter(F.col("score") >= min(NEAR, least))
    found = scored.select(*at, decided(F.col("name"), F.col("title"), F.col("score"), F.col("claim"), F.col("plain"), F.col("declares"), F.col("doubts"), least).alias("name"), "score").filter("name IS NOT NULL")
    order = F.struct(-F.col("score"), "pos", "name")
    best = F.min_by(F.struct("name", "score"), order)
    of_file = F.min_by(F.when(F.col("pos") == 0, F.col("name")), F.when(F.col("pos") == 0, order))
    return found.unionByName(tags).groupBy("id", "_th").agg(best.alias("b"), of_file.alias("file_license")).select("id", "_th", F.col("b.name").alias("own_license"), F.col("b.score").alias("own_score"), "file_license")


def directory(path: Column) -> Column:
    """The path without its last part; null where it has none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def ancestors(dirs: DataFrame) -> DataFrame:
    """(dir, above) for each directory and itself and every directory above it."""
    parts = F.split("dir", "/")
    return dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), n), "/"))).alias("above"))


def scan_licenses(files: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """files: id, path, text. One row a file: id, dir, own_license, own_score, license, origin (own, inherited, none), license_dir."""
    mark = written()
    all_ = materialize(prepared(files.select("id", "path", "text"), vocabulary(templates)), "licence-files")
    own = materialize(own_licences(all_, templates, least), "licence-own")
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a._th") == F.col("b._th"))
    held = all_.alias("a").join(own.alias("b"), same, "left").select("a.id", "a.dir", "own_license", "own_score", "file_license")
    by_dir = held.filter("file_license IS NOT NULL AND dir IS NOT NULL").groupBy(F.col("dir").alias("above")).agg(F.min_by("file_license", F.struct(F.col("id").isNull(), "id", "file_license")).alias("dir_license"))
    needy = held.filter("own_license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    nearest = ancestors(needy).join(by_dir, "above").groupBy("dir").agg(F.max_by(F.struct("above", "dir_license"), F.length("above")).alias("n"))
    joined = held.join(nearest, "dir", "left")
    inherited = F.when(F.col("own_license").isNull(), F.col("n.dir_license"))
    origin = F.when(F.col("own_license").isNotNull(), "own").when(inherited.isNotNull(), "inherited").otherwise("none")
    license_dir = F.when(F.col("own_license").isNull(), F.col("n.above")).alias("license_dir")
    return finished(joined.select("id", "dir", "own_license", "own_score", F.coalesce("own_license", inherited).alias("license"), origin.alias("origin"), license_dir), "licence-result", mark)


def document_path(source: Column, doc_id: Column) -> Column:
    """Documents carry no paths; this lays them out below their source: ids divisible by 100 there, those by 10 one level down, others two."""
    top, low = F.floor(doc_id / 1000).cast("string"), F.floor(doc_id / 100).cast("string")
    name = F.concat(F.lit("/"), doc_id.cast("string"))
    return F.when(doc_id % 100 == 0, F.concat(source, name)).when(doc_id % 10 == 0, F.concat(source, F.lit("/"), top, name)).otherwise(F.concat(source, F.lit("/"), top, F.lit("/"), low, name))


def _oracle() -> str:
    values = ", ".join(f"('{n}', {t}, '{w}', {tf}::DOUBLE)" for n, t, w, tf in template_rows())
    titles = [t for t, text in enumerate(text for texts in TEMPLATES.values() for text in texts) if not re.search(DECLARES, " ".join(_words(text)))]
    kind = lambda c: f"CASE WHEN starts_with({c}, 'CC-BY') THEN 'CC-BY' WHEN starts_with({c}, 'BSD-') THEN 'BSD' ELSE regexp_replace({c}, '-[0-9.]+$', '') END"
    return f"""
WITH tpl(name, t, token, tf) AS (VALUES {values}),
f AS (
  SELECT doc_id AS id, row_number() OVER () AS rid, text,
    CASE WHEN doc_id % 100 = 0 THEN source WHEN doc_id % 10 = 0 THEN source || '/' || (doc_id // 1000)::VARCHAR
      ELSE source || '/' || (doc_id // 1000)::VARCHAR || '/' || (doc_id // 100)::VARCHAR END AS dir
  FROM documents
), df AS (
  SELECT token, count(*) AS df FROM (SELECT DISTINCT rid, unnest(regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}')) AS token FROM f) WHERE token IN (SELECT token FROM tpl) GROUP BY token
), n AS (SELECT count(*) AS n FROM f),
idf AS (
  SELECT token, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + coalesce(df, 0))) + 1.0 AS idf FROM (SELECT DISTINCT token FROM tpl) LEFT JOIN df USING (token), n
), sides AS (
  SELECT name, t, token, (1.0 + ln(tf)) * idf AS tw FROM tpl JOIN idf USING (token)
), norms AS (SELECT t, sqrt(sum(tw * tw)) AS tn FROM sides GROUP BY t),
named AS (SELECT * FROM f WHERE regexp_matches(text, '{ANCHOR}')),
lined AS (
  SELECT rid, 0 AS kind, row_number() OVER (PARTITION BY rid ORDER BY i) - 1 AS pos, line AS segment
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM named)
  WHERE regexp_matches(line, '[^{SPACE}]')
), parted AS (
  SELECT rid, 1 AS kind, row_number() OVER (PARTITION BY rid ORDER BY i) - 1 AS pos, block AS segment
  FROM (SELECT rid, unnest(string_split_regex(text, '{GAP}')) AS block, generate_subscripts(string_split_regex(text, '{GAP}'), 1) AS i FROM named)
  WHERE regexp_matches(block, '[^{SPACE}]')
), segments AS (
  SELECT * FROM lined WHERE regexp_matches(segment, '{ANCHOR}') UNION ALL SELECT * FROM parted WHERE regexp_matches(segment, '{ANCHOR}') AND contains(segment, chr(10))
  UNION ALL SELECT rid, 2, 0, text FROM named
), worded AS (
  SELECT rid, kind, pos, segment, regexp_extract_all(lower(segment), '{TOKEN}') AS tokens FROM segments
), joined AS (SELECT *, array_to_string(tokens, ' ') AS words FROM worded),
parts AS (
  SELECT *, regexp_extract(words, '{CLAIM}', 1) AS cn, regexp_extract(words, '{CLAIM}', 2) AS cv, regexp_extract(words, '{CLAUSES}', 1) AS cc FROM joined
), marked AS (
  SELECT rid, kind, pos, upper(regexp_extract(words, '{PLAIN}', 1)) AS plain, regexp_matches(words, '{DECLARES}') AS declares, len(tokens) <= {SHORT} AND regexp_matches(words, '{DOUBTS}') AS doubts,
    CASE WHEN cn <> '' THEN CASE
        WHEN regexp_matches(cn, '^(affero|agpl)') THEN 'AGPL' WHEN regexp_matches(cn, '^(lesser|library|lgpl)') THEN 'LGPL' WHEN regexp_matches(cn, '^(general|gpl)') THEN 'GPL'
        WHEN starts_with(cn, 'apache') THEN 'Apache' WHEN regexp_matches(cn, '^(mozilla|mpl)') THEN 'MPL' WHEN regexp_matches(cn, '^(eclipse|epl)') THEN 'EPL'
        WHEN regexp_matches(cn, '^(creative commons zero|cc0)') THEN 'CC0'
        WHEN starts_with(cn, 'creative') THEN 'CC-' || upper(regexp_replace(replace(replace(regexp_replace(cn, '^creative commons attribution', 'by'), 'noncommercial', 'nc'), 'sharealike', 'sa'), 'noderiv(ative)?s', 'nd'))
        ELSE upper(replace(cn, ' ', '-')) END || '-' || CASE WHEN contains(cv, '.') THEN cv ELSE cv || '.0' END
      WHEN cc <> '' THEN 'BSD-' || cc || '-Clause' END AS claim
  FROM parts
), tags AS (
  SELECT rid, pos, regexp_extract(segment, '{TAG}', 1) AS name, 1.0::DOUBLE AS score FROM segments WHERE kind = 0 AND regexp_matches(segment, '{TAG}')
), counts AS (
  SELECT rid, kind, pos, token, count(*)::DOUBLE AS tf FROM (SELECT rid, kind, pos, unnest(tokens) AS token FROM worded) WHERE NOT regexp_matches(token, '{VERSION}') GROUP BY ALL
), known AS (
  SELECT rid, kind, pos, token, (1.0 + ln(tf)) * coalesce(idf, ln(1.0::DOUBLE + n) + 1.0) AS sw FROM counts LEFT JOIN idf USING (token), n
), sn AS (SELECT rid, kind, pos, sqrt(sum(sw * sw)) AS sn FROM known GROUP BY ALL),
scored AS (
  SELECT rid, kind, pos, name, t, round(sum(sw * tw) / (any_value(tn) * any_value(sn)), 6) AS score
  FROM known JOIN sides USING (token) JOIN norms USING (t) JOIN sn USING (rid, kind, pos) GROUP BY ALL
), fitting AS (
  SELECT rid, pos, score, name AS tpl, claim FROM scored JOIN marked USING (rid, kind, pos)
  WHERE score >= {min(NEAR, LEAST)} AND CASE WHEN list_contains({titles}, t) THEN score >= {SAME} ELSE declares AND NOT doubts AND (score >= {LEAST} OR CASE WHEN claim IS NOT NULL THEN {kind('claim')} = {kind('name')} ELSE plain = name END) END
), found AS (
  SELECT rid, pos, score, CASE WHEN claim IS NOT NULL THEN CASE WHEN {kind('claim')} = {kind('tpl')} THEN claim END WHEN NOT regexp_matches(tpl, '[0-9]') OR starts_with(tpl, 'BSD-') THEN tpl END AS name FROM fitting
), all_found AS (SELECT rid, pos, score, name FROM found WHERE name IS NOT NULL UNION ALL SELECT rid, pos, score, name FROM tags),
own AS (
  SELECT rid, first(name ORDER BY score DESC, pos, name) AS own_license, max(score) AS own_score, first(name ORDER BY score DESC, name) FILTER (WHERE pos = 0) AS file_license FROM all_found GROUP BY rid
), held AS (SELECT * FROM f LEFT JOIN own USING (rid)),
by_dir AS (SELECT dir AS above, first(file_license ORDER BY id NULLS LAST, file_license) AS dir_license FROM held WHERE file_license IS NOT NULL AND dir IS NOT NULL GROUP BY dir),
near AS (
  SELECT h.rid, first(above ORDER BY length(above) DESC) AS above, first(dir_license ORDER BY length(above) DESC) AS dir_license
  FROM held h JOIN by_dir b ON h.dir = b.above OR starts_with(h.dir, b.above || '/') WHERE h.own_license IS NULL GROUP BY h.rid
)
SELECT id AS doc_id, dir, own_license, own_score, coalesce(own_license, dir_license) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, above AS license_dir
FROM held LEFT JOIN near USING (rid)
"""


ORACLE = _oracle()
