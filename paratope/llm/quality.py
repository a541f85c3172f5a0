"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document into one failure bit; the measurements stay beside the mask.
A policy is a version name and a set of rules: applying one, or leaving rules out of it, is bit
arithmetic on the ledger, and ablations are bitwise aggregates over it. No text is read again.

Cases: null or empty text has no words, so all measurements are 0 and `too_few_words` fails; words
are counted in whole texts of any length; repeated rows are judged one by one; an empty table gives
an empty ledger; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paratope.llm.common import SPACE, WORD, let

#: Rules in order of their bits; each is true where a document fails. All are integer comparisons.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "100 * n_symbols > 30 * n_words",
    "short_words": "10 * word_chars < 25 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "duplicate_lines": "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines",
    "upper_case": "100 * n_upper > 50 * word_chars",
}
#: Policies by version: the rules that each applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("too_few_words", "repeated_windows"),
    "default-1": tuple(RULES),
}
BASE, DEFAULT = "base-1", "default-1"


def rule_mask(names) -> int:
    bits = list(RULES)
    return sum(1 << bits.index(n) for n in names)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text: hash the windows, sort them with their positions, keep those with an equal neighbour, and add up the covered positions."""

    def windows(h: Column) -> Column:
        second, third = F.slice(h, F.lit(2), F.size(h)), F.slice(h, F.lit(3), F.size(h))
        pairs = F.zip_with(second, third, lambda b, c: F.xxhash64(b, c))
        return F.slice(F.zip_with(h, pairs, lambda a, p: F.xxhash64(a, p)), F.lit(1), F.greatest(F.size(h) - 2, F.lit(0)))

    def repeated(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.sort_array(F.transform(same, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def count(w: Column) -> Column:
        tagged = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(let(tagged, repeated), covered))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def measurements(text: Column) -> dict[str, Column]:
    """All measurements of one text; the words and lines are cut once each."""
    filled = F.coalesce(text, F.lit(""))

    def by_words(words: Column) -> Column:
        chars = F.aggregate(words, F.lit(0), lambda total, w: total + F.char_length(w))
        return F.struct(F.size(words).cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), F.coalesce(_repeat_words(words), F.lit(0)).cast("long").alias("n_repeat_words"))

    def by_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(filled, "\n"), lambda line: F.regexp_like(line, F.lit(f"[^{SPACE}]")))
    return {
        "_w": let(F.regexp_extract_all(filled, F.lit(f"({WORD})"), F.lit(1)), by_words),
        "_l": let(lines, by_lines),
        "n_symbols": F.regexp_count(filled, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_upper": F.regexp_count(filled, F.lit(r"\p{Lu}")).cast("long"),
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document: key, the measurements and `failures`, a bit for each rule."""
    measured = documents.select(key, F.col("text")).select(key, *(c.alias(n) for n, c in measurements(F.col("text")).items()))
    flat = measured.select(key, "_w.*", "_l.*", "n_symbols", "n_upper").select(key, *MEASURES)
    bits = [F.when(F.expr(test), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, test in enumerate(RULES.values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return flat.withColumn("failures", mask)


def apply_policy(entries: DataFrame, version: str = DEFAULT) -> DataFrame:
    """Adds base_failed and kept under the named policy; rows that fail the base are never kept."""
    hit = lambda names: F.col("failures").bitwiseAND(F.lit(rule_mask(names)).cast("long")) != 0
    return entries.withColumn("base_failed", hit(POLICIES[BASE])).withColumn("kept", ~F.col("base_failed") & ~hit(POLICIES[version]))


def ablations(entries: DataFrame, version: str = DEFAULT) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that would come back without it (no other rule of the policy fails)."""
    names, policy = POLICIES[version], rule_mask(POLICIES[version])
    active = F.col("failures").bitwiseAND(F.lit(policy).cast("long"))
    counts = entries.agg(
        F.count(F.lit(1)).alias("n_documents"),
        *(F.count_if(active.bitwiseAND(F.lit(rule_mask([n])).cast("long")) != 0).alias(f"f_{n}") for n in names),
        *(F.count_if(active == rule_mask([n])).alias(f"o_{n}") for n in names),
    )
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only")) for n in names))
    return counts.select("n_documents", F.inline(rows))


_FAIL = " OR ".join(f"({test})" for test in RULES.values())
ORACLE = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), ls AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid
), win AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n >= 2
), cov AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '\\p{{Lu}}')) AS BIGINT) AS n_upper,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN ls USING (rid) LEFT JOIN cov USING (rid)
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, ({_FAIL}) AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT failed AS kept FROM f
"""
