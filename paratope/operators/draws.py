"""Bounded sampling of non-binding pairs: receptors are drawn for each antigen, and only what is drawn is tested.

Donor antigens and each one's receptors are numbered. A draw of an antigen is a number of a donor and of one of
its receptors, both from hashes of the antigen's id and the draw's number, so a draw is the same in every run and
draws need no order of work. Drawn pairs lose those that are barred (the donor is near the antigen) or close (the
receptor is near one of the antigen's) by anti-joins. No table of antigens by receptors is made but for antigens
that stay short, and for those with no more candidates than they need.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paratope.functions.keys import seeded_number
from paratope.operators.relational import numbered
from paratope.session import Steps, fitted, settled

#: Draws of the first round for a need; each later round brings all draws to a multiple of it.
ROUNDS = (1, 5, 21)
#: Receptors of a drawn donor that are tried until one is open.
TRIES = 8
#: A donor's weight in whole numbers, so that sums agree in any order.
UNIT = 10**12


def draws_for(need: Column) -> Column:
    return (4 * need + 16).cast("long")


@dataclass
class Pool:
    """offers(source_id, tcr_id, tcr_no, n) numbered from 0 within their source, and sources(source_id, source_no, n)."""

    offers: DataFrame
    sources: DataFrame
    size: int

    @classmethod
    def of(cls, offers: DataFrame) -> Pool:
        offers = offers.select("source_id", "tcr_id").distinct()
        counts = offers.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
        sources = numbered(counts, [], [F.col("source_id")], "source_no").withColumn("source_no", F.col("source_no") - 1)
        places = numbered(offers, ["source_id"], [F.col("tcr_id")], "tcr_no").withColumn("tcr_no", F.col("tcr_no") - 1)
        sources = fitted(sources)
        return cls(settled(places.join(sources.select("source_id", "n"), "source_id")), sources, sources.count())

    def drawn(self, asks: DataFrame, first: Column, end: Column, tries: int, seed: str) -> DataFrame:
        """antigen_id, r, j, source_id, tcr_id: `tries` receptors of the source of each draw from first to end - 1."""
        if not self.size:
            return asks.select("antigen_id", F.lit(0).alias("r"), F.lit(0).alias("j"), F.lit("").alias("source_id"), F.lit("").alias("tcr_id")).limit(0)
        rows = asks.filter(first < end).select("antigen_id", F.explode(F.sequence(first, end - 1)).alias("r"))
        picked = rows.withColumn("source_no", seeded_number(f"{seed}|source", "antigen_id", "r") % self.size).join(self.sources, "source_no")
        tried = picked.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("tcr_no", seeded_number(f"{seed}|receptor", "antigen_id", "r", "j") % F.col("n"))
        return tried.join(self.offers.select("source_id", "tcr_no", "tcr_id"), ["source_id", "tcr_no"]).select("antigen_id", "r", "j", "source_id", "tcr_id")

    def all_of(self, asks: DataFrame) -> DataFrame:
        """antigen_id, source_id, tcr_id, n of every offer: for antigens that draws leave short."""
        if not self.size:
            return asks.select("antigen_id", F.lit("").alias("source_id"), F.lit("").alias("tcr_id"), F.lit(1).alias("n")).limit(0)
        each = asks.select("antigen_id", F.explode(F.sequence(F.lit(0), F.lit(self.size - 1))).alias("source_no"))
        return each.join(self.sources, "source_no").select("antigen_id", "source_id").join(self.offers, "source_id").select("antigen_id", "source_id", "tcr_id", "n")


def _open(pairs: DataFrame, close: DataFrame, barred: DataFrame) -> DataFrame:
    return pairs.join(barred, ["antigen_id", "source_id"], "left_anti").join(close, ["antigen_id", "tcr_id"], "left_anti")


def _short(needs: DataFrame, found: DataFrame) -> DataFrame:
    have = found.groupBy("antigen_id").agg(F.count(F.lit(1)).alias("have"))
    return needs.join(have, "antigen_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < need")


def _first(found: DataFrame, needs: DataFrame) -> DataFrame:
    """The first `need` draws of each antigen, by r."""
    return numbered(found.select("antigen_id", "tcr_id", "r"), ["antigen_id"], [F.col("r")], "_n").join(needs, "antigen_id").filter("_n <= need").select("antigen_id", "tcr_id")


@dataclass
class Candidates:
    """What is no candidate: gone(antigen_id, tcr_id), of all receptors(tcr_id, no), numbered from 1."""

    gone: DataFrame
    receptors: DataFrame
    total: int

    @classmethod
    def of(cls, needs: DataFrame, pool: Pool, close: DataFrame, barred: DataFrame) -> Candidates:
        """Pairs that are close, and those all of whose sources are barred."""
        held = pool.offers.groupBy("tcr_id").agg(F.count(F.lit(1)).alias("held"))
        asked = needs.select("antigen_id")
        lost = barred.join(asked, "antigen_id", "left_semi").join(pool.offers.select("source_id", "tcr_id"), "source_id").groupBy("antigen_id", "tcr_id").agg(F.count(F.lit(1)).alias("lost")).join(held, "tcr_id").filter("lost >= held").select("antigen_id", "tcr_id")
        gone = close.join(asked, "antigen_id", "left_semi").join(held.select("tcr_id"), "tcr_id", "left_semi").select("antigen_id", "tcr_id").unionByName(lost).distinct()
        receptors = settled(numbered(held.select("tcr_id"), [], [F.col("tcr_id")], "no"))
        return cls(settled(gone), receptors, receptors.count())

    def counts(self, needs: DataFrame) -> DataFrame:
        """antigen_id, need, candidates."""
        gone = self.gone.groupBy("antigen_id").agg(F.count(F.lit(1)).alias("gone"))
        return settled(needs.join(gone, "antigen_id", "left").select("antigen_id", "need", (F.lit(self.total) - F.coalesce("gone", F.lit(0))).alias("candidates")))

    def of_antigens(self, asks: DataFrame) -> DataFrame:
        """antigen_id, tcr_id of all candidates of antigens that need about as many as there are."""
        each = asks.select("antigen_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max(self.total, 1)).cast("long"))).alias("no"))
        return each.join(self.receptors, "no").select("antigen_id", "tcr_id").join(self.gone, ["antigen_id", "tcr_id"], "left_anti")


def rejection_sample(needs: DataFrame, pool: Pool, close: DataFrame, barred: DataFrame, seed: str) -> DataFrame:
    """(antigen_id, tcr_id): for each antigen `need` receptors, a donor and then one of its receptors drawn evenly, again and again; what is barred, close or drawn before is passed over.

    Antigens that the draws of all ROUNDS leave short get the rest by the same law: what is drawn next, repeats
    passed over, are the candidates in the order of exponential times with their chances as rates. Antigens with
    no more candidates than they need get them all, without a draw.
    """
    open_ = Candidates.of(needs, pool, close, barred)
    counts = open_.counts(needs)
    every = open_.of_antigens(counts.filter("candidates > 0 AND candidates <= need"))
    plenty = settled(counts.filter("candidates > need").select("antigen_id", "need"))
    if plenty.isEmpty():
        return every
    short, found, before = plenty, None, F.lit(0).cast("long")
    for times in ROUNDS:
        end = draws_for(F.col("need")) * times
        new = _open(pool.drawn(short, before, end, 1, seed), close, barred).groupBy("antigen_id", "tcr_id").agg(F.min("r").alias("r"))
        found = settled(new if found is None else found.unionByName(new).groupBy("antigen_id", "tcr_id").agg(F.min("r").alias("r")))
        short = settled(_short(plenty, found))
        if short.isEmpty():
            break
        before = end
    taken = every.unionByName(_first(found, plenty))
    rest = _open(pool.all_of(short), close, barred).join(found, ["antigen_id", "tcr_id"], "left_anti")
    weighed = rest.groupBy("antigen_id", "tcr_id").agg(F.sum(F.floor(UNIT / F.col("n"))).alias("w"))
    time = -F.log((seeded_number(f"{seed}|rest", "antigen_id", "tcr_id") + 0.5) / float(2**32)) / F.col("w")
    late = numbered(weighed.withColumn("t", time), ["antigen_id"], [F.col("t"), F.col("tcr_id")], "_n").join(short, "antigen_id").filter(F.col("_n") <= F.col("need") - F.col("have"))
    return taken.unionByName(late.select("antigen_id", "tcr_id"))


def settled_draws(tries: DataFrame) -> DataFrame:
    """(antigen_id, r, tcr_id): draws in order of r take the first of their tries that no earlier draw has taken.

    All draws propose at once; of those that propose one receptor the earliest keeps it, and the others go on to
    their next try. As all receptors prefer earlier draws, what is stable in the end is what taking turns gives.
    """
    steps = Steps()
    left = steps.put(tries)
    n = left.count()
    while True:
        asked = left.groupBy("antigen_id", "r").agg(F.min_by("tcr_id", "j").alias("tcr_id"))
        held = steps.put(asked.groupBy("antigen_id", "tcr_id").agg(F.min("r").alias("holder")))
        left = steps.put(left.join(held, ["antigen_id", "tcr_id"], "left").filter(F.col("holder").isNull() | (F.col("holder") >= F.col("r"))).drop("holder"))
        before, n = n, left.count()
        if n == before:
            return held.select("antigen_id", F.col("holder").alias("r"), "tcr_id")
        steps.turn(tries.sparkSession)


def strike_out_sample(needs: DataFrame, pool: Pool, close: DataFrame, barred: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """((antigen_id, tcr_id), (antigen_id, need) of what is still needed): sources drawn evenly, then one of a source's open receptors, which is struck from every source.

    An antigen with no more candidates than it needs gets them all; they are counted from the exceptions, not
    listed. A drawn source is tried TRIES times and passed over if no try is open; antigens that the draws of
    all ROUNDS leave short get the rest in a seeded order.
    """
    open_ = Candidates.of(needs, pool, close, barred)
    counts = open_.counts(needs)
    every = open_.of_antigens(counts.filter("candidates > 0 AND candidates <= need"))
    plenty = settled(counts.filter("candidates > need").select("antigen_id", "need"))

    short, parts, tries, before = plenty, [every], None, F.lit(0).cast("long")
    for times in ROUNDS:
        if short.isEmpty():
            break
        end = draws_for(F.col("need")) * times
        new = _open(pool.drawn(short, before, end, TRIES, seed), close, barred).select("antigen_id", "r", "j", "tcr_id")
        tries = settled(new if tries is None else tries.join(short.select("antigen_id"), "antigen_id", "left_semi").unionByName(new))
        found = settled_draws(tries)
        ahead = short.select("antigen_id", "need")
        short = settled(_short(ahead, found))
        parts.append(_first(found, ahead.join(short.select("antigen_id"), "antigen_id", "left_anti")))
        before = end
    if tries is not None and not short.isEmpty():
        had = found.join(short.select("antigen_id"), "antigen_id", "left_semi").select("antigen_id", "tcr_id")
        rest = open_.of_antigens(short).join(had, ["antigen_id", "tcr_id"], "left_anti")
        late = numbered(rest.withColumn("t", seeded_number(f"{seed}|rest", "antigen_id", "tcr_id")), ["antigen_id"], [F.col("t"), F.col("tcr_id")], "_n").join(short, "antigen_id").filter(F.col("_n") <= F.col("need") - F.col("have"))
        parts += [had, late.select("antigen_id", "tcr_id")]
    left = counts.filter("candidates < need").select("antigen_id", (F.col("need") - F.col("candidates")).alias("need"))
    return reduce(lambda a, b: a.unionByName(b), parts), left
