"""IMGT numbers and germline genes of receptor sequences, from a table of gapped germline templates.

Templates: germline(species, chain, kind, gene, gapped), kind V or J; character i of `gapped` holds the residue
of IMGT number i or a gap ('.' or '-'), V to the cysteine at 104 or beyond, J from 118 or before.

A gene is called by the greatest number of identical residues on one diagonal (a place of the template beside
the sequence without gaps), of equal ones the first gene, then the smallest diagonal. Words of WORD residues
that sequence and template share vote for their diagonal. A mismatch breaks at most WORD words, so the votes
bound the identities from above: only diagonals whose bound reaches the best one found are compared residue by
residue, and all templates only for a sequence to which none is near. The table of templates is a species'
genes, some hundreds of rows.

Numbers are projected along the diagonal of V up to 104 and of J from 118 on; the loop between is numbered by
its length, from both ends, its surplus as 111 and 112. Where votes of one V gene fall on several near
diagonals, a residue is missing or too many, and that sequence alone is aligned to its template within a band;
a residue too many has the number of the one before it.

Cases: null sequences are left out, equal ones handled once; letters are compared as they are; a sequence of a
species and chain without templates has no domain.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paratope.functions.banded import placed
from paratope.session import fitted, settled, ship

WORD = 4
#: Identical residues that make a V domain, and what part of the template they must be.
LEAST_IDENTITIES, LEAST_PART = 40, 0.5
#: Diagonals farther apart than this are different domains, nearer ones a break.
APART = 60
BAND, BREAK = 12, 4
LAST_V, FIRST_J, LOOP = 104, 118, 13
GROUP = ["species", "chain"]


def templates(germline: DataFrame, kind: str) -> DataFrame:
    """species, chain, gene, residues and numbers (of the residues) of the V or J templates; V up to 104, J from 118 on.

    Residues are gathered by a grouping, not filtered by an expression of the gene: Spark would carry that condition over every
    join by gene, and spell the template anew for each sequence that it is joined with.
    """
    places = F.when(F.length("gapped") > 0, F.sequence(F.lit(1), F.length("gapped")))
    each = germline.filter(F.col("kind") == kind).select(*GROUP, "gene", "gapped", F.explode(places).alias("number"))
    inside = F.col("number") <= LAST_V if kind == "V" else F.col("number") >= FIRST_J
    letter = F.substring("gapped", F.col("number"), F.lit(1))
    held = F.sort_array(F.collect_list(F.struct("number", letter.alias("letter"))))
    rows = each.filter(inside & ~letter.isin(".", "-")).groupBy(*GROUP, "gene", "gapped").agg(held.alias("held"))
    return rows.select(*GROUP, "gene", F.array_join("held.letter", "").alias("residues"), F.col("held.number").alias("numbers"))


def _words(df: DataFrame, text: str, keys: list[str], place: str) -> DataFrame:
    starts = F.when(F.length(text) >= WORD, F.sequence(F.lit(1), F.length(text) - WORD + 1))
    return df.select(*keys, text, F.explode(starts).alias(place)).select(*keys, place, F.substring(text, F.col(place), F.lit(WORD)).alias("word"))


def _overlap(n: Column, size: Column, diagonal: Column) -> tuple[Column, Column]:
    """The first and last residue (from 1) of a template of that size that stand in a sequence of length n."""
    return F.greatest(F.lit(1), 1 - diagonal), F.least(size, n - diagonal)


def most_identities(overlap: Column, shared: Column) -> Column:
    """The most identities of an overlap with so many shared words: a mismatch breaks at most WORD of them."""
    lost = F.ceil((overlap - WORD + 1 - shared) / WORD)
    return F.when(overlap < WORD, overlap).otherwise(overlap - F.greatest(F.lit(0), lost)).cast("int")


def identities(seq: Column, residues: Column, diagonal: Column) -> Column:
    """How many residues of the template equal those of the sequence on a diagonal."""
    low, high = _overlap(F.length(seq), F.length(residues), diagonal)
    same = F.filter(F.sequence(low, high), lambda t: F.substring(seq, t + diagonal, F.lit(1)) == F.substring(residues, t, F.lit(1)))
    return F.when(low <= high, F.size(same)).otherwise(0)


def diagonals(asked: DataFrame, genes: DataFrame) -> DataFrame:
    """id, gene, diagonal, shared and bound of all diagonals with a shared word. asked: id, species, chain, seq."""
    sizes = genes.select(*GROUP, "gene", F.length("residues").alias("size"))
    known = F.broadcast(_words(genes, "residues", [*GROUP, "gene"], "t").join(sizes, [*GROUP, "gene"]))
    met = _words(asked.withColumn("n", F.length("seq")), "seq", ["id", *GROUP, "n"], "p").join(known, [*GROUP, "word"])
    votes = met.groupBy("id", "gene", (F.col("p") - F.col("t")).alias("diagonal"), "n", "size").agg(F.count(F.lit(1)).cast("int").alias("shared"))
    low, high = _overlap(F.col("n"), F.col("size"), F.col("diagonal"))
    return votes.select("id", "gene", "diagonal", "shared", most_identities(high - low + 1, F.col("shared")).alias("bound"))


def best_templates(asked: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, gene, diagonal, score and compared, the number of diagonals compared, of each asked sequence; the diagonals with votes)."""
    genes = fitted(genes)
    voted = settled(diagonals(asked, genes))
    named = asked.select("id", *GROUP, "seq")
    compared = lambda df: df.join(named, "id").join(genes, [*GROUP, "gene"]).select("id", "gene", "diagonal", identities(F.col("seq"), F.col("residues"), F.col("diagonal")).alias("score"))
    order = F.struct(-F.col("score"), "gene", "diagonal")
    top = voted.groupBy("id").agg(F.min_by(F.struct("gene", "diagonal"), F.struct(-F.col("bound"), "gene", "diagonal")).alias("x")).select("id", "x.*")
    first = settled(compared(top))
    open_ = voted.join(first.select("id", F.col("score").alias("least"), F.col("gene").alias("_g"), F.col("diagonal").alias("_d")), "id").filter((F.col("bound") >= F.col("least")) & ~((F.col("gene") == F.col("_g")) & (F.col("diagonal") == F.col("_d"))))
    rest = compared(open_.select("id", "gene", "diagonal"))
    # diagonals without a vote: only where even the longest overlap without a shared word reaches the first score
    longest = F.broadcast(genes.groupBy(*GROUP).agg(F.max(F.length("residues")).alias("longest")))
    bare = named.join(longest, GROUP).join(first.select("id", "score"), "id", "left")
    lost = bare.filter(most_identities(F.least(F.length("seq"), F.col("longest")), F.lit(0)) >= F.coalesce("score", F.lit(0)))
    every = lost.select("id", *GROUP, "seq").join(genes, GROUP).select("id", *GROUP, "seq", "gene", "residues", F.explode(F.sequence(1 - F.length("residues"), F.length("seq") - 1)).alias("diagonal"))
    all_ = first.unionByName(rest).unionByName(every.select("id", "gene", "diagonal", identities(F.col("seq"), F.col("residues"), F.col("diagonal")).alias("score")))
    return all_.groupBy("id").agg(F.min_by(F.struct("gene", "diagonal", "score"), order).alias("b"), F.count(F.lit(1)).alias("compared")).select("id", "b.*", "compared"), voted


def _places(seq: pd.Series, residues: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series([placed(*row) for row in zip(seq, residues, low, high, strict=True)])


def loop_numbers(size: Column) -> Column:
    """IMGT numbers of a loop between 104 and 118 by its length: its middle stays free, or holds the surplus."""
    short = F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i <= F.ceil(size / 2), LAST_V + i).otherwise(FIRST_J - 1 - size + i))
    more = size - LOOP
    long_ = F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i <= 7 + F.floor(more / 2), F.least(F.lit(111), LAST_V + i)).otherwise(F.greatest(F.lit(112), FIRST_J - 1 - size + i)))
    return F.when(size <= 0, F.array().cast("array<int>")).when(size <= LOOP, short).otherwise(long_).cast("array<int>")


def called(receptors: DataFrame, germline: DataFrame, strict: bool = True) -> DataFrame:
    """seq, chain, species, v_gene, v_score, j_gene, places and numbers of each distinct sequence's domain.

    Sequences without a domain or with several raise when they are read; unless strict, they are left out.
    """
    ship(receptors.sparkSession)
    keys = ["seq", *GROUP]
    tasks = 4 * receptors.sparkSession.sparkContext.defaultParallelism  # few bytes, much work: not to be coalesced
    asked = settled(receptors.select(*keys).filter("seq IS NOT NULL").distinct().withColumn("id", F.xxhash64(*keys)).repartition(tasks, "id"))
    v, j = templates(germline, "V"), templates(germline, "J")
    best, voted = best_templates(asked, v)
    sized = best.join(asked, "id", "right").join(F.broadcast(v), [*GROUP, "gene"], "left")
    found = (F.col("score") >= LEAST_IDENTITIES) & (F.col("score") >= LEAST_PART * F.length("residues"))
    one = F.col("best").getField("diagonal")
    far = voted.alias("d").join(best.select("id", F.struct("diagonal", "score").alias("best")), "id").filter((F.abs(F.col("diagonal") - one) >= APART) & (F.col("bound") >= LEAST_IDENTITIES))
    again = far.join(asked, "id").join(F.broadcast(v), [*GROUP, "gene"])
    again = again.withColumn("score", identities(F.col("seq"), F.col("residues"), F.col("diagonal"))).filter(found).select("id").distinct().withColumn("several", F.lit(True))
    near = voted.join(best.select("id", "gene", F.col("diagonal").alias("_d")), ["id", "gene"]).filter((F.col("shared") >= BREAK) & (F.abs(F.col("diagonal") - F.col("_d")) <= BAND))
    span = near.groupBy("id").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    v_part = sized.join(again, "id", "left").join(span, "id", "left")
    none = F.concat(F.lit("no domain found for sequence "), F.col("seq"))
    several = F.concat(F.lit("several domains found for sequence "), F.col("seq"))
    ok = F.coalesce(found, F.lit(False))
    if strict:
        v_part = v_part.filter(F.when(~ok, F.raise_error(none)).when(F.col("several"), F.raise_error(several)).otherwise(F.lit(True)))
    else:
        v_part = v_part.filter(ok & F.col("several").isNull())
    straight = F.transform(F.sequence(F.lit(1), F.length("residues")), lambda t: t + F.col("diagonal"))
    bent = F.transform(F.pandas_udf(_places, "array<int>")("seq", "residues", F.col("low") - 2, F.col("high") + 2), lambda p: p + 1)
    v_part = settled(v_part.withColumn("broken", F.coalesce(F.col("low") < F.col("high"), F.lit(False))))
    whole = v_part.filter("NOT broken").withColumn("at", straight).unionByName(v_part.filter("broken").withColumn("at", bent))
    cysteine = F.element_at("at", -1)
    end = F.when((F.element_at("numbers", -1) == LAST_V) & (cysteine > 0) & (cysteine <= F.length("seq")), cysteine)
    whole = settled(whole.select("id", *keys, F.col("gene").alias("v_gene"), F.col("score").alias("v_score"), "at", "numbers", "broken", end.alias("end")).filter("end IS NOT NULL"))

    tails = whole.select("id", *GROUP, F.expr("substring(seq, end + 1)").alias("seq")).filter("seq <> ''")
    j_best, _ = best_templates(tails, j)
    j_best = j_best.filter("score >= 4").join(tails.select("id", *GROUP), "id").join(F.broadcast(j.select(*GROUP, "gene", F.col("residues").alias("j_residues"), F.col("numbers").alias("j_numbers"))), [*GROUP, "gene"])
    both = whole.join(j_best.select("id", F.col("gene").alias("j_gene"), F.col("diagonal").alias("j_diagonal"), "j_residues", "j_numbers"), "id", "left")

    pairs = F.arrays_zip("at", "numbers")
    number_at = lambda p: F.array_max(F.transform(F.filter(pairs, lambda x: (x["at"] > 0) & (x["at"] <= p)), lambda x: x["numbers"]))
    first = F.array_min(F.filter("at", lambda p: p > 0))
    direct = F.filter(F.transform(pairs, lambda x: F.struct(x["at"].alias("pos"), x["numbers"].alias("num"))), lambda x: x["pos"] > 0)
    filled = F.transform(F.sequence(first, F.col("end")), lambda p: F.struct(p.alias("pos"), number_at(p).alias("num")))
    start_j = F.col("end") + F.col("j_diagonal")
    inside = lambda x: (x["pos"] > F.col("end")) & (x["pos"] <= F.length("seq"))
    j_part = F.filter(F.transform(F.sequence(F.lit(1), F.length("j_residues")), lambda t: F.struct((t + start_j).cast("int").alias("pos"), F.element_at("j_numbers", t).alias("num"))), inside)
    j_begin = F.get(j_part, F.lit(0)).getField("pos")
    has_j = F.col("j_gene").isNotNull() & (F.get(j_part, F.lit(0)).getField("num") == FIRST_J)
    loop = F.transform(loop_numbers(j_begin - F.col("end") - 1), lambda n, i: F.struct((F.col("end") + 1 + i).cast("int").alias("pos"), n.alias("num")))
    empty = F.filter(direct, lambda x: F.lit(False))
    rows = F.concat(F.when(F.col("broken"), filled).otherwise(direct), F.when(has_j, F.concat(loop, j_part)).otherwise(empty))
    return both.select(*keys, "v_gene", "v_score", F.when(has_j, F.col("j_gene")).alias("j_gene"), rows.alias("rows"))


def numbered(receptors: DataFrame, germline: DataFrame, strict: bool = True) -> DataFrame:
    """seq, chain, species, pos (from 0) and imgt_num of each residue of the domains: the table that with_cdrs reads."""
    rows = called(receptors, germline, strict).select("seq", "chain", "species", F.inline("rows"))
    return rows.select("seq", "chain", "species", (F.col("pos") - 1).alias("pos"), F.col("num").alias("imgt_num"))


def genes(receptors: DataFrame, germline: DataFrame, strict: bool = True) -> DataFrame:
    """seq, chain, species, v_gene, v_score (identical residues) and j_gene of each distinct sequence."""
    return called(receptors, germline, strict).select("seq", "chain", "species", "v_gene", "v_score", "j_gene")
