"""The whole jobs: raw tables to triads, negatives, feature tables, evaluation sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paratope.functions import hla, text
from paratope.functions.keys import with_job_name
from paratope.operators.features import region_sequences
from paratope.operators.negatives import drawn_negatives
from paratope.operators.relational import corrected, demand, fold_join, list_of, only_one
from paratope.schema import ANTIGEN_COLUMNS, ANTIGEN_HASHED, CDR_COLUMNS, CDR_REGIONS, TRIAD_COLUMNS, TRIAD_HASHED
from paratope.session import settled

IEDB_NAMES = {"Peptide": "peptide", "TCRa": "tcr_1_seq", "TCRb": "tcr_2_seq", "HLA": "mhc_1_name"}
LISTS = ["references", "receptor_id"]
#: Species as the structure summary writes them.
SPECIES = {"homo sapiens": "human", "mus musculus": "mouse"}


def with_cdrs(triads: DataFrame, numbering: DataFrame) -> DataFrame:
    """Adds the CDR columns of both receptors from a table imgt_numbering(seq, chain, species, pos, imgt_num); the external annotator fills it. Each distinct sequence is assembled once."""
    aa = F.substring("seq", F.col("pos") + 1, F.lit(1))
    loops = region_sequences(numbering.withColumn("aa", aa), ["seq", "chain", "species"]).select("seq", "chain", "species", *CDR_REGIONS)
    for n in (1, 2):
        side = loops.select(F.col("seq").alias(f"tcr_{n}_seq"), F.col("chain").alias(f"tcr_{n}_chain"), F.col("species").alias(f"tcr_{n}_species"), *(F.col(r).alias(f"tcr_{n}_{r}") for r in CDR_REGIONS))
        triads = triads.join(side, [f"tcr_{n}_seq", f"tcr_{n}_chain", f"tcr_{n}_species"], "left")
    return triads


def _iedb(raw: DataFrame, constants: dict[str, str]) -> DataFrame:
    """Common columns of a binding export: renamed, constant ones added, rows without either receptor left out before any lookup."""
    listed = {"receptor_id": text.parts(F.col("receptor_id"), ","), "references": text.last_parts(text.parts(F.col("references"), ","))}
    named = raw.withColumnsRenamed(IEDB_NAMES).filter("tcr_1_seq IS NOT NULL AND tcr_2_seq IS NOT NULL")
    fixed = {"tcr_1_chain": "alpha", "tcr_2_chain": "beta", **{f"{c}_species": "human" for c in ("tcr_1", "tcr_2", "mhc_1", "mhc_2")}, **constants}
    return named.withColumns({**{k: F.lit(v) for k, v in fixed.items()}, "cognate": F.lit(True), **listed})


def _triads(df: DataFrame, numbering: DataFrame) -> tuple[DataFrame, DataFrame]:
    keyed = with_cdrs(with_job_name(df, TRIAD_HASHED), numbering)
    triads = keyed.groupBy(*TRIAD_COLUMNS, *CDR_COLUMNS).agg(*(list_of(c).alias(c) for c in LISTS))
    return triads, antigen_table(triads)


def antigen_table(triads: DataFrame) -> DataFrame:
    """Distinct antigens with a job name of their own."""
    return with_job_name(triads.select(*ANTIGEN_COLUMNS).distinct(), ANTIGEN_HASHED).select("job_name", *ANTIGEN_COLUMNS)


def clean_class_one(raw: DataFrame, alleles: DataFrame, numbering: DataFrame, light_sequence: str) -> tuple[DataFrame, DataFrame]:
    """(triads, antigens) of class I binding records; alleles(name, sequence)."""
    df = _iedb(raw, {"mhc_1_chain": "heavy", "mhc_2_chain": "light", "mhc_2_name": hla.LIGHT, "mhc_2_seq": light_sequence, "mhc_class": "I"})
    df = df.withColumn("mhc_1_name", text.after(F.col("mhc_1_name"), "HLA-"))
    return _triads(hla.with_sequence(df, alleles, "mhc_1_name", "mhc_1_seq"), numbering)


def clean_class_two(raw: DataFrame, alleles: DataFrame, numbering: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triads, antigens) of class II binding records; chains that can't be told go."""
    df = _iedb(raw, {"mhc_1_chain": "alpha", "mhc_2_chain": "beta", "mhc_class": "II"})
    names = text.parts(F.col("mhc_1_name"), "/")
    two = F.size(names) == 2
    first = F.substring(F.get(names, F.lit(0)), 5, 1000)
    chains = hla.infer_chains(F.when(two, first), F.when(two, F.get(names, F.lit(1))).otherwise(first))
    df = df.withColumn("_c", chains).drop("mhc_1_name").select("*", "_c.*").drop("_c").filter("mhc_1_name IS NOT NULL AND mhc_2_name IS NOT NULL")
    df = hla.with_sequence(hla.with_sequence(df, alleles, "mhc_1_name", "mhc_1_seq"), alleles, "mhc_2_name", "mhc_2_seq")
    return _triads(df, numbering)


def clean_canonical(raw: DataFrame, numbering: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triads, antigens) of records that are canonical already."""
    keyed = with_cdrs(with_job_name(raw.drop("job_name"), TRIAD_HASHED), numbering)
    triads = keyed.select(*TRIAD_COLUMNS, *CDR_COLUMNS)
    return triads, antigen_table(triads)


def summary_of_structures(raw: DataFrame) -> DataFrame:
    """One row a structure of a structure summary: class, segment ids by role, species; ambiguous classes or species raise."""
    kind = F.when(F.col("mhc_type").isin("GA", "GB"), "MH2").otherwise(F.col("mhc_type"))
    antigen = F.coalesce("antigen_type", F.lit("peptide"))
    at = text.index_of(text.stripped(text.parts(antigen, "|")), "peptide")
    df = raw.withColumn("_at", F.monotonically_increasing_id()).filter(F.contains(antigen, F.lit("peptide")))
    df = df.withColumns({"mhc_type": kind, "peptide_segid": text.item(text.stripped(text.parts(F.col("antigen_chain"), "|")), at)})
    ids = {"mhc_chain1": "mhc_1_segid", "mhc_chain2": "mhc_2_segid", "peptide_segid": "peptide_segid", "Achain": "tcr_1_segid", "Bchain": "tcr_2_segid"}
    kinds = {"mhc_chain1_organism": "mhc_1_species", "mhc_chain2_organism": "mhc_2_species", "alpha_organism": "tcr_1_species", "beta_organism": "tcr_2_species"}
    firsts = df.groupBy("pdb").agg(F.min_by(F.struct(*(F.col(k).alias(v) for k, v in ids.items())), "_at").alias("_s")).select("pdb", "_s.*")
    single = only_one(df, ["pdb"], ["mhc_type", *kinds]).withColumnsRenamed(kinds)
    named = {c: reduce(lambda acc, kv: acc.when(F.col(c) == kv[0], kv[1]), list(SPECIES.items())[1:], F.when(F.col(c) == next(iter(SPECIES)), SPECIES[next(iter(SPECIES))])) for c in kinds.values()}  # noqa: B023
    out = firsts.join(single, "pdb").withColumns(named)
    out = out.withColumn("mhc_class", F.when(F.col("mhc_type") == "MH1", "I").when(F.col("mhc_type") == "MH2", "II")).drop("mhc_type")
    two = F.col("mhc_class") == "II"
    return out.withColumns({"mhc_1_chain": F.when(two, "alpha").otherwise("heavy"), "mhc_2_chain": F.when(two, "beta").otherwise("light"), "tcr_1_chain": F.lit("alpha"), "tcr_2_chain": F.lit("beta"), "cognate": F.lit(True)})


def benchmark_names(raw: DataFrame) -> DataFrame:
    return raw.withColumnRenamed("pdbid", "pdb").withColumn("mhc_class", F.when(F.col("mhc_class") == 1, "I").otherwise("II"))


ROLES = {"peptide_segid": "peptide", "mhc_1_segid": "mhc_1_seq", "mhc_2_segid": "mhc_2_seq", "tcr_1_segid": "tcr_1_seq", "tcr_2_segid": "tcr_2_seq"}


def chain_sequences(fasta: DataFrame) -> DataFrame:
    """(pdb, chain, seq) from FASTA records (pdb, description, sequence)."""
    return fasta.select("pdb", F.explode(text.chain_ids(F.col("description"))).alias("chain"), F.col("sequence").alias("seq"))


def with_chain_sequences(df: DataFrame, chains: DataFrame) -> DataFrame:
    """Adds the five sequences by segment id; one shuffle of the chain table, empty texts are null."""
    by_pdb = chains.groupBy("pdb").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("chain", "seq")))).alias("_m"))
    joined = df.join(by_pdb, "pdb", "left")
    return joined.withColumns({seq: text.blank_to_null(F.try_element_at("_m", F.col(seg))) for seg, seq in ROLES.items()}).drop("_m")


def without_peptide(df: DataFrame) -> DataFrame:
    """Chains cut behind the peptide where they hold it."""
    chains = ["mhc_1_seq", "mhc_2_seq", "tcr_1_seq", "tcr_2_seq"]
    return df.withColumns({c: text.drop_through(F.col(c), F.col("peptide")) for c in chains})


def clean_structures(summary: DataFrame, dates: DataFrame, fasta: DataFrame, numbering: DataFrame, names: DataFrame, quality: DataFrame, before: dict, after: dict) -> tuple[DataFrame, DataFrame]:
    """(triads, antigens) of solved structures. dates(pdb, pdb_date); names(pdb, mhc_1_name, mhc_2_name) from allele matching; quality(pdb, replication, ...) by structure; before and after are correction tables around the sequence lookup. Job names are those of the sequences before the peptide is cut off."""
    df = corrected(summary_of_structures(summary), "pdb", before).join(dates, "pdb", "left")
    df = corrected(with_chain_sequences(df, chain_sequences(fasta)), "pdb", after)
    df = df.withColumns({f"tcr_{n}_species": F.coalesce(f"tcr_{n}_species", "mhc_1_species") for n in (1, 2)})
    df = df.join(names, "pdb", "left").join(quality, "pdb", "left")
    triads = without_peptide(with_cdrs(with_job_name(df, TRIAD_HASHED), numbering))
    return triads, antigen_table(triads)


def generate_negatives(base: DataFrame, donors: list[DataFrame], depth: int, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """(base and its negatives, antigens still in need). Each donor table is asked for what the ones before it left open, for those antigens only; a job that was drawn before isn't drawn again."""
    left, drawn = settled(demand(base, depth)), []
    for donor in donors:
        open_ = base.join(left.select(*ANTIGEN_COLUMNS), ANTIGEN_COLUMNS, "left_semi")
        earlier = reduce(lambda a, b: a.unionByName(b), drawn) if drawn else None
        more, left = map(settled, drawn_negatives(left, open_, donor, earlier, seed=seed))
        drawn.append(more)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), drawn, base), left


def recombine(base: DataFrame, features: list[DataFrame]) -> DataFrame:
    return fold_join(base, features)


def inference_inputs(triads: DataFrame, seeds: list[int]) -> DataFrame:
    """job_name and the job's JSON: chains without alignments, a null second MHC chain left out."""
    from paratope.sources.jobs import job_document

    chains = F.filter(F.array("peptide", "mhc_1_seq", "mhc_2_seq", "tcr_1_seq", "tcr_2_seq"), lambda s: s.isNotNull())
    return triads.select("job_name", job_document(F.col("job_name"), chains, F.array(*map(F.lit, seeds))).alias("document"))


#: The kind of alignment that each chain of a triad has.
ALIGNED = {"peptide": "peptide", "mhc_1_seq": "mhc", "mhc_2_seq": "mhc", "tcr_1_seq": "tcr", "tcr_2_seq": "tcr"}


def composed_inputs(triads: DataFrame, alignments: DataFrame, seeds: list[int]) -> DataFrame:
    """job_name and the job's JSON with stored alignments (kind, sequence, document): each chain has its alignment's protein under its own letter; a chain without exactly one alignment raises."""
    from paratope.sources.jobs import exactly_one, job_of_chains, protein_of

    entries = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(k).alias("kind"), F.col(c).alias("sequence")) for i, (c, k) in enumerate(ALIGNED.items())))
    chains = triads.select("job_name", F.inline(F.filter(entries, lambda e: e["sequence"].isNotNull())))
    stored = exactly_one(alignments.select("kind", "sequence", "document"), ["kind", "sequence"], chains)
    named = chains.join(stored.select("kind", "sequence", protein_of(F.col("document")).alias("protein")), ["kind", "sequence"])
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "protein"))), lambda x: x["protein"])
    return named.groupBy("job_name").agg(ordered.alias("chains")).select("job_name", job_of_chains(F.col("job_name"), F.col("chains"), F.array(*map(F.lit, seeds))).alias("document"))


def alignment_jobs(triads: DataFrame) -> DataFrame:
    """(kind, sequence) of every distinct chain that needs an alignment."""
    kinds = {"peptide": ["peptide"], "mhc": ["mhc_1_seq", "mhc_2_seq"], "tcr": ["tcr_1_seq", "tcr_2_seq"]}
    pairs: list[Column] = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("sequence")) for k, cs in kinds.items() for c in cs]
    return triads.select(F.inline(F.array(*pairs))).filter("sequence IS NOT NULL").distinct()
