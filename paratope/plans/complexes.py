"""Registered queries of the structure features.

The driver's tables hold no structures, so suppliers stand in for complexes: residues, confidences, errors
and contacts follow from their keys by whole-number arithmetic, which both engines do alike. Peptides have
8 to 13 residues; the two MHC chains hold two helices that count (with a hole each) and, in class I, one
that doesn't; receptor residues carry numbers of all regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paratope.operators import features
from paratope.plans.catalogue import ORACLES, query, table

MHC_SIZE, TCR_SIZE = 44, 16
_SIZES = [("peptide", None), ("mhc_1", MHC_SIZE), ("mhc_2", MHC_SIZE), ("tcr_1", TCR_SIZE), ("tcr_2", TCR_SIZE)]


def _jobs(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("s_nationkey") % 2 == 1, "II").otherwise("I")
    # few bytes that become many rows: spread by job before they are exploded, in a number of parts that isn't coalesced, nor less than a join's, else it would shuffle the cells of all pairs again
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, sf_dir, "supplier").repartition(parts, "s_name").select("s_suppkey", F.col("s_name").alias("job_name"), kind.alias("mhc_class"), (8 + F.col("s_suppkey") % 6).alias("n"))


def _residues(jobs: DataFrame) -> DataFrame:
    start, spans = F.lit(0), []
    for role, size in _SIZES:
        size = F.col("n") if size is None else F.lit(size)
        spans.append(F.struct(F.lit(role).alias("role"), start.cast("int").alias("start"), size.cast("int").alias("size")))
        start = start + size
    rows = jobs.select("s_suppkey", "job_name", "mhc_class", F.inline(F.array(*spans))).select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("off"))
    low, high = F.col("off").between(0, 15), F.col("off").between(28, 43)
    helix = F.when(F.col("role") == "mhc_1", low | (high & (F.col("mhc_class") == "I"))).when(F.col("role") == "mhc_2", high).otherwise(False) & (F.col("off") != 5) & (F.col("off") != 33)
    return rows.select("s_suppkey", "job_name", "role", (F.col("start") + F.col("off")).alias("resindex"), helix.alias("is_helix"), (F.col("off") * 8 + 1).alias("imgt_num"))


def complexes(spark, sf_dir) -> dict[str, DataFrame]:
    """The tables that features are made of."""
    jobs = _jobs(spark, sf_dir)
    residue = _residues(jobs)
    atoms = residue.select("s_suppkey", "job_name", "role", "resindex", F.explode(F.array(F.lit(1), F.lit(2))).alias("a"))
    plddt = (F.col("s_suppkey").cast("long") * 7919 + F.col("resindex") * 104729 + F.col("a") * 611) % 1000 / 10.0
    i, j = residue.select("s_suppkey", "job_name", F.col("resindex").alias("i")), residue.select("job_name", F.col("resindex").alias("j"))
    pairs = i.join(j.hint("merge"), "job_name")  # exploded: many times the size that it is taken for
    value = lambda k, m, d: ((F.col("s_suppkey").cast("long") * k + F.col("i") * 7907 + F.col("j").cast("long") * 104723) % m / d).alias("value")
    return {
        "jobs": jobs.select("job_name", "mhc_class"),
        "residue": residue.select("job_name", "role", "resindex", "is_helix"),
        "atom": atoms.select("job_name", "role", "resindex", F.concat(F.lit("C"), F.col("a").cast("string")).alias("name"), plddt.alias("plddt")),
        "pae": pairs.select("job_name", "i", "j", value(31, 320, 10.0)),
        "contact": pairs.select("job_name", "i", "j", value(17, 1000, 1000.0)),
        "imgt": residue.filter(F.col("role").isin(*features.TCR)).select("job_name", "role", "resindex", "imgt_num"),
    }


_LET = f"""jobs AS (SELECT s_suppkey AS k, s_name AS job_name, CASE WHEN s_nationkey % 2 = 1 THEN 'II' ELSE 'I' END AS cls, 8 + s_suppkey % 6 AS n FROM supplier),
       spans AS (SELECT k, job_name, cls, n, 'peptide' AS role, 0 AS start, n AS size FROM jobs UNION ALL SELECT k, job_name, cls, n, 'mhc_1', n, {MHC_SIZE} FROM jobs UNION ALL SELECT k, job_name, cls, n, 'mhc_2', n + {MHC_SIZE}, {MHC_SIZE} FROM jobs
         UNION ALL SELECT k, job_name, cls, n, 'tcr_1', n + {2 * MHC_SIZE}, {TCR_SIZE} FROM jobs UNION ALL SELECT k, job_name, cls, n, 'tcr_2', n + {2 * MHC_SIZE + TCR_SIZE}, {TCR_SIZE} FROM jobs),
       res AS (SELECT k, job_name, cls, n, role, (start + off)::INT AS r, off FROM spans, unnest(range(0, size)) AS u(off)),
       used AS (SELECT *, role = 'mhc_1' OR (role = 'mhc_2' AND cls = 'II') AS mhc, role LIKE 'tcr%' AS tcr, role = 'peptide' AS pep,
         (role = 'mhc_1' AND (off <= 15 OR (off BETWEEN 28 AND 43 AND cls = 'I'))) OR (role = 'mhc_2' AND off BETWEEN 28 AND 43) AS helix FROM res),
       atom AS (SELECT k, job_name, cls, n, role, r, off, pep, mhc, helix, (k::BIGINT * 7919 + r * 104729 + a * 611) % 1000 / 10.0::DOUBLE AS plddt FROM used, unnest([1, 2]) AS u(a))"""
_CELLS = "cells AS (SELECT x.k, x.job_name, x.cls, x.n, x.r AS i, y.r AS j, x.mhc AS mi, x.tcr AS ti, x.pep AS pi, y.mhc AS mj, y.tcr AS tj, y.pep AS pj, x.k::BIGINT AS b FROM used x JOIN used y ON x.k = y.k)"


def _windowed(rows: str, out: str, scale: float) -> str:
    """The mean over the peptide, or the geometric mean of windows of nine in long class II peptides; rows(job_name, cls, n, pos, total, m)."""
    return f"""SELECT job_name, CASE WHEN any_value(cls) = 'II' AND any_value(n) > 9 THEN exp(avg(ln(w)) FILTER (pos <= n - 9)) ELSE sum(total) / sum(m) * {scale} END AS {out}
       FROM (SELECT *, sum(total) OVER f / sum(m) OVER f * {scale} AS w FROM ({rows}) WINDOW f AS (PARTITION BY job_name ORDER BY pos ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)) GROUP BY job_name"""


_PAE = "(b * 31 + i * 7907 + j::BIGINT * 104723) % 320 / 10.0::DOUBLE"
_BY_POSITION = lambda at, test: f"SELECT job_name, cls, n, {at} AS pos, sum({_PAE}) AS total, count(*) AS m FROM cells WHERE {test} GROUP BY ALL"


@query(
    "mean_pae",
    f"""WITH {_LET}, {_CELLS}, a AS ({_windowed(_BY_POSITION("i", "pi AND tj"), "mean_p_tcr_pae", 0.01)}), b AS ({_windowed(_BY_POSITION("j", "ti AND pj"), "mean_tcr_p_pae", 0.01)}), c AS ({_windowed(_BY_POSITION("i", "pi AND mj"), "mean_p_mhc_pae", 0.01)}),
       d AS (SELECT job_name, avg({_PAE}) FILTER (mi AND tj) AS mean_mhc_tcr_pae, avg({_PAE}) FILTER (ti AND mj) AS mean_tcr_mhc_pae FROM cells GROUP BY job_name)
       SELECT job_name, round(mean_mhc_tcr_pae, 6) AS mean_mhc_tcr_pae, round(mean_tcr_mhc_pae, 6) AS mean_tcr_mhc_pae, round(mean_p_tcr_pae, 6) AS mean_p_tcr_pae, round(mean_tcr_p_pae, 6) AS mean_tcr_p_pae, round(mean_p_mhc_pae, 6) AS mean_p_mhc_pae
       FROM d JOIN a USING (job_name) JOIN b USING (job_name) JOIN c USING (job_name)""",
)
def mean_pae(spark, sf_dir):
    t = complexes(spark, sf_dir)
    found = features.pair_means(t["pae"], t["residue"], t["jobs"])
    return found.select("job_name", *(F.round(c, 6).alias(c) for c in found.columns if c != "job_name"))


@query(
    "peptide_plddt",
    f"WITH {_LET}, p AS ("
    + _windowed("SELECT job_name, cls, n, off AS pos, sum(1 - plddt / 100) AS total, count(*) AS m FROM atom WHERE pep GROUP BY ALL", "v", 1.0)
    + ") SELECT job_name, round(v, 6) AS peptide_mean_pLDDT FROM p",
)
def peptide_plddt(spark, sf_dir):
    t = complexes(spark, sf_dir)
    return features.peptide_confidence(t["atom"], t["residue"], t["jobs"]).select("job_name", F.round("peptide_mean_pLDDT", 6).alias("peptide_mean_pLDDT"))


_LOOPS = [r for r in features.REGIONS if r[0].startswith("cdr")]


@query(
    "cdr_plddt",
    f"WITH {_LET} SELECT job_name, " + ", ".join(f"round(avg(plddt) FILTER (role = '{c}' AND off * 8 + 1 BETWEEN {a} AND {b}), 6) AS {c}_{r}_mean_pLDDT" for c in features.TCR for r, a, b in _LOOPS) + " FROM atom GROUP BY job_name",
)
def cdr_plddt(spark, sf_dir):
    t = complexes(spark, sf_dir)
    found = features.loop_confidence(t["atom"], t["imgt"])
    return found.select("job_name", *(F.round(c, 6).alias(c) for c in found.columns if c != "job_name"))


@query("helix_plddt", f"WITH {_LET} SELECT job_name, round(avg(plddt), 6) AS mhc_helices_mean_pLDDT FROM atom WHERE mhc AND helix GROUP BY job_name")
def helix_plddt(spark, sf_dir):
    t = complexes(spark, sf_dir)
    return features.helix_confidence(t["atom"], t["residue"], t["jobs"]).select("job_name", F.round("mhc_helices_mean_pLDDT", 6).alias("mhc_helices_mean_pLDDT"))


_BEST = """least AS (SELECT job_name, n, off, min(plddt) AS v FROM atom WHERE pep GROUP BY ALL),
       nine AS (SELECT job_name, n, off, min(v) OVER (PARTITION BY job_name ORDER BY off ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS w FROM least),
       best AS (SELECT job_name, first(off ORDER BY w DESC, off)::INT AS start FROM nine WHERE off <= n - 9 AND w > 0 GROUP BY job_name)"""


@query("best_nine", f"WITH {_LET}, {_BEST} SELECT job_name, start FROM best")
def best_nine(spark, sf_dir):
    t = complexes(spark, sf_dir)
    return features.best_nine(t["atom"], t["residue"])


_REGION_ROW = "CASE " + " ".join(f"WHEN off * 8 + 1 BETWEEN {a} AND {b} THEN {features.MAP_REGIONS.index(r)}" for r, a, b in features.REGIONS if r in features.MAP_REGIONS) + " END + CASE WHEN role = 'tcr_2' THEN 7 ELSE 0 END"


@query(
    "contact_map",
    f"""WITH {_LET}, {_BEST},
       cols AS (SELECT job_name, k, r AS j, CASE WHEN pep THEN CASE WHEN off BETWEEN start AND start + 8 THEN off - start ELSE -1 END WHEN cls = 'II' THEN CASE WHEN role = 'mhc_1' THEN 9 ELSE 10 END WHEN helix THEN CASE WHEN off <= 15 THEN 9 ELSE 10 END END::INT AS col
         FROM used LEFT JOIN best USING (job_name) WHERE pep OR (cls = 'II' AND role IN ('mhc_1', 'mhc_2')) OR (cls = 'I' AND role = 'mhc_1' AND helix)),
       hits AS (SELECT c.job_name, col, {_REGION_ROW} AS region FROM cols c JOIN res t ON c.k = t.k AND t.role LIKE 'tcr%' WHERE (t.k::BIGINT * 17 + t.r * 7907 + j::BIGINT * 104723) % 1000 / 1000.0::DOUBLE > CASE WHEN col >= 9 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END),
       grid AS (SELECT job_name, y, x FROM jobs, unnest(range(0, 14)) AS a(y), unnest(range(0, 11)) AS b(x) WHERE n >= 9),
       filled AS (SELECT g.job_name, string_agg(c::VARCHAR, ',' ORDER BY y, x) AS contact_map FROM (SELECT g.job_name, y, x, count(h.col) AS c FROM grid g LEFT JOIN hits h ON g.job_name = h.job_name AND region = y AND col = x GROUP BY ALL) g GROUP BY g.job_name)
       SELECT j.job_name, count(h.col) FILTER (h.col >= 9) AS tcr_mhc_contacts, count(h.col) FILTER (h.col < 9) AS peptide_tcr_contacts, any_value(contact_map) AS contact_map FROM jobs j LEFT JOIN hits h USING (job_name) LEFT JOIN filled f USING (job_name) GROUP BY j.job_name""",
)
def contact_map(spark, sf_dir):
    """Contacts over the limits, and the map in one line."""
    t = complexes(spark, sf_dir)
    found = features.contacts(t["contact"], t["atom"], t["residue"], t["imgt"], t["jobs"])
    return found.withColumn("contact_map", F.array_join(F.transform(F.flatten("contact_map"), lambda x: x.cast("int").cast("string")), ","))


@query(
    "species_checks",
    """SELECT s_name AS job_name, s_suppkey % 3 <> 0 AND (s_suppkey % 2 = s_nationkey % 2) AS tcr_1_species_correct, s_suppkey % 2 = s_nationkey % 2 AS tcr_2_species_correct FROM supplier""",
)
def species_checks(spark, sf_dir):
    """Species that follow from keys; every third first receptor has no annotation."""
    supplier = table(spark, sf_dir, "supplier")
    name = lambda c: F.when(F.col(c) % 2 == 0, "human").otherwise("mouse")
    jobs = supplier.select(F.col("s_name").alias("job_name"), name("s_nationkey").alias("tcr_1_species"), name("s_nationkey").alias("tcr_2_species"))
    found = supplier.select(F.col("s_name").alias("job_name"), "s_suppkey", name("s_suppkey").alias("species"), F.explode(F.array(F.lit("tcr_1"), F.lit("tcr_2"))).alias("role"))
    return features.species_checks(jobs, found.filter("role = 'tcr_2' OR s_suppkey % 3 <> 0").drop("s_suppkey"))


_SEEDS = """m AS (SELECT vec_id::VARCHAR AS job_name, seed::INT AS seed, (vec_id * 37 + seed * 11) % 17 AS score, embedding, seed AS place FROM embeddings, unnest(range(1, 6)) AS u(seed)),
       v AS (SELECT job_name, seed, score, """ + ", ".join(
    f"({' + '.join(f'embedding[place + {5 * i + j + 1}]::DOUBLE' for i in rows for j in (3, 4))}) / {2 * len(rows)} AS {name}" for name, rows in (("mhc_tcr", (1, 2)), ("p_tcr", (0,)))
) + " FROM m)"


@query(
    "per_seed_features",
    f"WITH {_SEEDS}, b AS (SELECT job_name, seed, arg_max(struct_pack(x := mhc_tcr, y := p_tcr), struct_pack(s := score, t := -seed)) OVER (PARTITION BY job_name ORDER BY seed ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM v) SELECT job_name, "
    + ", ".join(f"round(max(best.{f}) FILTER (seed = {k}), 6) AS {n}_iptm_{k}" for k in range(1, 6) for f, n in (("x", "mhc_tcr"), ("y", "p_tcr")))
    + " FROM b GROUP BY job_name",
)
def per_seed_features(spark, sf_dir):
    """The interface scores of the best-ranked seed among the first one to five; a seed's matrix starts at its own component."""
    seeds = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("job_name"), "vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("seed"))
    cast = F.transform("embedding", lambda x: x.cast("double"))
    matrix = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.slice(cast, i * 5 + F.col("seed") + 1, F.lit(5)))
    summary = seeds.select("job_name", "seed", matrix.alias("chain_pair_iptm"), matrix.alias("chain_pair_pae_min"))
    found = features.per_seed(summary, seeds.select("job_name", "seed", ((F.col("vec_id") * 37 + F.col("seed") * 11) % 17).alias("ranking_score")))
    return found.select("job_name", *(F.round(f"{n}_iptm_{k}", 6).alias(f"{n}_iptm_{k}") for k in range(1, 6) for n in ("mhc_tcr", "p_tcr")))


@query(
    "summary_metrics",
    """SELECT s_name AS job_name, (s_suppkey % 100) / 100.0::DOUBLE AS ptm, (s_suppkey % 90) / 100.0::DOUBLE AS iptm, 0.25::DOUBLE AS fraction_disordered, CASE WHEN s_suppkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_clash,
       s_suppkey / 1000.0::DOUBLE AS ranking_score, 2 AS n_chains, (s_suppkey + 1) / 10.0::DOUBLE AS chain_pair_last, (s_suppkey + 1) / 100.0::DOUBLE AS last_chain_ptm FROM supplier""",
)
def summary_metrics(spark, sf_dir):
    """Scalars and small arrays of summary documents that are spelled from suppliers' keys."""
    k = F.col("s_suppkey")
    grid = F.array(F.array(k / 10.0, k / 10.0), F.array(k / 10.0, (k + 1) / 10.0))
    chains = F.array(k / 100.0, (k + 1) / 100.0)
    scalars = {"ptm": k % 100 / 100.0, "iptm": k % 90 / 100.0, "fraction_disordered": F.lit(0.25), "has_clash": F.when(k % 2 == 0, 1.0).otherwise(0.0), "ranking_score": k / 1000.0}
    document = F.to_json(F.struct(*(v.alias(n) for n, v in scalars.items()), grid.alias("chain_pair_pae_min"), grid.alias("chain_pair_iptm"), chains.alias("chain_ptm"), chains.alias("chain_iptm")))
    found = features.summary_metrics(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("job_name"), document.alias("document")))
    return found.select("job_name", *features.SUMMARY_SCALARS, F.size("chain_iptm").alias("n_chains"), F.get(F.get("chain_pair_iptm", F.lit(1)), F.lit(1)).alias("chain_pair_last"), F.get("chain_ptm", F.lit(1)).alias("last_chain_ptm"))


_EXTRACTED = {"peptide_plddt": "peptide_mean_pLDDT", "helix_plddt": "mhc_helices_mean_pLDDT", "mean_pae": "mean_mhc_tcr_pae", "contact_map": "tcr_mhc_contacts", "cdr_plddt": "tcr_1_cdr_3_mean_pLDDT"}


@query("extract_features", f"SELECT job_name, {', '.join(_EXTRACTED.values())} FROM " + " JOIN ".join(f"({ORACLES[n]}) AS {n}{' USING (job_name)' if i else ''}" for i, n in enumerate(_EXTRACTED)))
def extract_features(spark, sf_dir):
    """All features whose tables are there, one row a job."""
    tables = complexes(spark, sf_dir)
    found = features.extract(tables)
    rounded = [F.col(c) if c == "tcr_mhc_contacts" else F.round(c, 6).alias(c) for c in _EXTRACTED.values()]
    return found.select("job_name", *rounded)
