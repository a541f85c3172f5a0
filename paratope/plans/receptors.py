"""Registered queries over raw receptor sequences: germline calls and numbering.

Nations stand for V genes, regions for J genes, suppliers for receptors: leader, the V part with some residues
changed, a loop, the J part and a tail, all spelled from hashes of names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paratope.operators import numbering
from paratope.plans.catalogue import query, table
from paratope.plans.jobs import with_cdrs
from paratope.session import settled

_HEX, _LETTERS = "0123456789abcdef", "ADEFGHIKLMNPQRST"


def _spelled(text):
    return F.translate(text, _HEX, _LETTERS)


def _residues(nation: DataFrame) -> DataFrame:
    return nation.select("n_nationkey", "n_name", F.concat(F.substring(_spelled(F.concat(F.sha2("n_name", 256), F.md5("n_name"))), 1, 95), F.lit("C")).alias("v"))


def _joins(region: DataFrame) -> DataFrame:
    j = _spelled(F.md5("r_name"))
    return region.select("r_regionkey", "r_name", F.concat(F.substring(j, 1, 3), F.lit("F"), F.substring(j, 4, 10)).alias("j"))


def germline(spark, sf_dir: str) -> DataFrame:
    """Gapped templates: V without residues 10, 31 to 34 and 61 to 63, J from 115 to 128."""
    cut = lambda at, n: F.substring("v", at, n)
    v = _residues(table(spark, sf_dir, "nation")).select(F.lit("V").alias("kind"), F.col("n_name").alias("gene"), F.concat(cut(1, 9), F.lit("."), cut(10, 20), F.lit("...."), cut(30, 26), F.lit("..."), cut(56, 41)).alias("gapped"))
    j = _joins(table(spark, sf_dir, "region")).select(F.lit("J").alias("kind"), F.col("r_name").alias("gene"), F.concat(F.lit("." * 114), "j").alias("gapped"))
    return v.unionByName(j).select(F.lit("human").alias("species"), F.lit("alpha").alias("chain"), "kind", "gene", "gapped")


def receptors(spark, sf_dir: str) -> DataFrame:
    """s_suppkey and seq of each supplier, of a human alpha chain; spelled in many tasks, as one file may hold all suppliers."""
    key, own = F.col("s_suppkey"), _spelled(F.sha1("s_name"))
    supplier = table(spark, sf_dir, "supplier").repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey")
    named = supplier.join(F.broadcast(_residues(table(spark, sf_dir, "nation"))), F.col("s_nationkey") == F.col("n_nationkey"))
    named = named.join(F.broadcast(_joins(table(spark, sf_dir, "region"))), key % 5 == F.col("r_regionkey"))
    changed = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(96)), lambda t: F.when(t % (9 + key % 7) == 0, "W").otherwise(F.substring("v", t, F.lit(1)))), "")
    seq = F.concat(F.substring(own, F.lit(1), (key % 5).cast("int")), changed, F.substring(own, F.lit(10), (6 + key % 12).cast("int")), F.substring("j", 4, 11), F.lit("TVSP"))
    return named.select("s_suppkey", seq.alias("seq"), F.lit("alpha").alias("chain"), F.lit("human").alias("species"))


_CALLS = f"""WITH g AS (SELECT n_nationkey, n_name AS gene, substr(translate(sha256(n_name) || md5(n_name), '{_HEX}', '{_LETTERS}'), 1, 95) || 'C' AS res FROM nation),
       j AS (SELECT r_regionkey, r_name AS gene, 'F' || substr(translate(md5(r_name), '{_HEX}', '{_LETTERS}'), 4, 10) AS res FROM region),
       s AS (SELECT s_suppkey, substr(own, 1, s_suppkey % 5) || list_aggregate(list_transform(range(1, 97), lambda t: CASE WHEN t % (9 + s_suppkey % 7) = 0 THEN 'W' ELSE substr(g.res, t, 1) END), 'string_agg', '') || substr(own, 10, 6 + s_suppkey % 12) || j.res || 'TVSP' AS seq
         FROM (SELECT *, translate(sha1(s_name), '{_HEX}', '{_LETTERS}') AS own FROM supplier) JOIN g ON s_nationkey = n_nationkey JOIN j ON r_regionkey = s_suppkey % 5),
       vs AS (SELECT s_suppkey, seq, gene, d, list_sum(list_transform(range(greatest(1, 1 - d), least(96, length(seq) - d) + 1), lambda t: (substr(seq, t + d, 1) = substr(res, t, 1))::INT)) AS m FROM s, g, unnest(range(-95, length(seq))) AS u(d)),
       v AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY m DESC, gene, d) = 1),
       tails AS (SELECT *, substr(seq, d + 97) AS tail FROM v),
       js AS (SELECT s_suppkey, j.gene AS j_gene, e, list_sum(list_transform(range(greatest(1, 1 - e), least(11, length(tail) - e) + 1), lambda t: (substr(tail, t + e, 1) = substr(res, t, 1))::INT)) AS k FROM tails, j, unnest(range(-10, length(tail))) AS u(e)),
       b AS (SELECT * FROM js QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY k DESC, j_gene, e) = 1)"""


@query("germline_calls", _CALLS + " SELECT s_suppkey, gene AS v_gene, m::BIGINT AS v_score, CASE WHEN k >= 4 AND e >= 0 THEN j_gene END AS j_gene FROM tails JOIN b USING (s_suppkey)")
def germline_calls(spark, sf_dir):
    """V and J genes of raw sequences; the statement compares each with all templates on all diagonals."""
    asked = settled(receptors(spark, sf_dir))
    found = numbering.genes(asked, germline(spark, sf_dir))
    return asked.join(found, ["seq", "chain", "species"]).select("s_suppkey", "v_gene", F.col("v_score").cast("long").alias("v_score"), "j_gene")


@query(
    "imgt_regions",
    _CALLS
    + """ SELECT s_suppkey, substr(seq, d + 26, 8) AS tcr_1_cdr_1, substr(seq, d + 51, 7) AS tcr_1_cdr_2, substr(seq, d + 73, 6) AS tcr_1_cdr_2_5, substr(seq, d + 96, e + 2) AS tcr_1_cdr_3, NULL::VARCHAR AS tcr_2_cdr_3
       FROM tails JOIN b USING (s_suppkey)""",
)
def imgt_regions(spark, sf_dir):
    """Loops of raw sequences by their numbers; the second chain is missing."""
    asked = settled(receptors(spark, sf_dir))
    table_ = numbering.numbered(asked, germline(spark, sf_dir))
    none = F.lit(None).cast("string")
    triads = asked.select("s_suppkey", F.col("seq").alias("tcr_1_seq"), F.col("chain").alias("tcr_1_chain"), F.col("species").alias("tcr_1_species"), none.alias("tcr_2_seq"), F.lit("beta").alias("tcr_2_chain"), F.lit("human").alias("tcr_2_species"))
    return with_cdrs(triads, table_).select("s_suppkey", *(f"tcr_1_{r}" for r in ("cdr_1", "cdr_2", "cdr_2_5", "cdr_3")), "tcr_2_cdr_3")
