"""Canonical columns, keys and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

#: The canonical column order of triads and the groups of columns that are keys.
MHC_COLUMNS = ["mhc_class", "mhc_1_chain", "mhc_1_species", "mhc_1_name", "mhc_1_seq", "mhc_2_chain", "mhc_2_species", "mhc_2_name", "mhc_2_seq"]
ANTIGEN_COLUMNS = ["peptide", *MHC_COLUMNS]
TCR_COLUMNS = ["tcr_1_chain", "tcr_1_species", "tcr_1_seq", "tcr_2_chain", "tcr_2_species", "tcr_2_seq"]
TRIAD_COLUMNS = ["job_name", "cognate", *ANTIGEN_COLUMNS, *TCR_COLUMNS]
CDR_REGIONS = ["cdr_1", "cdr_2", "cdr_2_5", "cdr_3"]
CDR_COLUMNS = [f"tcr_{chain}_{region}" for chain in (1, 2) for region in CDR_REGIONS]
TCR_KEY = TCR_COLUMNS + CDR_COLUMNS

SOURCE_COLUMNS = [f"source_{c}" for c in ANTIGEN_COLUMNS]
TO_SOURCE = dict(zip(ANTIGEN_COLUMNS, SOURCE_COLUMNS, strict=True))
FROM_SOURCE = dict(zip(SOURCE_COLUMNS, ANTIGEN_COLUMNS, strict=True))

#: Sequences whose joined text is hashed into a triad's and an antigen's job name.
TRIAD_HASHED = ["peptide", "mhc_1_seq", "mhc_2_seq", "tcr_1_seq", "tcr_2_seq"]
ANTIGEN_HASHED = ["peptide", "mhc_1_seq", "mhc_2_seq"]

DOCKING_COLUMNS = ["d", "torsion", "tcr_unit_y", "tcr_unit_z", "mhc_unit_y", "mhc_unit_z"]


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


TRIAD = T.StructType([T.StructField(c, T.BooleanType() if c == "cognate" else T.StringType()) for c in TRIAD_COLUMNS])
TRIAD_WITH_CDR = T.StructType(TRIAD.fields + _strings(*CDR_COLUMNS))
PMHC = T.StructType(_strings("job_name", *ANTIGEN_COLUMNS))
IEDB_CSV = T.StructType(_strings("Peptide", "TCRa", "TCRb", "HLA", "references", "receptor_id"))
STCR_TSV = T.StructType(
    _strings("pdb", "mhc_type", "antigen_type", "antigen_chain", "mhc_chain1", "mhc_chain2", "Achain", "Bchain", "Gchain", "Dchain")
    + _strings("mhc_chain1_organism", "mhc_chain2_organism", "alpha_organism", "beta_organism")
)
DOCKING_TSV = T.StructType([T.StructField(c, T.DoubleType()) for c in DOCKING_COLUMNS])
ALLELE_STATUS_CSV = T.StructType(_strings("Allele", "Partial"))
FASTA = T.StructType(_strings("description", "sequence"))
REGISTRY = T.StructType([*_strings("kind", "msa_id", "msa_path"), T.StructField("is_empty", T.BooleanType()), T.StructField("date", T.IntegerType())])
