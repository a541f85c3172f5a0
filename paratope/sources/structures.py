"""Structure files: choice of format, chain layout and writing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paratope.session import ship

#: Chains of a prediction and their letters in a docking input, by class.
DOCKING_CHAINS = {
    "II": [("B", "A"), ("C", "B"), ("A", "C"), ("D", "D"), ("E", "E")],
    "I": [("B", "A"), ("A", "B"), ("D", "C"), ("E", "D")],
}


def structure_files(spark: SparkSession, glob: str) -> DataFrame:
    """pdb, path and content, `.pdb` preferred over `.cif`."""
    raw = spark.read.format("binaryFile").load(glob)
    name = F.regexp_extract("path", r"([^/]+)\.(pdb|cif)$", 1)
    suffix = F.regexp_extract("path", r"\.(pdb|cif)$", 1)
    best = Window.partitionBy("pdb").orderBy(F.when(F.col("suffix") == "pdb", 0).otherwise(1), "path")
    return raw.select(name.alias("pdb"), suffix.alias("suffix"), "path", "content").filter("pdb <> ''").withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")


_TOKEN = re.compile(r"'((?:[^']|'(?=\S))*)'|\"((?:[^\"]|\"(?=\S))*)\"|(\S+)")
#: What a row of an atom table is made of, by the names that mmCIF files give it; the first one present counts.
_CIF_COLUMNS = [("auth_asym_id", "label_asym_id"), ("auth_seq_id", "label_seq_id"), ("label_atom_id", "auth_atom_id"), ("label_comp_id", "auth_comp_id"), ("Cartn_x",), ("Cartn_y",), ("Cartn_z",), ("B_iso_or_equiv",)]


def _pdb_rows(lines: list[str]) -> Iterator[tuple]:
    """(chain, residue, atom, residue name, x, y, z, confidence) of a .pdb file's first model."""
    for line in lines:
        if line.startswith(("ATOM  ", "HETATM")):
            yield line[21].strip(), (line[21], line[22:27]), line[12:16].strip(), line[17:20].strip(), *(float(line[i : i + 8]) for i in (30, 38, 46)), float(line[60:66] or 0)
        elif line.startswith("ENDMDL"):
            return


def _cif_rows(lines: list[str]) -> Iterator[tuple]:
    """The same of an mmCIF file's atom_site loop; other models than the first go."""
    names: list[str] = []
    for line in lines:
        if line.startswith("_atom_site."):
            names.append(line.split(".", 1)[1].split()[0])
        elif names and line.startswith(("ATOM", "HETATM")):
            row = dict(zip(names, (next(v for v in m.groups() if v is not None) for m in _TOKEN.finditer(line)), strict=False))
            if row.get("pdbx_PDB_model_num", "1") != "1":
                continue
            chain, number, atom, residue, x, y, z, conf = (next((row[c] for c in some if row.get(c, ".") not in ".?"), "0") for some in _CIF_COLUMNS)
            yield chain, (chain, number, row.get("pdbx_PDB_ins_code")), atom, residue, float(x), float(y), float(z), float(conf)
        elif names and line.startswith(("#", "loop_", "data_")):
            return


def _atoms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["job_name", "segid", "resindex", "name", "resname", "x", "y", "z", "plddt"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
    for b in batches:
        for pdb, content in zip(b.column("pdb").to_pylist(), b.column("content").to_pylist(), strict=True):
            out, resindex, last = [], -1, None
            lines = (content or b"").decode("ascii", "replace").splitlines()
            for segid, residue, *rest in (_cif_rows if lines and lines[0].startswith("data_") else _pdb_rows)(lines):
                resindex += residue != last
                last = residue
                out.append((pdb, segid, resindex, *rest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_atoms(files: DataFrame) -> DataFrame:
    """The atom table of `.pdb` and mmCIF contents (pdb, content), a file at a time."""
    ship(files.sparkSession)
    return files.select("pdb", "content").mapInArrow(_atoms, "job_name string, segid string, resindex int, name string, resname string, x double, y double, z double, plddt double")


def docking_layout(atoms: DataFrame, classes: DataFrame) -> DataFrame:
    """Atoms with chains in docking order: chain (new letter), position (order of the chains); chains left out of the layout go."""
    rows = [(c, old, new, i) for c, pairs in DOCKING_CHAINS.items() for i, (old, new) in enumerate(pairs)]
    layout = atoms.sparkSession.createDataFrame(rows, "mhc_class string, segid string, chain string, position int")
    return atoms.join(classes.select("job_name", "mhc_class"), "job_name").join(F.broadcast(layout), ["mhc_class", "segid"])


def pdb_line(serial: Column) -> Column:
    """One ATOM record of the atom table's columns, in the fixed-width format."""
    return F.format_string("ATOM  %5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f  1.00%6.2f", serial, F.lpad("name", 4, " "), "resname", "chain", F.col("resindex") % 10000, "x", "y", "z", "plddt")


def pdb_text(laid_out: DataFrame) -> DataFrame:
    """job_name and the text of its structure file."""
    order = F.row_number().over(Window.partitionBy("job_name").orderBy("position", "resindex", "name"))
    lines = laid_out.withColumn("serial", order).select("job_name", "serial", pdb_line(F.col("serial")).alias("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("serial", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("job_name").agg(F.concat(joined, F.lit("\nEND\n")).alias("text"))
