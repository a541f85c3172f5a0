"""Loaders of what lies behind a network, to be run before a job: the job itself reads the tables that they fill.

Addresses are fetched on the executors, a few at a time, with retries after growing pauses. A loader takes
the address templates and a `get`, so another store, or a table of answers in tests, can stand in.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paratope.functions import text
from paratope.session import ship

#: Public addresses of structures, entries, their sequences and alleles.
STRUCTURES = ["https://files.rcsb.org/download/{}.pdb", "https://files.rcsb.org/download/{}.cif"]
ENTRY = "https://data.rcsb.org/rest/v1/core/entry/{}"
SEQUENCES = "https://www.rcsb.org/fasta/entry/{}"
ALLELES = "https://www.ebi.ac.uk/cgi-bin/ipd/api/allele"

Get = Callable[[str], bytes | None]


def get_bytes(url: str) -> bytes | None:
    """What an address answers; None where nothing is there."""
    try:
        with urllib.request.urlopen(url, timeout=60) as answer:
            return answer.read()
    except urllib.error.HTTPError as error:
        if error.code in (404, 410):
            return None
        raise


def retried(action: Callable, attempts: int = 10, first: float = 1.0, factor: float = 2.0, errors: tuple = (OSError,), sleep: Callable[[float], None] = time.sleep):
    """action()'s result; after an error it is tried again, `attempts` times in all, with pauses that grow by `factor`."""
    for i in range(attempts):
        try:
            return action()
        except errors:
            if i + 1 == attempts:
                raise
            sleep(first * factor**i)


def fetched(keys: DataFrame, key: str, templates: list[str], get: Get = get_bytes, attempts: int = 5, first: float = 0.2, at_once: int = 50) -> DataFrame:
    """key, url and content of each distinct key: the first of its addresses that answers; nulls where none does. `at_once` keys are one task."""
    ship(keys.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch[key]:
                url = content = None
                for template in templates:
                    content = retried(lambda at=template.format(k): get(at), attempts, first)
                    if content is not None:
                        url = template.format(k)
                        break
                yield pd.DataFrame({key: [k], "url": [url], "content": [content]})

    wanted = keys.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct()
    tasks = max(1, -(-wanted.count() // at_once))
    return wanted.repartition(tasks).mapInPandas(run, f"`{key}` string, url string, content binary")


def structure_contents(ids: DataFrame, get: Get = get_bytes, templates: list[str] = STRUCTURES) -> DataFrame:
    """pdb, suffix and content of each structure, as structures.read_atoms() takes it; one that isn't there raises."""
    rows = fetched(ids, "pdb", templates, get)
    found = F.coalesce("url", F.raise_error(F.concat(F.lit("no structure file for "), "pdb")))
    return rows.select("pdb", F.regexp_extract(found, r"\.(\w+)$", 1).alias("suffix"), "content")


def release_dates(ids: DataFrame, get: Get = get_bytes, template: str = ENTRY) -> DataFrame:
    """pdb and pdb_date, an instant."""
    rows = fetched(ids, "pdb", [template], get)
    day = F.get_json_object(F.decode("content", "UTF-8"), "$.rcsb_accession_info.initial_release_date")
    return rows.select("pdb", text.instant(F.coalesce(day, F.raise_error(F.concat(F.lit("no release date for "), "pdb")))).alias("pdb_date"))


def entry_sequences(ids: DataFrame, get: Get = get_bytes, template: str = SEQUENCES) -> DataFrame:
    """pdb, description and sequence of every record of each entry's FASTA, as chain_sequences() takes them."""
    rows = fetched(ids, "pdb", [template], get)
    records = F.filter(F.split(F.concat(F.lit("\n"), F.replace(F.decode("content", "UTF-8"), F.lit("\r"), F.lit(""))), "\n>"), lambda r: F.trim(r) != "")
    cut = rows.select("pdb", F.explode(records).alias("r"))
    return cut.select("pdb", F.substring_index("r", "\n", 1).alias("description"), F.replace(F.regexp_replace("r", "^[^\n]*", ""), F.lit("\n"), F.lit("")).alias("sequence"))


_LISTED = "struct<data:array<struct<accession:string,name:string>>>"
_ALLELE = "struct<status:string,sequence:struct<protein:string>>"


def allele_sequences(names: DataFrame, get: Get = get_bytes, address: str = ALLELES) -> DataFrame:
    """name, sequence and accession of each two-field allele: the first public record, in the order of the list, of its name or one that it begins; names that end in N aren't expressed. A name without one raises."""
    query = "?query=or(startsWith(name,'{0}:'),eq(name,'{0}'))"
    listed = fetched(names, "name", [address + query], get).select("name", F.posexplode(F.from_json(F.decode("content", "UTF-8"), _LISTED)["data"]).alias("at", "r")).filter(~F.col("r.name").endswith("N")).select("name", "at", "r.accession")
    records = fetched(listed, "accession", [address + "/{}"], get).select("accession", F.from_json(F.decode("content", "UTF-8"), _ALLELE).alias("a"))
    public = listed.join(records, "accession").filter("a.status = 'Public'")
    first = public.groupBy("name").agg(F.min_by(F.struct(F.col("a.sequence.protein").alias("sequence"), "accession"), "at").alias("f"))
    joined = names.select("name").filter("name IS NOT NULL").distinct().join(first, "name", "left")
    error = F.raise_error(F.concat(F.lit("no public sequence for allele "), "name"))
    return joined.select("name", F.coalesce("f.sequence", error).alias("sequence"), "f.accession")
