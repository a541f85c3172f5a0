"""From raw documents to token ids: five stages over the documents table, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paratope.llm import langid, line_dedup, mixing, near_dedup, piece_codec
from paratope.llm.common import finished, table, written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that the network can tell, go."""
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters that three documents share stay in the last of them; n_chars follows."""
    cut = line_dedup.dedup_lines(docs, counts=False)
    length = F.char_length("text").cast(dict(docs.dtypes).get("n_chars", "bigint"))
    return cut.withColumn("n_chars", length) if "n_chars" in docs.columns else cut


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; five-word sets of a similarity of 0.8 or more link two."""
    return near_dedup.drop_near_duplicates(docs, near_dedup.STAGE_LEVEL)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of what they decode to."""
    return piece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language identification", identify_languages),
    ("line dedup", dedup_lines),
    ("near dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("piece encoding", encode_pieces),
]

#: A trained network decides in the first stage: SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table is deleted when the next one's is written."""
    docs, mark = table(spark, sf_dir, "documents"), written()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = finished(docs, f"pipeline-{i}", mark)
    return docs
