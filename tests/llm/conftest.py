import pytest

from paratope.llm import common

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=False):
    """A documents table of (doc_id, text[, lang[, source]]); extra: with columns whose names clash with the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or "")) for r in rows]
    if not extra:
        return spark.createDataFrame(full, DOCS)
    names = "size long, target double, shard long, taken long, key string, h1 long, n long, id long, path string, keep binary, th long, n_dropped long, kept boolean, lang_pred string, score double, pos int, _text string, bands string"
    return spark.createDataFrame([(*r, *[None] * len(names.split(", "))) for r in full], f"{DOCS}, {names}")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


__all__ = ["DOCS", "common", "documents"]
