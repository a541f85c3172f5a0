import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from paratope.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores="4", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    """A value that compares across engines: floats to ten digits, lists as tuples."""
    if isinstance(value, float):
        return None if value != value else float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)


def same_as_sql(df, relation):
    names = sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    wanted = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=str)
    assert sorted(df.columns) == names
    assert rows_of(df) == wanted
