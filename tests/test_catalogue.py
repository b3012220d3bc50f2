"""Every query of the catalogue against its SQL in DuckDB on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry
from quarrylake.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return None
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, spark, small, duck):
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLE_SQL) == {"markdown_chunks", "claim_contradictions", "components", "communities", "vector_index_topk"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
