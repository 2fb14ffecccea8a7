"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from codetables import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    rel = con.sql(catalog.ORACLE_SQL[name])
    found, names = rel.fetchall(), [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted((tuple(r[i] for i in order) for r in found), key=key)


def test_streams_equal_batches(spark):
    batch = {(r.request_id, r.allowed) for r in catalog.QUERIES["admission_batch"](spark, SF).collect()}
    stream = {(r.request_id, r.allowed) for r in catalog.QUERIES["admission_stream"](spark, SF).collect()}
    assert batch == stream
