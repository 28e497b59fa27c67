"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from docquarry.catalog import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, engine, name):
    df = all_queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = ordered([tuple(r[c] for c in columns) for r in df.collect()])
    if name not in all_sql():
        assert got
        return
    result = engine.execute(all_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == ordered([tuple(r[i] for i in at) for r in result.fetchall()])
