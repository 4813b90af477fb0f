"""Each query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quire.plans import more, registry, shapes, whole

QUERIES, SQL = registry.queries() | more.queries() | shapes.queries(), registry.oracle_sql() | more.oracle_sql() | shapes.oracle_sql() | whole.oracle_sql()

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    names = sorted(df.columns)
    return sorted(tuple(str(x) for x in r) for r in df[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = db.execute(SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == {"epub_parts"} and not set(SQL) - set(QUERIES)  # arrays; book_texts has them joined
