"""Every registered graph query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from loomgraph import dataset_queries, mechanism_queries, queries, scored_queries, walk_queries  # noqa: F401

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda x: round(float(x), 6) if isinstance(x, float) else int(x) if isinstance(x, bool) else x
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)
