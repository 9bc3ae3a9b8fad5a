"""Every registered story query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from storyloom.plans import corpus
from storyloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in corpus.DRIVER:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    mine = sorted(str([plain(r[c]) for c in sorted(names)]) for r in rows)
    theirs = sorted(str([plain(v) for _, v in sorted(zip(names, r, strict=True))]) for r in found.fetchall())
    assert mine == theirs
