"""Every query with an oracle equals DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from palimpsest.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(names: list[str], values: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: "" if v is None else round(v, 6) if isinstance(v, float) else str(v)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    ours, oracle = QUERIES[name](spark, DATA), con.execute(ORACLES[name])
    names = [d[0] for d in oracle.description]
    assert sorted(ours.columns) == sorted(names)
    assert rows(ours.columns, ours.collect()) == rows(names, oracle.fetchall())
