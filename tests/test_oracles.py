"""Every query of the library against its SQL twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from emberline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = catalog.oracles()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v if isinstance(v, str | bool) else float(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([repr(plain(r[i])) for i in order] for r in values))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, sql, name):
    got = catalog.queries()[name](spark, sf)
    own = got.collect()
    cursor = sql.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert own and rows(got.columns, own) == rows(columns, cursor.fetchall())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 469
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists(os.path.join(os.path.dirname(__spark_entry__.__file__), "bench.py"))


@pytest.mark.parametrize("name", ["stratified_sample", "quota_shares", "hull_area"])
def test_queries_without_a_twin_give_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
