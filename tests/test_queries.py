"""Every registered query against its SQL in DuckDB, and the entry module."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from loomline import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return float(f"{v:.9g}") if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(plans.sql()))
def test_query_equals_its_sql(spark, con, name):
    result = con.execute(plans.sql()[name])
    columns = [c[0] for c in result.description]
    want = [dict(zip(columns, r)) for r in result.fetchall()]
    got = plans.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda rows: sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    a, b = key(r.asDict(recursive=True) for r in got.collect()), key(want)
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.sql())))
def test_query_without_sql_runs(spark, name):
    got = plans.queries()[name](spark, FOLDER)
    assert got.columns and got.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.queries()) <= set(__spark_entry__.queries()) and set(plans.sql()) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
