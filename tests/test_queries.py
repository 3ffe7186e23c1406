"""Every registered query of the engine against its SQL on DuckDB."""

import math
import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from quern import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (datetime, date, Decimal)):
        return str(v)
    return v


@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck.sql(queries.oracle_sql()[name])
    at = [found.columns.index(c) for c in names]
    assert sorted(found.columns) == names
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert ours == theirs


def test_each_has_both():
    assert queries.queries().keys() == queries.oracle_sql().keys()
