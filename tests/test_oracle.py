"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from ledgerloom import catalogue

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark", "embeddings")


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else int(value) if value == int(value) else round(value, 6)
    return str(value) if isinstance(value, (datetime.date, datetime.datetime)) else value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{small}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def test_every_query_is_listed():
    assert set(catalogue.oracle_sql()) == set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, small, duck, name):
    df = catalogue.queries()[name](spark, small)
    columns = sorted(df.columns)
    ours = ordered([tuple(plain(x) for x in r) for r in df.select(columns).collect()])
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    theirs = ordered([tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()])
    assert ours == theirs
