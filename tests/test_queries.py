"""Every query of the library against its SQL oracle on the smallest tables."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from loomline import catalog

FOLDER = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.8g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sql, name):
    frame = __spark_entry__.queries()[name](spark, FOLDER)
    answer = sql.execute(catalog.ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(frame.columns)
    got = sorted([_plain(v) for v in r] for r in frame.select(*columns).collect())
    assert got == sorted([_plain(v) for v in r] for r in answer.fetchall())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
