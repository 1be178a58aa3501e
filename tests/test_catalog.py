"""Every query against its SQL on the smallest tables, where they are there."""

from __future__ import annotations

import decimal
import os
from pathlib import Path

import pytest

import __spark_entry__

DATA = Path(os.environ.get("PLUMBLINE_TESTDATA", "/root/testdata/sf0.001"))
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in DATA.iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path if path.is_file() else path / '*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    df = __spark_entry__.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    answer = sql.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in answer.fetchall())


def test_the_flagship_query(spark):
    assert __spark_entry__.entry(spark).count() > 0
