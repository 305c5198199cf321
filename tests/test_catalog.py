"""Every query of the catalogue against its SQL, on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from orrery import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    out = duck.execute(catalog.SQL[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall())


def test_post_order_is_numbered_by_ranges(spark):
    """Not by a window over all rows, which are in one task then."""
    plan = catalog.QUERIES["tree_post_order"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" not in plan
