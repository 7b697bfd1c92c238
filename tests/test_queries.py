"""Every registered query that has an SQL twin gives its rows, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.plans import queries as plans

PATH = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES.split():
        if os.path.exists(f"{PATH}/{name}.parquet"):
            con.sql(f"create view {name} as select * from read_parquet('{PATH}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v + 0.0:.7g}"
    return str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_twin(spark, db, name):
    got, want = plans.QUERIES[name](spark, PATH), db.sql(plans.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    floats = [tuple(plain(float(v) if type(v).__name__ == "Decimal" else v) for v in r) for r in want.select(quoted).fetchall()]
    assert rows == sorted(floats)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
