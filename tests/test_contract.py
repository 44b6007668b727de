"""Every registered query against its SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, normal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_keys_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", list(entry.queries()))
def test_query(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    got, cols = [tuple(r) for r in df.collect()], df.columns
    if key not in entry.oracle_sql():
        assert len(got) > 0
        return
    rel = duck.execute(entry.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    assert sorted(cols) == sorted(names)
    pick = lambda header, rs: sorted(
        (tuple(normal(r[header.index(c)]) for c in sorted(cols)) for r in rs),
        key=lambda r: tuple((x is not None, str(type(x)), x) for x in r),
    )
    assert pick(cols, got) == pick(names, want)
