"""Every query runs on the smallest tables; a few agree with DuckDB in full (the driver compares all of them)."""

import glob
import os

import duckdb
import pytest

from weir.queries import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p).split('.')[0]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_rows_agree(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.SQL:
        assert got.columns and got.count() >= 0
        return
    rel = duck.execute(catalog.SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(got.columns)
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(text(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall())
    assert sorted(tuple(text(r[c]) for c in sorted(names)) for r in got.collect()) == want


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
