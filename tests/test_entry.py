"""The driver's contract: every query runs on the smallest tables and agrees with its SQL in a sample of queries."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from kinweave.plans import registry

SF = "/root/testdata/sf0.001"
HAVE = os.path.isdir(SF)


def test_names():
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not HAVE, reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not HAVE, reason="no test tables")
@pytest.mark.parametrize("name", ["p3_found", "p5_found", "op_121_window_share", "op_089_interval_join", "op_163_gated_reach", "op_173_gated_distance", "op_186_pedigree", "op_203_iv", "op_241_stratified"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    rows = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert sorted(names) == cols
    assert sorted(tuple(_key(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(_key(r[c]) for c in cols) for r in rows)
