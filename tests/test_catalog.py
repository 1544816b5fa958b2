"""Every query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
from edgewright.plans import catalog  # noqa: E402


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "None"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    rows = QUERIES[name](spark, DATA)
    assert sorted(rows.columns) == sorted(names)
    got = sorted(tuple(_plain(r[c]) for c in sorted(names)) for r in rows.collect())
    assert got == sorted(tuple(_plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_url_fold_runs_at_the_operators_depth(spark, monkeypatch):
    from edgewright.operators import resolution

    depths, fold = [], resolution.fold
    monkeypatch.setattr(resolution, "fold", lambda values, bindings, depth=resolution.SUBSTITUTIONS: (depths.append(depth), fold(values, bindings, depth))[1])
    QUERIES["url_fold"](spark, DATA)
    assert depths == [resolution.SUBSTITUTIONS]
