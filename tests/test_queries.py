"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from canopy.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in sorted(v.items())})
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(plain(r[c]) for c in want.columns) for r in got.collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_repartitioning_changes_nothing(spark):
    from canopy.operators.similarity import similar_pairs
    from canopy.plans.registry import Tables
    from canopy.plans.vectors import vectors

    v = vectors(Tables(spark, SF))
    rows = lambda df: sorted((r["a"], r["b"], round(r["cosine"], 6)) for r in similar_pairs(df, 0.4).collect())
    assert rows(v) == rows(v.repartition(7))
