"""Registered plans against their SQL twins on the smallest tables (all of them with NIGHTLOOM_ALL=1)."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = """daily_agg percentile_block gap_sessions interval_join nearest_boundary rolling_slope interpolate_limit cusum_reset
ewma cycles mann_whitney_u bh_fdr lag_corr_ci exp_recovery bootstrap_mean_diff transfer_entropy dfa rqa matrix_profile
consensus impact placebo backtest claim_match stream_sessions flagship""".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 4) + 0.0
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("NIGHTLOOM_ALL") else SAMPLE)
def test_twin(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    close = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) < 2e-4)
    assert all(close(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


def test_every_twin_has_a_plan():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
