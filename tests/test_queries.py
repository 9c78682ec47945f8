"""Every registered query next to its SQL in DuckDB, over the whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gaugeflow import catalog

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
MAY_BE_EMPTY = {"log_unfinished_files", "seed_coverage", "classes_lost_to_quarantine", "shared_channel_samples"}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def test_names_and_oracles():
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark, sf_dir):
    df = entry.entry(spark)
    assert df.columns == ["class", "split", "channel", "windows", "mean", "spread"]
    assert {r.channel for r in df.collect()} == {"value", "level"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    cur = con.execute(ORACLES[name])
    cols, want = [d[0] for d in cur.description], cur.fetchall()
    order = sorted(df.columns)
    assert sorted(cols) == order
    got = sorted(tuple(norm(r[c]) for c in order) for r in rows)
    expect = sorted(tuple(norm(w[cols.index(c)]) for c in order) for w in want)
    assert got == expect
    assert rows or name in MAY_BE_EMPTY
    assert not any(v == "nan" for r in got for v in r)
