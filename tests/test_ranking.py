"""Ranks, gaps and windows of hot groups must equal a brute-force answer however they are split."""

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import cleaning
from gaugeflow.operators.ranking import average_rank, hash_ranked, sequence_positions
from gaugeflow.operators.windows import sliding_windows


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and many of its rows share one instant."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        g = 0 if i % 3 else int(rng.integers(1, 20))
        t = 500 if i % 2 else int(rng.integers(0, 1000))
        rows.append((g, t, i))
    return rows, spark.createDataFrame(rows, "g long, t long, id long")


@pytest.mark.parametrize("chunk_rows", [10_000, 3_000, 400, 64])
def test_positions(spark, skewed, chunk_rows):
    rows, df = skewed
    got = {(r.g, r.id): r.pos for r in sequence_positions(df, ["g"], ["t", "id"], "t", chunk_rows=chunk_rows).collect()}
    by = defaultdict(list)
    for g, t, i in rows:
        by[g].append((t, i))
    want = {(g, i): p for g, items in by.items() for p, (_, i) in enumerate(sorted(items))}
    assert got == want


def test_positions_do_not_depend_on_partitions(spark, skewed):
    _, df = skewed
    a = sequence_positions(df.repartition(3), ["g"], ["t", "id"], "t", chunk_rows=100)
    b = sequence_positions(df.coalesce(1), ["g"], ["t", "id"], "t")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


@pytest.mark.parametrize("chunk_rows", [1000, 40, 5])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_positions_by_time(spark, kind, chunk_rows):
    """Clock readings around a change to summer time, and rows without group or time."""
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = [("g" if i % 4 else None, f"2024-03-31 0{1 + i % 3}:{i % 60:02d}:00" if i % 7 else None, i) for i in range(120)]
        df = spark.createDataFrame(rows, "g string, s string, id long").selectExpr("g", f"cast(s as {kind}) as t", "id")
        a = sequence_positions(df, ["g"], ["t", "id"], "t", chunk_rows=chunk_rows)
        b = sequence_positions(df, ["g"], ["t", "id"], "t")
        assert a.count() == 120 and a.exceptAll(b).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hash_ranks_keep_rows_without_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)] + [("a", i) for i in range(3)], "g string, id long")
    got = sorted((r.g or "", r["rank"], r.n) for r in hash_ranked(df, ["g"], ["id"], 1).collect())
    assert got == [("", k, 5) for k in range(1, 6)] + [("a", k, 3) for k in range(1, 4)]


def test_hash_ranks(spark, skewed):
    rows, df = skewed
    got = {(r.g, r.id): (r.rank, r.n) for r in hash_ranked(df.select("g", "id"), ["g"], ["id"], 9).collect()}
    by = defaultdict(list)
    for g, _, i in rows:
        by[g].append((hashlib.md5(f"{i}|9".encode()).hexdigest(), i))
    for g, items in by.items():
        for k, (_, i) in enumerate(sorted(items), start=1):
            assert got[(g, i)] == (k, len(items))


@pytest.mark.parametrize("chunk_rows", [7, 1000])
def test_interpolation_across_chunks(spark, chunk_rows):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for run, length in (("a", 200), ("b", 40), ("c", 15), ("d", 9)):
        v = rng.normal(size=length)
        v[rng.random(length) < (0.9 if run == "a" else 0.5)] = np.nan
        if run == "d":
            v[:] = np.nan
        filled = pd.Series(v).interpolate(method="linear", limit_direction="both")
        for p in range(length):
            rows.append((run, "x", p, None if np.isnan(v[p]) else float(v[p])))
            if run != "d":
                want[(run, p)] = filled[p]
    df = spark.createDataFrame(rows, "run_id string, channel string, pos long, value double")
    got = {(r.run_id, r.pos): r.value for r in cleaning.interpolate(df, chunk_rows=chunk_rows).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_interpolation_literal(spark):
    v = [None, 1.0, None, None, 16.0, 25.0, None]
    df = spark.createDataFrame([("r", "c", i, x) for i, x in enumerate(v)], "run_id string, channel string, pos long, value double")
    got = [r.value for r in cleaning.interpolate(df).orderBy("pos").collect()]
    assert got == [1, 1, 6, 11, 16, 25, 25]


@pytest.mark.parametrize("window,stride,block", [(16, 8, 2), (16, 8, 64), (12, 5, 3), (5, 9, 4), (8, 8, 1), (20, 3, 1)])
def test_windows_of_long_runs(spark, window, stride, block):
    lengths = {"long": 700, "short": 23, "exact": window, "under": window - 1}
    rows = [(r, p, float(p) + n / 10) for n, (r, L) in enumerate(lengths.items()) for p in range(L)]
    df = spark.createDataFrame(rows, "run_id string, pos long, value double").repartition(5)
    got = {(r.run_id, r.start): list(r.series) for r in sliding_windows(df, window, stride, ["run_id"], block_windows=block).collect()}
    want = {}
    for n, (r, L) in enumerate(lengths.items()):
        for s in range(0, L - window + 1, stride):
            want[(r, s)] = [p + n / 10 for p in range(s, s + window)]
    assert got == want


def test_average_ranks_of_groups_cut_in_ranges(spark):
    """Ties, NULL values and a NULL group, whatever the number of ranges; -0.0 ties with 0.0."""
    rows = [("big", float(i * 7919 % 400)) for i in range(1500)] + [("big", None), ("tied", 3.0), ("tied", 3.0), (None, -0.0), (None, 0.0), (None, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, g string, v double").repartition(5)
    want = pd.DataFrame(rows, columns=["g", "v"]).groupby("g", dropna=False)["v"].rank()
    for cells in (2, 7, 512):
        got = {r.id: r["rank"] for r in average_rank(df, ["g"], "v", "rank", cells).collect()}
        assert len(got) == len(rows) and all(got[i] == (None if pd.isna(w) else w) for i, w in enumerate(want))


def test_ranks_of_values_that_differ_each_time_they_are_computed(spark):
    """As sums of doubles do when their parts arrive in another order."""

    def anew(batches):
        for b in batches:
            yield b.assign(v=np.random.default_rng().random(len(b)))

    df = spark.range(50).mapInPandas(anew, "id long, v double")
    got = sorted(r["rank"] for r in average_rank(df.selectExpr("id", "'a' AS g", "v"), ["g"], "v", "rank").collect())
    assert got == list(range(1, 51))


def test_ranks_are_not_taken_over_a_whole_group(spark):
    df = spark.range(1000).select(F.lit("one").alias("g"), (F.col("id") % 300).cast("double").alias("v"))
    plan = average_rank(df, ["g"], "v", "rank")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_cell#" in line for line in windows)
