"""The preparation chain as a whole: nothing crosses a split, nothing depends on partitions."""

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import splitting
from gaugeflow.plans import preparation

SCHEMA = "run_id string, class string, channel string, pos long, value double"


@pytest.fixture(scope="module")
def samples(spark):
    """Constant-valued runs, so a scaled value tells which statistics were used."""
    rows = []
    for c, runs in (("A", 10), ("B", 20), ("C", 2)):
        for i in range(runs):
            rows += [(f"{c}{i}", c, ch, p, float(i + 10 * k)) for k, ch in enumerate(("x", "y")) for p in range(40)]
    for name, length in (("long", 120), ("mid", 50), ("brief", 35), ("tiny", 20)):
        rows += [(name, name, ch, p, float(p)) for ch in ("x", "y") for p in range(length)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def windows(samples):
    return preparation.prepare(samples, 16, 8, seed=3, within_stride=4).cache()


def test_runs_stay_on_one_side(windows):
    whole = windows.filter(F.col("class").isin("A", "B", "C"))
    assert splitting.leakage(whole, "run_id").count() == 0
    got = {(r["class"], r.split): r.n for r in whole.groupBy("class", "split").agg(F.count_distinct("run_id").alias("n")).collect()}
    assert got == {("A", "train"): 6, ("A", "val"): 2, ("A", "test"): 2, ("B", "train"): 14, ("B", "val"): 3, ("B", "test"): 3,
                   ("C", "train"): 1, ("C", "test"): 1}


def test_single_runs_are_cut_in_time(windows):
    one = windows.filter("channel = 'x'").groupBy("class", "split").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("from_pos") + F.col("start") + 16).alias("end"), F.min("from_pos").alias("at"))
    got = {(r["class"], r.split): (r.n, r["at"], r.end) for r in one.filter("class IN ('long', 'mid', 'brief', 'tiny')").collect()}
    assert got == {
        ("long", "train"): (18, 0, 84), ("long", "val"): (1, 84, 100), ("long", "test"): (1, 102, 118),
        ("mid", "train"): (1, 0, 16), ("mid", "val"): (1, 18, 34), ("mid", "test"): (1, 34, 50),
        ("brief", "train"): (1, 0, 16), ("brief", "test"): (1, 19, 35), ("tiny", "test"): (1, 0, 16)}


def test_scaling_comes_from_train_samples(samples, windows):
    lengths = preparation.run_lengths(samples)
    seg = preparation.assign_segments(lengths, 16, 8, 3, within_stride=4)
    train = samples.join(seg.filter("split = 'train'"), ["run_id", "class"]).filter("pos >= from_pos AND pos < to_pos")
    st = {r.channel: r for r in train.groupBy("channel").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()}
    every = {r.channel: r for r in samples.groupBy("channel").agg(F.avg("value").alias("m")).collect()}
    assert abs(st["x"].m - every["x"].m) > 1e-3
    for r in windows.filter("class = 'B' AND split = 'test' AND win_idx = 0").collect():
        raw = float(r.run_id[1:]) + (10 if r.channel == "y" else 0)
        assert r.series[0] == pytest.approx((raw - st[r.channel].m) / st[r.channel].s, rel=1e-9)


def test_any_partitioning_gives_the_same_windows(spark, samples, windows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = preparation.prepare(samples.coalesce(1), 16, 8, seed=3, within_stride=4)
        cols = ["run_id", "split", "channel", "from_pos", "win_idx", F.transform("series", lambda v: F.round(v, 9)).alias("s")]
        assert again.select(*cols).exceptAll(windows.select(*cols)).count() == 0 and again.count() == windows.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_summary_and_warnings(spark, samples, windows):
    lengths = preparation.run_lengths(samples)
    seg = preparation.assign_segments(lengths, 16, 8, 3, within_stride=4)
    classes = spark.createDataFrame([(c,) for c in ("A", "C", "brief", "none")], "class string")
    got = {r["class"]: r for r in splitting.split_summary(seg, classes, 16).collect()}
    assert (got["A"].train_runs, got["A"].train_windows) == (6, 24) and (got["brief"].val_runs, got["brief"].test_windows) == (0, 1)
    counted = windows.filter("channel = 'x' AND class = 'A'").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in counted} == {s: got["A"][f"{s}_windows"] for s in splitting.SPLITS}
    assert got["none"].train_runs == got["none"].test_windows == 0
    runs = splitting.split_runs(lengths, 3, {"A": (5, 1, 1)})
    warn = {r["class"]: r.warning for r in splitting.split_warnings(runs, classes, 16).collect()}
    assert warn == {"A": "asked counts do not add up, split in proportion", "C": "two runs, no val", "brief": "one run, split in time", "none": "no runs at all"}


def test_functions_travel_without_the_package(tmp_path):
    """Executors have no copy of the package: its functions must be sent whole."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from gaugeflow.functions import distributions
    from gaugeflow.operators import spectral

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps((spectral.band_log_power.func, distributions.t_upper)))
    code = (
        "import pickle, pandas as pd; f, t = pickle.load(open('f.pkl', 'rb'));"
        "print(len(next(f(iter([pd.Series([[float(i % 7) for i in range(64)]])])))[0]), float(t(0.0, 5)))"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["40", "0.5"], out.stderr


def test_scaling_moves_no_sample_by_channel(spark, sf_dir):
    from gaugeflow.catalog import QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("train_only_zscore", "fault_drift", "fault_gaussian_noise_snr20", "prepared_class_summary"):
            plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
            joins = [line for line in plan.splitlines() if "Join" in line]
            assert not [j for j in joins if "channel" in j], name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
