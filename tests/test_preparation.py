import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugeflow.operators import cleaning, selection, splitting, windows as win
from gaugeflow.plans import grids


def test_label_inference(spark):
    paths = {
        "NORM/1.csv": "Normal", "LOCAC/3.csv": "LOCAC", "data/LOCA_7.csv": "LOCA", "x/SGTR loop A/9.csv": "SGATR",
        "FLB_run12.csv": "FLB", "misc/zzz.csv": None, "LOCACX/1.csv": "LOCAC", "SP.csv": "SP", "whatever/TT12.csv": "TT",
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r["class"] for r in selection.infer_labels(df, grids.alias_table(spark)).collect()}
    assert got == paths


def test_run_names(spark):
    df = spark.createDataFrame([(f"N15_M07_F10_{b}_1",) for b in ("K001", "KI21", "KB23", "KX01")] + [("nonsense",)], "stem string")
    rows = {r.stem: r for r in selection.parse_run_names(df).collect()}
    assert [rows[f"N15_M07_F10_{b}_1"].code for b in ("K001", "KI21", "KB23")] == ["K", "KI", "KB"]
    assert rows["N15_M07_F10_KX01_1"].bad_name == "unknown bearing code"
    assert rows["nonsense"].bad_name == "not a run-file name"
    assert rows["N15_M07_F10_K001_1"].setting == "N15_M07_F10" and rows["N15_M07_F10_K001_1"].run == 1
    with pytest.raises(PySparkException, match="unknown bearing code"):
        selection.parse_run_names(df.filter("stem LIKE '%KX01%'"), strict=True).collect()


def segments(spark, length, window):
    df = spark.createDataFrame([("r", length)], "run_id string, length long")
    rows = splitting.split_within_run(df, window).collect()
    out = {r.split: (r.to_pos - r.from_pos) for r in rows}
    counts = {s: max(0, (n - window) // 32 + 1) if n >= window else 0 for s, n in out.items()}
    return rows[0].way, out, counts


def test_single_run_segments(spark):
    assert segments(spark, 302, 128) == ("test tail", {"train": 174, "test": 128}, {"train": 2, "test": 1})
    assert segments(spark, 580, 128) == (
        "fixed tails", {"train": 324, "val": 128, "test": 128}, {"train": 7, "val": 1, "test": 1})
    assert segments(spark, 1000, 128) == ("proportional", {"train": 700, "val": 150, "test": 150}, {"train": 18, "val": 1, "test": 1})
    assert segments(spark, 200, 128)[0] == "test only"


@pytest.mark.parametrize("n,exact,want", [
    (140, None, (98, 21, 21)), (140, (98, 21, 21), (98, 21, 21)), (100, None, (70, 15, 15)), (3, None, (1, 1, 1)),
    (2, None, (1, 0, 1)), (10, (6, 2, 2), (6, 2, 2)), (10, (7, 2, 2), (6, 2, 2)), (101, None, (71, 15, 15)),
])
def test_split_counts(spark, n, exact, want):
    df = spark.createDataFrame([(f"r{i}", "c") for i in range(n)], "run_id string, class string")
    rows = splitting.split_runs(df, 42, {"c": exact} if exact else None).collect()
    assert tuple(sum(r.split == s for r in rows) for s in ("train", "val", "test")) == want
    assert {r.fell_back for r in rows} == {exact is not None and sum(exact) != n}


def test_split_rejects_bad_counts(spark):
    df = spark.createDataFrame([("r", "c")], "run_id string, class string")
    with pytest.raises(ValueError):
        splitting.split_runs(df, 1, {"c": (0, 1, 1)})


def test_split_is_repeatable_and_seeded(spark):
    df = spark.createDataFrame([(f"r{i}", "c") for i in range(50)], "run_id string, class string")
    a = {r.run_id: r.split for r in splitting.split_runs(df, 1).collect()}
    b = {r.run_id: r.split for r in splitting.split_runs(df.repartition(7), 1).collect()}
    c = {r.run_id: r.split for r in splitting.split_runs(df, 2).collect()}
    assert a == b and a != c


def test_dealing_reaches_every_cell(spark):
    units = [(f"{b}-{s}-{i}", "K", b, s) for b in ("K001", "K002") for s in ("N09", "N15") for i in range(6)]
    df = spark.createDataFrame(units, "unit string, class string, bearing string, setting string")
    out = splitting.split_stratified(df, 42, ["bearing", "setting"])
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 14, "val": 5, "test": 5}
    assert splitting.uncovered_cells(out, ["bearing", "setting"]).count() == 0
    assert splitting.leakage(out, "unit").count() == 0


def test_dealing_after_quarantine(spark):
    units = [(f"u{i}", "K", f"b{i % 2}", "s") for i in range(20)]
    df = spark.createDataFrame(units, "unit string, class string, bearing string, setting string")
    ch = [(u[0], c, 10, 0) for u in units for c in ("a", "b")]
    ch[5] = (ch[5][0], "b", 10, 3)
    good, bad = cleaning.quarantine(df, spark.createDataFrame(ch, "unit string, channel string, length long, gaps long"), ("a", "b"))
    assert [(r.unit, r.reason) for r in bad.collect()] == [("u2", "not finite")]
    out = splitting.split_stratified(good, 42, ["bearing", "setting"])
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 11, "val": 4, "test": 4}


def test_quarantine_reasons(spark):
    units = spark.createDataFrame([("ok", "K"), ("gone", "K"), ("part", "KA"), ("void", "KA")], "unit string, class string")
    ch = spark.createDataFrame(
        [("ok", "a", 5, 0), ("ok", "b", 5, 0), ("part", "a", 5, 0), ("void", "a", 0, 0), ("void", "b", 4, 0)],
        "unit string, channel string, length long, gaps long")
    good, bad = cleaning.quarantine(units, ch, ("a", "b"))
    assert [r.unit for r in good.collect()] == ["ok"]
    assert {r.unit: r.reason for r in bad.collect()} == {"gone": "missing a,b", "part": "missing b", "void": "empty channel"}
    classes = units.select("class").distinct()
    assert [r["class"] for r in cleaning.lost_classes(classes, good).collect()] == ["KA"]


def test_held_out_bearings(spark):
    have = {"K": 6, "KA": 12, "KI": 11, "KB": 3}
    units = [(c, f"{c}{i:02d}", r) for c, n in have.items() for i in range(n) for r in range(3)]
    df = spark.createDataFrame(units, "code string, bearing string, run long")
    out = splitting.split_groups(df, 42)
    got = {r.split: r.b for r in out.groupBy("split").agg(F.count_distinct("bearing").alias("b")).collect()}
    assert got == {"train": 19, "val": 7, "test": 6}
    assert splitting.leakage(out, "bearing").count() == 0
    with pytest.raises(PySparkException, match="class KB needs 3"):
        splitting.split_groups(df.filter("bearing <> 'KB00'"), 42).collect()


def test_onset_and_windows(spark):
    rows = [("n", "Normal", p, 0.0) for p in range(500)] + [("f", "F1", p, 0.0) for p in range(500)]
    df = selection.trim_onset(spark.createDataFrame(rows, "run_id string, class string, pos long, value double"))
    w = win.sliding_windows(df, 128, 128, ["run_id"])
    assert {r.run_id: r["count"] for r in w.groupBy("run_id").count().collect()} == {"n": 3, "f": 3}
    assert df.filter("run_id = 'f'").agg(F.max("pos")).first()[0] == 478


def test_scaling_uses_train_alone(spark):
    rows = [("train", 1.0)] * 3 + [("train", 5.0)] + [("test", 100.0)] * 4
    df = spark.createDataFrame([(s, "c", v) for s, v in rows], "split string, channel string, value double")
    got = {round(r.value, 9) for r in win.zscore_by_train(df).filter("split = 'test'").collect()}
    assert got == {round((100 - 2.0) / 3 ** 0.5, 9)}


def test_scaling_without_train_and_flat_channel(spark):
    df = spark.createDataFrame([("test", "c", 1.0), ("val", "c", 3.0), ("test", "flat", 2.0), ("val", "flat", 2.0)],
                               "split string, channel string, value double")
    got = sorted((r.channel, r.value) for r in win.zscore_by_train(df).collect())
    assert got == [("c", -1.0), ("c", 1.0), ("flat", 0.0), ("flat", 0.0)]


def test_pooling(spark):
    df = spark.createDataFrame([("u", "c", p, float(p)) for p in range(3205)], "unit string, channel string, pos long, value double")
    v = [r.value for r in win.mean_pool(df, ["unit", "channel"]).orderBy("pos").collect()]
    assert len(v) == 200 and v[0] == 7.5 and v[-1] == 3191.5


def test_rate_alignment(spark):
    fast = [("u", c, p, float(p)) for c in ("x", "junk") for p in range(160)] + [("w", "x", p, 0.0) for p in range(160)]
    slow = [("u", "y", p, float(-p)) for p in range(7)] + [("u", "temp", 0, 1.0)]
    schema = "unit string, channel string, pos long, value double"
    both = spark.createDataFrame(fast + slow, schema)
    rows = win.align_rates(both, "unit", ["x"], ["y"]).collect()
    assert sorted((r.unit, r.pos, r.x, r.y) for r in rows) == [("u", p, p * 16 + 7.5, -float(p)) for p in range(7)]
    assert [(r.unit, r.channel) for r in win.missing_channels(both, "unit", ["x", "y"]).collect()] == [("w", "y")]


def test_evenly_spaced_runs(spark):
    ids = spark.createDataFrame([("c", i * 3) for i in range(500)], "class string, run_no long")
    got = [r.run_no for r in selection.evenly_spaced_runs(ids, 140).orderBy("pick").collect()]
    assert got == [3 * round(i * (499 / 139)) for i in range(140)]
    with pytest.raises(PySparkException, match="too few runs"):
        selection.evenly_spaced_runs(ids, 501).collect()


def test_stratified_subsample(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = selection.stratified_subsample(df, "label", ["id"], 100, 0).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"big": 70, "small": 30}
    assert selection.stratified_subsample(df, "label", ["id"], 300, 0).count() == 300


def test_run_checks(spark):
    df = spark.createDataFrame([("a", "C", 50), ("b", "C", 10), ("c", None, 50), ("d", "C", 0)], "run_id string, class string, length long")
    got = {r.run_id: r.reason for r in cleaning.run_checks(df, 16).collect()}
    assert got == {"a": None, "b": "short", "c": "unknown label", "d": "empty"}


def test_config_grids(spark):
    full = grids.config_grid(spark)
    assert full.count() == 20 and full.filter("NOT use_spectral").count() == 2
    assert [r.config for r in grids.config_grid(spark, "replication", periodic=True).orderBy("position").collect()] == [
        *grids.REPLICATION, "tsnet_vanilla"]
    assert grids.config_grid(spark, smoke=True).count() == 3
    with pytest.raises(ValueError, match="nonsense"):
        grids.config_grid(spark, only=["nonsense"])
    with pytest.raises(ValueError):
        grids.config_grid(spark, "other")


def test_stratified_split_keeps_every_unit(spark):
    rows = [(f"u{i}", "big", ["x", "y", None][i % 3]) for i in range(15)] + [("p", "two", "x"), ("q", "two", "y"), ("r", "one", None), ("s", None, "x")]
    units = spark.createDataFrame(rows, "unit string, class string, cell string")
    got = splitting.split_stratified(units, 3, ["cell"]).collect()
    assert sorted(map(repr, (r[:3] for r in got))) == sorted(map(repr, rows))
    by = {}
    for r in got:
        by.setdefault(r["class"], []).append(r.split)
    assert sorted(by["two"]) == ["test", "train"] and by["one"] == ["test"] and by[None] == ["test"]
    assert {s: by["big"].count(s) for s in set(by["big"])} == {"train": 9, "val": 3, "test": 3}


def test_first_record_of_a_channel_counts(spark):
    rows = [("a", "fast", 1, i, float(i)) for i in range(4)] + [("a", "fast", 2, i, 100.0) for i in range(4)]
    rows += [("a", "slow", 3, i, 7.0) for i in range(2)] + [("a", "slow", 4, i, 9.0) for i in range(2)]
    df = spark.createDataFrame(rows, "unit string, channel string, rec int, pos long, value double")
    got = win.align_rates(df, "unit", ["fast"], ["slow"], factor=2, record="rec").orderBy("pos").collect()
    assert [tuple(r[c] for c in ("unit", "pos", "fast", "slow")) for r in got] == [("a", 0, 0.5, 7.0), ("a", 1, 2.5, 7.0)]


def test_repeated_positions_count_once(spark):
    rows = [(1, "fast", i, float(i)) for i in range(8)] + [(1, "fast", 2, 9.0), (1, "fast", 7, 1.0), (1, "slow", 0, 5.0), (1, "slow", 0, 4.0), (1, "slow", 1, None),
            (2, "fast", 0, 1.0), (2, "fast", 0, 2.0), (2, "slow", 0, 1.0)]
    df = spark.createDataFrame(rows, "unit int, channel string, pos int, value double")
    got = {(r.unit, r.pos): (r.fast, r.slow) for r in win.align_rates(df, "unit", ["fast"], ["slow"], factor=4).collect()}
    assert got == {(1, 0): (1.5, 4.0), (1, 1): ((4 + 5 + 6 + 1) / 4, None)}
    wide = spark.createDataFrame([(1, "fast", i, 1.0) for i in range(130)] + [(1, "slow", 0, 2.0)], "unit int, channel string, pos int, value double")
    assert [tuple(r) for r in win.align_rates(wide, "unit", ["fast"], ["slow"], factor=130).collect()] == [(1, 0, 1.0, 2.0)]
