"""Files in, files out."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from gaugeflow.catalog import preparing
from gaugeflow.functions.scalars import config_slug
from gaugeflow.operators import cleaning, selection, windows as win
from gaugeflow.plans import grids
from gaugeflow.sources import runfiles, runlogs, tables


def test_run_files(spark, tmp_path):
    for folder, name, n in (("NORM", "1", 40), ("NORM", "2", 5), ("LOCAC", "3", 40), ("odd", "4", 3)):
        d = tmp_path / folder
        d.mkdir(exist_ok=True)
        lines = ["TIME,P_1,T_2,note"] + [f"{i * 10},{'' if i in (2, 3) else i},{2 * i},x" for i in range(n)]
        (d / f"{name}.csv").write_text("\n".join(lines) + "\n")
    long = runfiles.scan_runs(spark, str(tmp_path), "TIME DOUBLE, P_1 DOUBLE, T_2 DOUBLE, note STRING")
    assert {r.channel for r in long.select("channel").distinct().collect()} == {"P_1", "T_2"}
    from gaugeflow.operators.ranking import sequence_positions

    runs = sequence_positions(long.withColumnRenamed("path", "run_id"), ["run_id", "channel"], ["file_row"], "file_row")
    filled = cleaning.interpolate(runs)
    p1 = [r.value for r in filled.filter("run_id LIKE '%NORM/1.csv' AND channel = 'P_1'").orderBy("pos").collect()]
    assert p1 == [float(i) for i in range(40)]
    rel = filled.withColumn("path", F.regexp_extract("run_id", r"([^/]+/[^/]+)$", 1))
    lengths = rel.filter("channel = 'P_1'").groupBy("path").agg(F.count(F.lit(1)).alias("length"))
    labelled = selection.infer_labels(lengths, grids.alias_table(spark))
    got = {r.path: (r["class"], r.reason) for r in cleaning.run_checks(labelled, 16).collect()}
    assert got == {"NORM/1.csv": ("Normal", None), "NORM/2.csv": ("Normal", "short"), "LOCAC/3.csv": ("LOCAC", None), "odd/4.csv": (None, "unknown label")}
    w = win.sliding_windows(filled, 16, 8, ["run_id", "channel"])
    assert w.count() == 2 * 2 * 4


def test_run_files_with_position(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sample,x\n3,30\n1,10\n2,20\n")
    d = runfiles.scan_runs(spark, str(tmp_path), "sample INT, x DOUBLE", pos_column="sample")
    assert [(r.file_row, r.value) for r in d.orderBy("file_row").collect()] == [(1, 10.0), (2, 20.0), (3, 30.0)]


def test_listing(spark, tmp_path):
    for n in ("faulty_training.csv", "free_training.csv"):
        (tmp_path / n).write_text("x\n")
    listing = runfiles.list_files(spark, str(tmp_path), "*.csv")
    missing = runfiles.absent_files(spark, listing, ["faulty_training.csv", "faulty_testing.csv"])
    assert [r.name for r in missing.collect()] == ["faulty_testing.csv"]


def test_process_frame(spark):
    cols = [f" {c.upper()} " for c in (*runfiles.PROCESS_META, *runfiles.PROCESS_CHANNELS)]
    df = spark.createDataFrame([tuple(float(i) for i in range(len(cols)))], cols)
    out = runfiles.canonical_frame(df)
    assert out.columns == [*runfiles.PROCESS_META, *runfiles.PROCESS_CHANNELS] and len(runfiles.PROCESS_CHANNELS) == 52
    with pytest.raises(ValueError, match="2 channel columns are missing"):
        runfiles.canonical_frame(df.drop(" XMV_1 ", " XMV_2 "))


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")

    def final(acc, z=1.5, **kw):
        return json.dumps({"final": {"accuracy": acc, "macro_f1": acc / 2, "epochs_run": 3, "rho_last": 1.0, "H_alpha": 0.5, "alpha_tvar": None,
                                     "S_tau": 0.2, "per_class_alpha": {"0": 0.5}, "perm_null": {"observed_var": 1.0, "null_mean": 0.5, "null_std": 0.1, "z": z, "null_values": [0.4, 0.6]},
                                     "degradation": {"drift": acc - 0.1}, **kw}})

    def epoch(i, rho):
        return json.dumps({"epoch": i, "train_loss": 1.0 / i, "val_acc": 0.1 * i, "rho": rho})

    (d / "full_seed42.jsonl").write_text("\n".join([epoch(1, 0.5), "{broken", epoch(2, None), final(0.7), final(0.9)]) + "\n\n")
    (d / "wo_spectral_seed42.jsonl").write_text("\n".join([epoch(1, 2.5), final(0.8, z=None)]))
    (d / "wo_spectral_seed43.jsonl").write_text(epoch(1, 2.0) + "\n")
    (d / "mystery_seed1.jsonl").write_text(final(0.1))
    (d / "notes.txt").write_text("x")
    (d / "other.jsonl").write_text(final(0.2))
    return str(d)


def test_run_logs(spark, logs):
    parsed = runlogs.parse_lines(runlogs.read_logs(spark, logs)).cache()
    finals = runlogs.name_configs(runlogs.final_records(parsed), grids.config_grid(spark))
    got = {(r.config, r.seed): r for r in finals.collect()}
    assert set(got) == {("full", 42), ("w/o_spectral", 42)}
    r = got[("full", 42)]
    assert r.accuracy == 0.9 and r.alpha_tvar is None and r.perm_null_z == 1.5 and r.degradation == {"drift": 0.8}
    assert got[("w/o_spectral", 42)].perm_null_z is None
    assert [(r.file, r.bad_lines) for r in runlogs.malformed_lines(parsed).collect()] == [("full_seed42.jsonl", 1)]
    assert [r.file for r in runlogs.unfinished_files(parsed).collect()] == ["wo_spectral_seed43.jsonl"]
    e = runlogs.epoch_records(parsed)
    assert e.count() == 4 and e.filter("rho IS NULL").count() == 1
    every = runlogs.name_configs(runlogs.final_records(parsed), grids.config_grid(spark), keep_unknown=True)
    assert {r.config for r in every.collect()} == {"full", "w/o_spectral", "mystery"}


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of about a kilobyte."""
    keys = {"spark.sql.files.maxPartitionBytes": "1024", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_long_logs_are_read_in_blocks(spark, tmp_path, small_blocks):
    lines = [json.dumps({"epoch": i, "val_acc": i / 1000}) if i % 50 else "" for i in range(1500)] + [json.dumps({"final": {"accuracy": a}}) for a in (0.25, 0.75)]
    (tmp_path / "full_seed1.jsonl").write_text("\n".join(lines))
    (tmp_path / "wo_spectral_seed2.jsonl").mkdir()
    for part in range(3):  # a log as a folder of parts
        (tmp_path / "wo_spectral_seed2.jsonl" / f"part-{part}.txt").write_text("\n".join(lines[part * 500:(part + 1) * 500]) + "\n")
    (tmp_path / "empty_seed3.jsonl").write_text("")
    got = runlogs.read_numbered_logs(spark, str(tmp_path))
    want = {n: line for n, line in enumerate(lines) if line}
    for file, upto in (("full_seed1.jsonl", 1502), ("wo_spectral_seed2.jsonl", 1500)):
        rows = got.filter(F.col("file") == file).collect()
        assert {r.line_no: r.line for r in rows} == {n: t for n, t in want.items() if n < upto}
        assert len(rows) == len({r.line_no for r in rows})
        assert [r.line_no for r in sorted(rows, key=lambda r: r.line_at)] == sorted(n for n in want if n < upto)
    read = runlogs.read_logs(spark, str(tmp_path))
    assert read.select("line_at.block").distinct().count() > 20 and read.rdd.getNumPartitions() > 8
    finals = runlogs.final_records(runlogs.parse_lines(read)).collect()
    assert [(r.slug, r.accuracy) for r in finals] == [("full", 0.75)]


def test_long_run_files_keep_their_order(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"{i},{-i}\n" for i in range(2000)))
    (tmp_path / "b.csv").write_text("x,y\n7,8\n")
    (tmp_path / "c.csv").write_text("x,y\n")
    d = runfiles.scan_runs(spark, str(tmp_path), "x DOUBLE, y DOUBLE")
    rows = d.filter("channel = 'x'").select(F.element_at(F.split("path", "/"), -1).alias("f"), "file_row", "value").collect()
    assert sorted((r.file_row, r.value) for r in rows if r.f == "a.csv") == [(i, float(i)) for i in range(2000)]
    assert [(r.file_row, r.value) for r in rows if r.f == "b.csv"] == [(0, 7.0)] and not [r for r in rows if r.f == "c.csv"]


def test_runs_written_by_tasks_that_spill_keep_their_order(spark, tmp_path):
    """Sorts of large tasks spill, and merged spills do not keep the order of equal keys."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(seconds=i), i % 3, "view", float(i), f'{{"k": {i}}}') for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    conf, name = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(name, "100")
    try:
        got = preparing.ordered_run_files(spark, str(tmp_path)).filter("channel = 'reading'").collect()
    finally:
        conf.remove(name)
    assert sorted((r.run_id, r.file_row, r.value) for r in got) == sorted((f"R{i % 3}", i // 3, float(i)) for i in range(3000))


def test_log_reports(spark, logs):
    from gaugeflow.plans.reporting import as_measures, log_reports

    tables = log_reports(spark, logs)
    assert {(r.config, r.n, r.accuracy_mean) for r in tables["results"].collect()} == {("full", 1, 0.9), ("w/o_spectral", 1, 0.8)}
    assert tuple(tables["logs"].first()) == (4, 1, 1)
    assert tables["significance"].count() == 0  # one seed is no pair of runs with a spread
    long = as_measures({k: tables[k] for k in ("results", "curves", "logs")}).collect()
    assert {(r.report, r.config, r.epoch, r.measure): r.value for r in long}[("curves", "full", "1", "rho_mean")] == 0.5


def test_slugs(spark):
    df = spark.createDataFrame([("w/o_dynamic_gating",), ("r1_w/o_spectral",), ("a b!c ",)], "config string")
    assert [r.s for r in df.select(config_slug("config").alias("s")).collect()] == ["wo_dynamic_gating", "r1_wo_spectral", "a_b_c"]
    assert grids.config_grid(spark).select(config_slug("config").alias("s")).distinct().count() == 20


def test_nested_objects(spark):
    doc = json.dumps({"x": 1, "deep": {"list": [{"rho": 1, "epoch": 2}, {"rho": 3}], "m": {"rho": 4, "epoch": 5, "z": None}}, "a": {"b": {"c": {"d": {"e": {"f": {"g": {"rho": 0, "epoch": 0}}}}}}}})
    df = spark.createDataFrame([(1, doc), (2, "not json")], "id long, doc string")
    got = sorted((r.id, r.json_path) for r in runlogs.objects_holding(df, "doc", ["rho", "epoch"]).collect())
    assert got == [(1, "$.a.b.c.d.e.f.g"), (1, "$.deep.list[0]"), (1, "$.deep.m")]


def test_objects_in_odd_texts(spark):
    from gaugeflow.sources.runlogs import objects_in

    keys = ["rho", "epoch"]
    assert [list(objects_in(t, keys)) for t in (None, "", "[", "7", '{"rho": NaN, "epoch": 1}', '{"rho": null, "epoch": 1}', "[" * 200_000)] == [[]] * 7
    assert list(objects_in(r'[[{"\u0072ho": 0, "epoch": "é", "in": {"rho": 1, "epoch": [2]}}]]', keys)) == [
        ("$[0][0]", '{"rho":0,"epoch":"é","in":{"rho":1,"epoch":[2]}}'), ("$[0][0].in", '{"rho":1,"epoch":[2]}')]
    empty = runlogs.objects_holding(spark.createDataFrame([], "id long, doc string, object2 string"), "doc", keys)
    assert empty.columns == ["id", "object2", "json_path", "object"] and empty.count() == 0


def test_table_readers_and_sinks(spark, tmp_path):
    (tmp_path / "finals.csv").write_text("config,seed,final.accuracy,final.perm_null.z,extra\nfull,42,0.5,,x\n")
    r = tables.read_finals(spark, str(tmp_path / "finals.csv"), ["final.accuracy", "final.perm_null.z", "final.absent"]).first()
    assert r.accuracy == 0.5 and r["perm_null.z"] is None and r.seed == 42
    (tmp_path / "rho.csv").write_text("config,seed,epoch,rho\nfull,42,1,0.25\n")
    assert tables.read_table(spark, str(tmp_path / "rho.csv"), tables.RHO_CURVE).first().rho == 0.25
    a = spark.createDataFrame([("full", 1, 0.5)], "config string, seed int, b double")
    b = spark.createDataFrame([("full", 2, 0.7)], "config string, seed int, a double")
    u = tables.union_columns([a, b])
    assert u.columns == ["config", "seed", "a", "b"] and u.count() == 2
    tables.write_cells(tables.tag_cells({"A": a, "B": b}), str(tmp_path / "cells"))
    back = spark.read.parquet(str(tmp_path / "cells"))
    assert back.count() == 2 and (tmp_path / "cells" / "cell=A").is_dir()
    tables.write_report(u, str(tmp_path / "csv"), csv=True)
    tables.write_report(u, str(tmp_path / "csv"), csv=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_protocol_report(spark, tmp_path):
    c = {"train_runs": 1, "val_runs": 0, "test_runs": 1, "train_windows": 2, "val_windows": 0, "test_windows": 1}
    (tmp_path / "p.json").write_text(json.dumps({"seeds": [42], "dataset_report": {
        "window": 128, "stride": 64, "split_seed": 0, "n_runs": 2, "n_channels": 96, "per_class": {"Normal": c, "LOCA": c},
        "within_run_split_classes": ["Normal"], "warnings": []}}, indent=1))
    rows = {r["class"]: r for r in tables.report_classes(tables.read_report(spark, str(tmp_path / "p.json"))).collect()}
    assert rows["Normal"].within_run_split and not rows["LOCA"].within_run_split and rows["LOCA"].train_windows == 2


def test_sensor_columns(spark):
    df = spark.createDataFrame([(1.0, 2, "a", 3.0, 4.0)], "`Time (s)` double, `Sample No` int, name string, `Unnamed: 0` double, P1 double")
    assert cleaning.sensor_columns(df) == ["Time (s)", "P1"]
