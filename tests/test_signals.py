import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugeflow.operators import degrade, evaluation, routing, spectral
from gaugeflow.plans import audit

ROW = ["window_id"]


@pytest.fixture(scope="module")
def arrays():
    return np.random.default_rng(0).normal(size=(8, 16, 128))


@pytest.fixture(scope="module")
def windows(spark, arrays):
    rows = [(w, f"c{c:02d}", f"k{w % 2}", arrays[w, c].tolist()) for w in range(8) for c in range(16)]
    return spark.createDataFrame(rows, "window_id long, channel string, class string, series array<double>").cache()


def collect(df):
    rows = df.collect()
    out = np.zeros((8, 16, 128))
    for r in rows:
        out[r.window_id, int(r.channel[1:])] = r.series
    assert len(rows) == 128
    return out


@pytest.mark.parametrize("name", degrade.DEGRADATIONS)
def test_faults(windows, arrays, name):
    a = collect(degrade.degrade(windows, name, ROW, 42))
    b = collect(degrade.degrade(windows.repartition(5), name, ROW, 42))
    assert np.isfinite(a).all() and np.allclose(a, b, atol=1e-12, rtol=0) and not np.array_equal(a, arrays)
    changed = a != arrays
    std = arrays.std(axis=(0, 2))
    if name == "gaussian_noise_snr10":
        noise = (a - arrays).std(axis=(0, 2))
        assert np.allclose(noise, np.sqrt((arrays ** 2).mean(axis=(0, 2)) / 10), rtol=0.1)
    elif name == "drift":
        ramp = (a - arrays) / std[None, :, None]
        assert np.allclose(np.abs(ramp), np.linspace(0, 0.5, 128)) and len(set(np.sign(ramp[0, :, -1]))) == 2
        assert np.allclose(ramp, ramp[:1])
    elif name == "bias":
        assert (changed.any(axis=2).sum(axis=1) == 2).all()
        w, c = np.argwhere(changed.any(axis=2))[0]
        assert np.allclose(a[w, c] - arrays[w, c], 0.5 * std[c])
    elif name == "stuck":
        assert (changed.any(axis=2).sum(axis=1) == 1).all()
        w, c = np.argwhere(changed.any(axis=2))[0]
        assert (a[w, c] == arrays[w, c, 0]).all()
    elif name == "dropout":
        zero = (a == 0)
        assert (zero.sum(axis=2) == 13).all() and (zero == zero[:, :1]).all()
    elif name == "downsample":
        sub = arrays[:, :, ::2]
        want = np.stack([np.stack([np.interp(np.arange(128) / 2, np.arange(64), s) for s in w]) for w in sub])
        assert np.allclose(a, want)


def test_downsample_odd_length(spark):
    s = [0.0, 5.0, 4.0, 9.0, 8.0]
    df = spark.createDataFrame([(0, "c", s)], "window_id long, channel string, series array<double>")
    got = degrade.degrade(df, "downsample", ROW, 1).first().series
    assert got == [0.0, 2.0, 4.0, 6.0, 8.0]
    got = degrade.degrade(df.withColumn("series", F.slice("series", 1, 4)), "downsample", ROW, 1).first().series
    assert got == [0.0, 2.0, 4.0, 4.0]


def test_unknown_fault(windows):
    with pytest.raises(ValueError, match="unknown degradation"):
        degrade.degrade(windows, "rust", ROW, 1)


def test_fast_noise(windows, arrays):
    m = degrade.channel_moments(windows).select("channel", F.col("power").alias("_power"))
    d = windows.join(m, "channel").withColumn("series", degrade.noise_series(ROW, 3, 20.0, exact_hash=False)).drop("_power")
    noise = collect(d) - arrays
    assert np.allclose(noise.std(), np.sqrt((arrays ** 2).mean() / 100), rtol=0.05) and abs(noise.mean()) < 0.01


def test_all_faults_equal_single_ones(windows):
    every = degrade.all_degradations(windows, ROW, 42)
    assert every.count() == 8 * 128
    for name in ("drift", "stuck", "dropout"):
        assert np.array_equal(collect(every.filter(F.col("degradation") == name)), collect(degrade.degrade(windows, name, ROW, 42)))


def test_spectra(windows, arrays):
    got = {(r.window_id, r.channel): r.m for r in windows.select("window_id", "channel", spectral.magnitude_spectrum("series").alias("m")).collect()}
    assert np.allclose(got[(3, "c05")], np.abs(np.fft.rfft(arrays[3, 5]))[1:])
    band = windows.filter("window_id = 0 AND channel = 'c00'").select(spectral.band_log_power("series").alias("b")).first().b
    assert len(band) == 8 * 9


def test_periods_of_a_sine(spark):
    s = np.sin(2 * np.pi * 8 * np.arange(64) / 64).tolist()
    df = spark.createDataFrame([(0, "c", s)], "window_id long, channel string, series array<double>")
    top = spectral.dominant_periods(df, 64, 2).orderBy("rank").collect()
    assert top[0].bin == 8 and top[0].period == 8 and abs(sum(r.weight for r in top) - 1) < 1e-12
    folded = spectral.fold_by_period(df.withColumn("series", F.slice("series", 1, 10)), F.lit(4)).orderBy("cycle").collect()
    assert [len(r.phases) for r in folded] == [4, 4, 4] and folded[2].phases[2:] == [0.0, 0.0]


def test_adaptive_pool(spark):
    df = spark.createDataFrame([([float(i) for i in range(10)],)], "s array<double>")
    got = df.select(spectral.adaptive_pool("s", 4).alias("p")).first().p
    assert got == [1.0, 3.0, 6.0, 8.0]


def alpha_frame(spark, values):
    return spark.createDataFrame([(i, "c", "k", v) for i, v in enumerate(values)], "window_id long, channel string, class string, series array<double>")


def test_routing_extremes(spark):
    const = alpha_frame(spark, [[0.5] * 8] * 4)
    assert routing.temporal_variance(const).first()[0] == 0
    assert abs(routing.routing_entropy(const).first()[0] - 1) < 1e-12
    assert abs(routing.load_balance(const).first()[0] - 1) < 1e-12
    hard = alpha_frame(spark, [[0.0, 1.0] * 4])
    e = routing.routing_entropy(hard).first()[0]
    assert math.isfinite(e) and e < 1e-9
    assert routing.gate_saturation(alpha_frame(spark, [[0.9, 0.91, 0.5, 1.0]])).first()[0] == 0.5
    null = routing.permutation_null(const, ROW, 5, 1).first()
    assert null.observed == 0 and null.z is None


def test_histogram_edges(spark):
    h = {r.bin: r.elements for r in routing.histogram(alpha_frame(spark, [[0.0, 1.0, 0.999, 0.5]])).collect()}
    assert h == {0: 1, 59: 2, 30: 1}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    v = np.round(np.concatenate([rng.random(500), np.full(400, 0.25), [0.0, 1.0]]), 4)
    df = spark.createDataFrame([(float(x),) for x in v], "a double")
    for cells in (4, 65536):
        got = {r.prob: r["quantile"] for r in routing.exact_quantiles(df, "a", [0.05, 0.3, 0.95], 0.0, 1.0, cells=cells).collect()}
        assert all(abs(got[p] - np.percentile(v, 100 * p)) < 1e-12 for p in (0.05, 0.3, 0.95))


def test_exact_quantiles_of_values_in_one_cell(spark):
    v = 0.5 + np.random.default_rng(6).random(5000) / 1e7
    df = spark.createDataFrame([(float(x),) for x in v], "a double").repartition(6)
    got = {r.prob: r["quantile"] for r in routing.exact_quantiles(df, "a", [0.0, 0.05, 0.5, 1.0], 0.0, 1.0).collect()}
    assert all(abs(got[p] - np.percentile(v, 100 * p)) < 1e-15 for p in (0.0, 0.05, 0.5, 1.0))


def test_permutation_null_sees_order(spark):
    rng = np.random.default_rng(2)
    smooth = alpha_frame(spark, [np.sin(np.arange(64) / 8 + p).tolist() for p in rng.random(12)])
    r = routing.permutation_null(smooth, ROW, 20, 3).first()
    assert r.z > 5 and r.observed > r.null_mean


def test_sparse_mappings(spark):
    rng = np.random.default_rng(4)
    rows = [(g, k, float(x)) for g in range(20) for k, x in enumerate(rng.normal(size=6) * (1 + g / 4))] + [(99, k, 1.0) for k in range(4)]
    df = spark.createDataFrame(rows, "g long, k long, z double")
    for fn in (routing.sparsemax_over, routing.entmax15_over):
        got = fn(df, ["g"], "z", ["k"]).groupBy("g").agg(F.sum("p").alias("s"), F.min("p").alias("lo")).collect()
        assert all(abs(r.s - 1) < 1e-9 and r.lo >= 0 for r in got)
    tied = [r.p for r in routing.sparsemax_over(df.filter("g = 99"), ["g"], "z", ["k"]).collect()]
    assert tied == [0.25] * 4


def test_fusion_rules(spark):
    df = spark.createDataFrame([(0, "a", 1.0, 0.0, 0.25), (0, "b", 0.0, 1.0, 0.25)], "w long, class string, s_t double, s_f double, al double")
    assert routing.argmax_class(routing.fuse(df, F.col("al")), ["w"]).first().y_pred == "b"
    assert routing.argmax_class(routing.fuse(df, F.lit(0.5)), ["w"]).first().y_pred == "a"
    with pytest.raises(PySparkException, match="outside"):
        routing.fuse(df, F.lit(1.5)).collect()
    means = spark.createDataFrame([("a", 0.5)], "class string, alpha double")
    with pytest.raises(PySparkException, match="no weight for class b"):
        routing.class_weights(df.select("w", "class"), means).collect()


def test_silhouette(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(40, 5)), rng.normal(size=(30, 5)) + 2, [[9.0] * 5]])
    y = [0] * 40 + [1] * 30 + [2]
    df = spark.createDataFrame([(i, y[i], x[i].tolist()) for i in range(71)], "id long, y int, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(71):
        own = [j for j in range(71) if y[j] == y[i] and j != i]
        if not own:
            s.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, [j for j in range(71) if y[j] == c]].mean() for c in set(y) - {y[i]})
        s.append((b - a) / max(a, b))
    r = evaluation.silhouette(df, "id", "y", "v").first()
    assert r.n == 71 and abs(r.silhouette - np.mean(s)) < 1e-12
    with pytest.raises(ValueError):
        evaluation.silhouette(df, "id", "y", "v", limit=70)


def test_audit(spark):
    rng = np.random.default_rng(8)
    rows = []
    for w in range(60):
        k = w % 2
        for c in ("c0", "c1"):
            rows.append((w, c, f"k{k}", (rng.normal(size=32) * 0.3 + np.sin(np.arange(32) * (1 if k else 2))).tolist()))
    df = spark.createDataFrame(rows, "window_id long, channel string, class string, series array<double>")
    out = {r.config: r for r in audit.audit(df, "class", "window_id", [1]).collect()}
    assert set(out) == {"full", "w/o_spectral", "w/o_temporal"}
    assert out["full"].accuracy > 0.9 and set(out["full"].degradation) == set(degrade.DEGRADATIONS)
    with pytest.raises(ValueError):
        audit.audit(df, "class", "window_id", [1], ["nope"])


def test_audit_model_is_gaussian_and_split_by_run(spark, windows):
    """Scores of one window against its formula; windows of one run are never on both sides."""
    feats = audit._with_features(windows).cache()
    fitted = audit.model(audit.moments(feats, "class"))
    got = audit.scores(feats, fitted, ["window_id", "class"]).filter("window_id = 3").first()
    rows = {(r.window_id, r["class"], r.channel): r for r in feats.collect()}
    for k, c in enumerate(x["class"] for x in got.classes):
        for family in ("temporal", "spectral"):
            want = 0.0
            for ch in {r[2] for r in rows}:
                train = np.array([r[family] for (w, y, h), r in rows.items() if y == c and h == ch])
                mean, var = train.mean(0), train.var(0) + audit.VARIANCE_FLOOR
                want += (-0.5 * (np.log(var) + (np.array(rows[3, "k1", ch][family]) - mean) ** 2 / var)).sum()
            assert got[family][k] == pytest.approx(want)
    grouped = windows.withColumn("run", F.floor(F.col("window_id") / 4))
    finals = audit.audit(grouped, "class", "window_id", [1, 2, 3, 4, 5], ["full"], test_share=0.5, run="run").collect()
    tested = grouped.select("window_id", "run", *[(audit.uniform("run", s) < 0.5).alias(f"s{s}") for s in (1, 2, 3, 4, 5)]).distinct().collect()
    assert len(finals) == sum(any(r[f"s{s}"] for r in tested) and not all(r[f"s{s}"] for r in tested) for s in (1, 2, 3, 4, 5))


def test_scores_send_numbers_only_and_take_logarithms_from_the_model(spark):
    rows = [(i, "AB"[i % 2], c, [float((i * k * 7 + len(c)) % 5) for k in range(8)]) for i in range(12) for c in ("c0", "c11")]
    feats = audit._with_features(spark.createDataFrame(rows, "window_id long, class string, channel string, series array<double>"))
    fitted = audit.model(audit.moments(feats, "class"))
    for of in fitted.first()["model"].values():
        assert all(np.isclose(m["log"], np.log(m["variance"])) for c in of for f in ("temporal", "spectral") for m in c[f])
    scored = audit.scores(feats, fitted, ["window_id"])
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert all("class" not in line for line in plan.splitlines() if "collect_list(struct(channel, channel" in line and "temporal, temporal" in line)
    assert "collect_list(struct(channel, channel" in plan and "c, c#" not in plan
    assert [c["class"] for c in scored.filter("window_id = 5").first()["classes"]] == ["A", "B"]
