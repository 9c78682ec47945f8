"""Recorded results of real experiment runs must be reproduced."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import distributions as dist
from gaugeflow.functions.scalars import tier
from gaugeflow.operators import epochs as ep, evaluation, reports, significance as sig
from gaugeflow.plans import grids

# Recorded accuracies of ten runs (seeds 42..51) of five configurations.
ACCURACY = {
    "full": (0.9911816578483245, 0.9947089947089947, 0.9911816578483245, 0.9929453262786596, 0.9885361552028219,
            0.9832451499118166, 0.9938271604938271, 0.9920634920634921, 0.9929453262786596, 0.9955908289241623),
    "w/o_fusion": (0.9911816578483245, 0.9938271604938271, 0.9902998236331569, 0.9938271604938271, 0.9894179894179894,
                  0.9929453262786596, 0.9947089947089947, 0.9902998236331569, 0.9929453262786596, 0.9947089947089947),
    "w/o_gating": (0.9947089947089947, 0.9938271604938271, 0.9991181657848325, 0.9947089947089947, 0.9911816578483245,
                  0.9991181657848325, 0.9938271604938271, 0.9973544973544973, 0.9920634920634921, 0.9929453262786596),
    "w/o_spectral": (0.9947089947089947, 0.9982363315696648, 1.0, 1.0, 0.9973544973544973,
                    0.9982363315696648, 0.9991181657848325, 0.9991181657848325, 0.9991181657848325, 1.0),
    "w/o_temporal": (0.9056437389770723, 0.9171075837742504, 0.9135802469135802, 0.9074074074074074, 0.9047619047619048,
                    0.9074074074074074, 0.9074074074074074, 0.91005291005291, 0.9144620811287478, 0.9109347442680776),
}
# Recorded tests of accuracy against "full":
# t p, signed-rank p, normality p, t Holm, t BH, signed-rank Holm, signed-rank BH, tier.
RECORDED = {
    "w/o_spectral": (0.00011776750868621537, 0.001953125, 0.08269467143840313, 0.0003533025260586461,
                     0.00023553501737243074, 0.0078125, 0.00390625, "robust"),
    "w/o_temporal": (2.5003553459032753e-13, 0.001953125, 0.12394046607036924, 1.0001421383613101e-12,
                     1.0001421383613101e-12, 0.0078125, 0.00390625, "robust"),
    "w/o_fusion": (0.4609347772397011, 0.9609375, 0.0001219842358851967, 0.4609347772397011,
                   0.4609347772397011, 0.9609375, 0.9609375, "n.s."),
    "w/o_gating": (0.09100714860732868, 0.08984375, 0.11978024031457263, 0.18201429721465737,
                   0.12134286480977158, 0.1796875, 0.11979166666666667, "marginal"),
}
# Recorded (truth, prediction) counts of one run on 869 windows.
CONFUSION = {
    (0, 8): 1, (1, 9): 1, (2, 2): 27, (3, 3): 1, (4, 4): 105, (5, 5): 13, (5, 6): 60, (6, 5): 20, (6, 6): 61, (7, 7): 1,
    (8, 8): 99, (8, 9): 5, (8, 15): 1, (9, 9): 83, (9, 15): 30, (10, 8): 3, (10, 10): 25, (11, 11): 16, (12, 12): 85,
    (13, 13): 100, (14, 2): 1, (14, 6): 5, (14, 14): 36, (15, 9): 58, (15, 15): 30, (16, 9): 1, (17, 2): 1,
}


@pytest.fixture(scope="module")
def finals(spark):
    rows = [(c, 42 + i, a, a - 0.01 * (i % 3)) for c, runs in ACCURACY.items() for i, a in enumerate(runs)]
    return spark.createDataFrame(rows, "config string, seed int, accuracy double, macro_f1 double").cache()


def test_recorded_significance(finals):
    rows = {r.config: r for r in sig.significance_table(finals, "full").filter("metric = 'accuracy'").collect()}
    assert set(rows) == set(RECORDED)
    for c, (t, w, s, th, tb, wh, wb, tr) in RECORDED.items():
        r = rows[c]
        assert r.n == 10 and r.t_p == pytest.approx(t, rel=1e-9) and r.wilcoxon_p == pytest.approx(w, rel=1e-12)
        assert r.shapiro_p == pytest.approx(s, rel=2e-5)
        assert (r.t_holm_p, r.t_bh_p) == (pytest.approx(th, rel=1e-9), pytest.approx(tb, rel=1e-9))
        assert (r.wilcoxon_holm_p, r.wilcoxon_bh_p) == (pytest.approx(wh), pytest.approx(wb)) and r.tier == tr
    r = rows["w/o_spectral"]
    assert r.mean_diff == pytest.approx(0.006966490299823635, rel=1e-12)
    assert (r.ci95_lo, r.ci95_hi) == (pytest.approx(0.004524215998239705, rel=1e-9), pytest.approx(0.009408764601407566, rel=1e-9))
    assert r.cohens_dz == pytest.approx(2.0405271197933956, rel=1e-9)


def test_single_tests_agree_with_the_table(finals):
    pairs = sig.pair_by_seed(sig.metric_rows(finals), "full")
    keys = ["metric", "config"]
    table = {(r.metric, r.config): r for r in sig.significance_table(finals, "full").collect()}
    for fn, col in ((sig.paired_t, "t_p"), (sig.wilcoxon, "wilcoxon_p"), (sig.shapiro, "shapiro_p")):
        for r in fn(pairs, keys).collect():
            assert r[col] == pytest.approx(table[(r.metric, r.config)][col], rel=1e-12)


def test_recorded_results_table(finals):
    got = {r.config: r.accuracy for r in reports.formatted_results(reports.results_table(finals)).collect()}
    assert got == {"full": "0.9916±0.0036", "w/o_spectral": "0.9986±0.0016", "w/o_temporal": "0.9099±0.0041",
                   "w/o_fusion": "0.9924±0.0020", "w/o_gating": "0.9949±0.0028"}
    seeds = reports.results_table(finals).filter("config = 'full'").first().seeds
    assert seeds == "42,43,44,45,46,47,48,49,50,51"


def test_recorded_confusion(spark):
    preds = spark.createDataFrame([(t, p) for (t, p), n in CONFUSION.items() for _ in range(n)], "y_true int, y_pred int")
    r = evaluation.accuracy_macro_f1(preds).first()
    assert r.n == 869 and r.accuracy == pytest.approx(0.7848101265822784, rel=1e-14)
    assert r.macro_f1 == pytest.approx(0.6475576016485527, rel=1e-14)
    labels = spark.createDataFrame([(i,) for i in range(20)], "label int")
    m = evaluation.confusion_matrix(preds, labels)
    assert m.count() == 400 and evaluation.implied_accuracy(m).first()[0] == pytest.approx(0.7848101265822784)
    sums = {round(x.s, 9) for x in m.groupBy("y_true").agg(F.sum("share").alias("s")).collect()}
    assert sums == {0.0, 1.0}


def test_recorded_warning_signs(spark):
    # Saturation and gradient ratio of ten recorded runs.
    s = (0.1257132589817047, 0.11340945959091187, 0.1496882289648056, 0.1331416815519333, 0.11504749953746796,
         0.11123178154230118, 0.1250523179769516, 0.18503965437412262, 0.11956249177455902, 0.12857449054718018)
    r = (0.933110933529584, 1.8630012496756347, 0.644585872464356, 2.163785530577517, 0.41865550562554593,
         0.9425293257692743, 0.44704745692779474, 1.3078027055453871, 0.6397489121071114, 0.6883550242442313)
    rows = [("B", "full", 42 + i, a, b) for i, (a, b) in enumerate(zip(s, r))] + [("B", "full", 60, 0.9, 9.0), ("B", "full", 61, None, 9.0)]
    df = spark.createDataFrame(rows, "cell string, config string, seed int, S_tau double, rho_last double")
    got = {x.subset: x for x in reports.warning_rates(df).collect()}
    b = got["balanced"]
    assert (b.n_runs, b.n_d1, b.n_d2, b.n_both, b.rate_d2) == (10, 1, 2, 0, 0.2)
    assert (got["all_available"].n_runs, got["all_available"].n_both) == (11, 1)


def test_degenerate_pairs(spark):
    rows = [("same", s, 0.5) for s in range(5)] + [("full", s, 0.5) for s in range(5)] + [("one", 0, 0.7)]
    df = spark.createDataFrame(rows, "config string, seed int, accuracy double").withColumn("macro_f1", F.col("accuracy"))
    got = {r.config: r for r in sig.significance_table(df, "full").filter("metric = 'accuracy'").collect()}
    assert set(got) == {"same"}
    r = got["same"]
    assert r.t_p is None and r.wilcoxon_p is None and r.shapiro_p is None and r.t_holm_p is None and r.tier == "n.s."
    eq = {x.eps: x for x in sig.tost(sig.pair_by_seed(sig.metric_rows(df, ["accuracy"]), "full"), ["config"]).filter("config = 'same'").collect()}
    assert eq[0.005].tost_p is None and not eq[0.005].equivalent and eq[0.005].ci90_inside


def test_signed_rank_with_ties_and_zeros(spark):
    from itertools import product

    d = [0.0, 1.0, 1.0, -1.0, 2.0, 3.0, -2.0, 4.0]
    df = spark.createDataFrame([("c", i, x, 0.0) for i, x in enumerate(d)], "config string, seed int, a double, b double")
    r = sig.wilcoxon(df, ["config"]).first()
    ranks = [2, 2, 2, 4.5, 6, 4.5, 7]
    signs = [1, 1, -1, 1, 1, -1, 1]
    pos = sum(k for k, g in zip(ranks, signs) if g > 0)
    sums = [sum(k for k, g in zip(ranks, f) if g) for f in product((0, 1), repeat=7)]
    p = min(1, 2 * min(sum(x <= pos for x in sums), sum(x >= pos for x in sums)) / 128)
    assert r.n_nonzero == 7 and r.statistic == min(pos, sum(ranks) - pos) and r.wilcoxon_p == pytest.approx(p)


def test_signed_rank_of_many_pairs_with_ties(spark):
    """More pairs than a range holds: sums of ranks, ties and zeros as one sort gives them."""
    rng = np.random.default_rng(4)
    d = np.concatenate([rng.integers(-300, 320, 4000) / 10.0, np.zeros(50)])
    df = spark.createDataFrame([("c", i, float(x), 0.0) for i, x in enumerate(d)], "config string, seed int, a double, b double").repartition(7)
    r = sig.wilcoxon(df, ["config"]).first()
    x = pd.Series(d[d != 0])
    rank, ties = x.abs().rank(), x.abs().value_counts()
    low, n = min(rank[x > 0].sum(), rank[x < 0].sum()), len(x)
    z = (n * (n + 1) / 4 - low) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties ** 3 - ties).sum() / 48)
    assert (r.n_nonzero, r.statistic) == (n, low) and r.wilcoxon_p == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_shapiro_small_samples(spark):
    rows = [("three", i, x, 0.0) for i, x in enumerate((1.0, 2.0, 4.0))] + [("two", i, float(i), 0.0) for i in range(2)]
    df = spark.createDataFrame(rows, "config string, seed int, a double, b double")
    got = {r.config: r for r in sig.shapiro(df, ["config"]).collect()}
    assert set(got) == {"three"}
    assert got["three"].w == pytest.approx(27 / 28, rel=1e-12)
    assert got["three"].shapiro_p == pytest.approx(6 / math.pi * (math.asin(math.sqrt(27 / 28)) - math.asin(math.sqrt(0.75))), rel=1e-9)


def test_distributions():
    assert float(dist.t_upper(2.0, 1)) == pytest.approx(0.5 - math.atan(2.0) / math.pi, rel=1e-13)
    assert float(dist.t_quantile(0.975, 9)) == pytest.approx(2.2621571627409915, rel=1e-10)
    assert float(dist.t_quantile(0.95, 29)) == pytest.approx(1.6991270265334972, rel=1e-10)
    assert float(dist.normal_upper(1.959963984540054)) == pytest.approx(0.025, rel=1e-12)


def test_holm_and_bh_leave_out_missing(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", None), ("d", float("nan")), ("e", 0.03)], "config string, p double").withColumn("f", F.lit(1))
    h = {r.config: r.h for r in sig.holm(df, "p", "h", ["f"], ["config"]).collect()}
    assert h == {"a": pytest.approx(0.03), "e": pytest.approx(0.06), "b": pytest.approx(0.06), "c": None, "d": None}
    one = {r.config: r.h for r in sig.holm(df, "p", "h", ["f"], ["config"], missing_as_one=True).collect()}
    assert one["a"] == pytest.approx(0.05) and one["c"] == 1.0
    b = {r.config: r.h for r in sig.benjamini_hochberg(df, "p", "h", ["f"], ["config"]).collect()}
    assert b == {"a": pytest.approx(0.03), "e": pytest.approx(0.04), "b": pytest.approx(0.04), "c": None, "d": None}


def test_tiers(spark):
    rows = [(0.001, 0.01), (0.04, 0.2), (0.08, 0.3), (0.5, 1.0), (None, None), (float("nan"), float("nan"))]
    df = spark.createDataFrame(rows, "t double, h double").select(tier("t", "h").alias("x"))
    assert [r.x for r in df.collect()] == ["robust", "suggestive", "marginal", "n.s.", "n.s.", "n.s."]


def test_contrasts(finals):
    cs = (("X", "w/o_spectral", "w/o_gating", ("accuracy",)), ("Y", "w/o_fusion", "full", ("accuracy", "macro_f1")), ("Z", "absent", "full", ("accuracy",)))
    rows = {(r.contrast, r.metric): r for r in sig.contrast_table(finals, cs).collect()}
    assert set(rows) == {("X", "accuracy"), ("Y", "accuracy"), ("Y", "macro_f1")}
    assert rows[("Y", "accuracy")].t_p == pytest.approx(RECORDED["w/o_fusion"][0], rel=1e-9)
    assert rows[("Y", "accuracy")].holm_p_t == pytest.approx(RECORDED["w/o_fusion"][0], rel=1e-9)


def test_spearman_perfect_and_short(spark):
    rows = [("up", float(i), float(i * i)) for i in range(6)] + [("few", 1.0, 2.0), ("few", 2.0, 1.0)] + [("flat", 1.0, float(i)) for i in range(4)]
    got = {r.g: r for r in sig.spearman(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert got["up"].rho == pytest.approx(1.0) and got["up"].p == 0.0
    assert got["few"].rho is None and got["few"].p is None and got["flat"].rho is None


def test_merge_and_gaps(spark, finals):
    extra = finals.filter("seed > 49").withColumn("accuracy", F.lit(9.0)).unionByName(
        spark.createDataFrame([("full", 99, 0.1, 0.2)], finals.schema))
    m = reports.merge_runs(finals, extra)
    assert m.count() == 51 and m.filter("accuracy = 9.0").count() == 10
    done = finals.filter("NOT (config = 'full' AND seed = 42)")
    missing = reports.missing_runs(grids.config_grid(spark, only=["full", "w/o_spectral", "full_r1"]), finals, done)
    assert missing.count() == 11 and missing.filter("config = 'full'").first().seed == 42
    cov = reports.seed_coverage(done)
    assert [(r.config, r.seeds, r.most) for r in cov.collect()] == [("full", 9, 10)]


def test_degradation_modes(spark):
    rows = [("full", 1, 0.9, {"drift": 0.8, "other": 0.5}), ("full", 2, 1.0, {"drift": 0.8}), ("x", 1, 0.5, {"drift": 0.5}), ("none", 1, 0.3, {})]
    df = spark.createDataFrame(rows, "config string, seed int, accuracy double, degradation map<string,double>")
    means = reports.degradation_means(reports.degradation_rows(df))
    avg = {r.degradation: r.delta_pp for r in reports.degradation_table(means).collect()}
    base = {r.degradation: r.delta_pp for r in reports.degradation_table(means, "baseline").collect()}
    assert avg == {"clean": 0.0, "drift": -7.5, "other": -45.0} and base == {"clean": 0.0, "drift": -15.0, "other": -45.0}
    wide = reports.degradation_pivot(reports.degradation_table(means), ["full", "x"]).collect()
    assert [r.degradation for r in wide] == ["clean", "drift", "other"] and wide[0].full == "0.9500±0.0707" and wide[2].x is None
    with pytest.raises(ValueError):
        reports.degradation_table(means, "other")


def test_early_stopping(spark):
    acc = [0.1, 0.5, 0.5, 0.4, 0.6, 0.2, 0.3, 0.1, 0.9]
    df = spark.createDataFrame([("c", 1, i, a) for i, a in enumerate(acc)], "config string, seed int, epoch int, val_acc double")
    r = ep.early_stopping(df, 3).first()
    assert (r.best_epoch, r.best_value, r.last_epoch, r.epochs_run, r.stopped) == (4, 0.6, 7, 8, True)
    r = ep.early_stopping(df, 10).first()
    assert (r.best_epoch, r.epochs_run, r.stopped) == (8, 9, False)


def test_balancing(spark):
    df = spark.createDataFrame([("c", 1, i, 0.8, 0.4 + 0.1 * i) for i in range(3)], "config string, seed int, epoch int, acc_t_aux double, acc_f_aux double")
    rows = ep.balancing_coefficients(df).orderBy("epoch").collect()
    assert rows[0].coef_t == pytest.approx(2 * 0.4 / 1.2, rel=1e-6) and rows[1].ema_f == pytest.approx(0.41)
    assert all(r.coef_t + r.coef_f == pytest.approx(2.0, rel=1e-7) for r in rows)


def test_routing_advice(spark):
    rows = [("bias", 0.2, 1.0), ("bias", 0.1, 1.0), ("drift", 0.2, 1.0), ("gaussian_noise_snr10", 0.2, 1.0), ("none", 0.2, 1.0),
            ("none", 0.1, 4.0), ("none", 0.1, 1.0), ("none", 0.1, 0.5), ("none", None, None)]
    df = spark.createDataFrame(rows, "d string, s double, r double")
    assert [x[0] for x in df.select(reports.routing_advice("s", "r", "d")).collect()] == [
        "spectral-only", "full", "full with warning", "spectral-free", "responsive", "temporal dominates", "balanced", "spectral dominates", "spectral-free"]


def test_smoothing_is_the_recursion(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    for momentum, n in ((0.9, 5000), (0.5, 1200), (0.999, 600)):
        at = sorted(rng.choice(200_000, n, replace=False).tolist())
        x = rng.random(n)
        rows = [("a", 1, int(e), float(v)) for e, v in zip(at, x)] + [("b", 1, 7, 0.25)]
        df = spark.createDataFrame(rows, "config string, seed int, epoch int, x double").repartition(3)
        want, e = [], x[0]
        for v in x:
            e = momentum * e + (1 - momentum) * v
            want.append(e)
        got = [r.y for r in ep.smoothed(df, {"y": "x"}, momentum).filter("config = 'a'").orderBy("epoch").collect()]
        assert np.allclose(got, want, rtol=1e-12)
        assert [r.y for r in ep.smoothed(df, {"y": "x"}, momentum).filter("config = 'b'").collect()] == pytest.approx([0.25])
    gaps = spark.createDataFrame([("a", 1, 1, 0.2, 0.4), ("a", 1, 2, None, 0.3), ("a", 1, 3, 0.4, 0.4)], "config string, seed int, epoch int, acc_t_aux double, acc_f_aux double")
    assert [r.epoch for r in ep.balancing_coefficients(gaps).orderBy("epoch").collect()] == [1, 3]


def test_signed_rank_law_without_a_switch(spark):
    import itertools

    import numpy as np

    from gaugeflow.functions.distributions import ranks_of, signed_rank_p

    assert ranks_of(5, [(3, 2), (9, 2)]).tolist() == [3, 3, 6, 9, 9]
    ranks = ranks_of(6, [(4, 3)])
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=6)]
    for pos in set(sums):
        want = min(1.0, 2 * min(np.mean([s <= pos for s in sums]), np.mean([s >= pos for s in sums])))
        assert signed_rank_p(ranks, int(pos)) == pytest.approx(want)
    rows = [("x", i, 0.5 + (i % 7 - 2) / 50, 0.5) for i in range(1200)]
    df = spark.createDataFrame(rows, "config string, seed int, a double, b double")
    exact, normal, auto = (sig.wilcoxon(df, ["config"], method).first().wilcoxon_p for method in ("exact", "normal", "auto"))
    assert auto == normal and 0 < exact < 1e-3 and abs(np.log(exact) - np.log(normal)) < 0.5 * abs(np.log(normal))
    with pytest.raises(ValueError):
        sig.wilcoxon(df, ["config"], "guess")
