"""Ablation grid: one classifier per (configuration, seed) on window features.

Configurations choose the feature families. A model is a table of moments per class, channel and feature
(Gaussian naive Bayes), so one aggregate over the clean training windows fits every configuration, and each
degraded test window is scored inside its rows; every run ends as one row of finals. Whole recordings are
train or test, so no recording is on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.functions.hashing import uniform
from gaugeflow.functions.scalars import array_mean, array_sum, array_var_pop
from gaugeflow.operators.degrade import all_degradations
from gaugeflow.operators.evaluation import accuracy_macro_f1
from gaugeflow.operators.spectral import magnitude_spectrum

# Which feature families a configuration uses.
FAMILIES = {"full": ("temporal", "spectral"), "w/o_spectral": ("temporal",), "w/o_temporal": ("spectral",)}
VARIANCE_FLOOR = 1e-6


def temporal_features():
    """Mean, deviation, extremes, slope and lag-one product of a series."""
    s, n = F.col("series"), F.size("series")
    pairs = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: a * b)
    trend = F.aggregate(F.transform(s, lambda v, i: v * (i - (n - 1) / 2.0)), F.lit(0.0), lambda a, x: a + x)
    return F.array(array_mean(s), F.sqrt(array_var_pop(s)), F.array_min(s), F.array_max(s), trend / n, array_mean(pairs))


def _with_features(windows: DataFrame) -> DataFrame:
    return windows.select("*", temporal_features().alias("temporal"), magnitude_spectrum("series").alias("spectral")).drop("series")


def moments(features: DataFrame, label: str) -> DataFrame:
    """(class, channel, family, feature, n, mean, variance) of feature rows, in one small shuffle."""
    families = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("values")) for f in ("temporal", "spectral")])).alias("f")
    long = features.select(F.col(label).alias("class"), "channel", families).select(
        "class", "channel", "f.family", F.posexplode("f.values").alias("feature", "value"))
    return long.groupBy("class", "channel", "family", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") + VARIANCE_FLOOR).alias("variance"))


def model(stats: DataFrame) -> DataFrame:
    """The moments as one value: per channel the classes in order, each with its number of windows and its features.

    Its size is channels x classes x features of a window, whatever the number of windows.
    """
    fam = stats.groupBy("channel", "class", "family").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("feature", "mean", "variance", F.ln("variance").alias("log")))).alias("m"))

    def of(family):
        return F.max(F.when(F.col("family") == family, F.col("m"))).alias(family)

    per = fam.groupBy("channel", "class").agg(F.max("n").alias("n"), of("temporal"), of("spectral"))
    rows = per.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("class", "n", "temporal", "spectral"))).alias("classes"))
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("channel", "classes"))).alias("model"))


def log_likelihood(values: Column, known: Column) -> Column:
    """Of a row's features under the moments of one class, without the constant."""
    return array_sum(F.zip_with(values, known, lambda v, m: -0.5 * (m["log"] + (v - m["mean"]) * (v - m["mean"]) / m["variance"])))


def scores(features: DataFrame, fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per window: the classes in order with their numbers of training windows, and the log-likelihoods of
    both families under each, summed over channels. Every window has every channel. Only numbers are shuffled; the
    classes are looked up again."""
    known = features.withColumn("known", F.element_at(fitted.scalar(), F.col("channel")))

    def under_each(family):
        return F.transform("known", lambda c: log_likelihood(F.col(family), c[family])).alias(family)

    rows = known.select(*keys, "channel", under_each("temporal"), under_each("spectral"))
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("channel", "temporal", "spectral"))).alias("by_channel"))
    first = F.col("by_channel")[0]

    def summed(family):
        return F.transform(first[family], lambda _, k: array_sum(F.transform("by_channel", lambda b: F.get(b[family], k)))).alias(family)

    whole = whole.filter(first["temporal"].isNotNull()).withColumn("known", F.element_at(fitted.scalar(), first["channel"]))
    classes = F.transform("known", lambda c: F.struct(c["class"].alias("class"), c["n"].alias("n")))
    return whole.select(*keys, classes.alias("classes"), summed("temporal"), summed("spectral"))


def audit(windows: DataFrame, label: str, window: str, seeds: Sequence[int], configs: Sequence[str] = tuple(FAMILIES),
          test_share: float = 0.3, run: str | None = None, channels: Sequence[str] | None = None) -> DataFrame:
    """Finals (config, seed, accuracy, macro_f1, degradation map) of the whole grid.

    ``run`` names the recording of a window; without it each window is its own. Nothing is fitted before the result
    is asked for, and no model reaches the driver. A seed that leaves train or test without a recording has no row.
    """
    unknown = sorted(set(configs) - set(FAMILIES))
    if unknown:
        raise ValueError(f"unknown configurations: {unknown}")
    out = None
    for seed in seeds:
        test = uniform(run or window, seed) < test_share
        fitted = model(moments(_with_features(windows.filter(~test)), label))
        faulty = all_degradations(windows, [window], seed, channels=channels).filter(test)
        scored = scores(_with_features(faulty), fitted, ["degradation", window, label])
        total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, c: a + c["n"])

        def guess(config):
            sums = F.transform("classes", lambda c, k: F.ln(c["n"] / total) + sum(F.get(F.col(f), k) for f in FAMILIES[config]))
            best = F.array_position(sums, F.array_max(sums)).cast("int") - 1  # the first of equals, in class order
            return F.struct(F.lit(config).alias("config"), F.get("classes", best)["class"].alias("y_pred"))

        preds = scored.select("degradation", F.col(label).alias("y_true"), F.explode(F.array(*[guess(c) for c in configs])).alias("g"))
        acc = accuracy_macro_f1(preds.select("degradation", "y_true", "g.*"), ["config", "degradation"])
        clean = F.col("degradation") == "clean"
        rows = acc.groupBy("config").agg(
            F.max(F.when(clean, F.col("accuracy"))).alias("accuracy"), F.max(F.when(clean, F.col("macro_f1"))).alias("macro_f1"),
            F.map_from_entries(F.collect_list(F.when(~clean, F.struct("degradation", "accuracy")))).alias("degradation"),
        ).select("config", F.lit(seed).alias("seed"), "accuracy", "macro_f1", "degradation")
        out = rows if out is None else out.unionByName(rows)
    return out
