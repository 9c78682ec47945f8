"""Report tables over per-seed results (cell, config, seed, metrics)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeflow.functions.scalars import finite, mean_std_text, percent_points, std_or_zero
from gaugeflow.operators.degrade import DEGRADATIONS
from gaugeflow.operators.epochs import RHO_THRESHOLD

# Thresholds of the two warning signs, and the seeds every cell has.
SATURATION_THRESHOLD = 0.15
BALANCED_SEEDS = (42, 51)
INDICATORS = ("H_alpha", "alpha_tvar", "S_tau", "rho_last", "perm_null_z")


def results_table(finals: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    """Mean and sample deviation of both scores per configuration, with the seeds used."""
    acc, f1 = finite("accuracy"), finite("macro_f1")
    t = finals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        # the seeds of one configuration: as many as the experiment was repeated
        F.array_join(F.transform(F.array_sort(F.collect_set("seed")), lambda s: s.cast("string")), ",").alias("seeds"),
        F.avg(acc).alias("accuracy_mean"), std_or_zero(acc).alias("accuracy_std"),
        F.avg(f1).alias("macro_f1_mean"), std_or_zero(f1).alias("macro_f1_std"))
    return t


def formatted_results(results: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    return results.select(
        *keys, mean_std_text("accuracy_mean", "accuracy_std").alias("accuracy"),
        mean_std_text("macro_f1_mean", "macro_f1_std").alias("macro_f1"))


def indicator_table(finals: DataFrame, indicators: Sequence[str] = INDICATORS, keys: Sequence[str] = ("config",)) -> DataFrame:
    """Means of the run indicators over the runs that define them."""
    return finals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(finite("accuracy")).alias("accuracy_mean"),
        *[F.avg(finite(i)).alias(i) for i in indicators])


def null_table(finals: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    """Averages of the permutation-null records with the threshold mean + 2 deviations."""
    d = finals.filter("observed_var IS NOT NULL")
    return d.groupBy(*keys).agg(
        F.avg("observed_var").alias("observed_var"), F.avg("null_mean").alias("null_mean"),
        F.avg("null_std").alias("null_std"),
        F.avg(F.col("null_mean") + 2.0 * F.col("null_std")).alias("threshold"),
        F.avg(finite("z")).alias("z_mean"))


def degradation_rows(finals: DataFrame, column: str = "degradation", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, config, seed, degradation, accuracy) from the map of degraded accuracies, clean included."""
    every = F.map_concat(F.create_map(F.lit("clean"), F.col("accuracy")), F.col(column))
    d = finals.filter(F.size(column) > 0)
    return d.select(*keys, "config", "seed", F.explode(every).alias("degradation", "accuracy"))


def degradation_means(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, "degradation", "config").agg(
        F.avg("accuracy").alias("mean"), std_or_zero(F.col("accuracy")).alias("std"), F.count(F.lit(1)).alias("n"))


def degradation_table(means: DataFrame, mode: str = "average", baseline: str = "full", keys: Sequence[str] = ()) -> DataFrame:
    """Long table with the loss against clean in percentage points.

    ``average`` averages the loss over configurations, ``baseline`` takes one configuration.
    """
    if mode not in ("average", "baseline"):
        raise ValueError(f"unknown mode {mode!r}")
    # the table of means has one row per configuration and degradation: windows are short
    clean = F.max(F.when(F.col("degradation") == "clean", F.col("mean"))).over(Window.partitionBy(*keys, "config"))
    loss = means.withColumn("_loss", F.col("mean") - clean)
    counted = F.when(F.col("config") == baseline, F.col("_loss")) if mode == "baseline" else F.col("_loss")
    delta = percent_points(F.avg(counted).over(Window.partitionBy(*keys, "degradation")))
    return loss.withColumn("delta_pp", delta).drop("_loss")


def degradation_order(name="degradation") -> Column:
    """Clean first, then the known faults in their order, then others."""
    known = ("clean", *DEGRADATIONS)
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in known]), F.col(name)), F.lit(0)), F.lit(len(known) + 1))


def degradation_pivot(table: DataFrame, configs: Sequence[str]) -> DataFrame:
    """One row per degradation, one "mean±std" column per configuration."""
    return (
        table.withColumn("cell_text", mean_std_text("mean", "std"))
        .groupBy("degradation", F.col("delta_pp").alias("delta_vs_clean_pp")).pivot("config", list(configs)).agg(F.max("cell_text"))
        .orderBy(degradation_order(), "degradation"))


def drop_and_gain(means: DataFrame, baseline: str, other: str, cell: str = "cell") -> DataFrame:
    """Per cell and degradation: the baseline's loss against clean, and the gain of another
    configuration over it, in percentage points."""
    wide = means.groupBy(cell, "degradation").agg(
        F.max(F.when(F.col("config") == baseline, F.col("mean"))).alias("f"),
        F.max(F.when(F.col("config") == other, F.col("mean"))).alias("o"))
    clean = F.max(F.when(F.col("degradation") == "clean", F.col("f"))).over(Window.partitionBy(cell))
    return wide.withColumn("c", clean).filter("degradation <> 'clean'").select(
        cell, "degradation", ((F.col("c") - F.col("f")) * 100).alias("drop_pp"), ((F.col("o") - F.col("f")) * 100).alias("gain_pp"))


def change_against(results: DataFrame, baseline: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy change of each configuration against the baseline in percentage points."""
    base = F.max(F.when(F.col("config") == baseline, F.col("accuracy_mean"))).over(Window.partitionBy(*keys))
    return results.withColumn("_b", base).filter(F.col("config") != baseline).select(*keys, "config", percent_points(F.col("accuracy_mean") - F.col("_b")).alias("change_pp"))


def regime_map(epochs: DataFrame, finals: DataFrame, config: str = "full", epoch: int = 3, cell: str = "cell") -> DataFrame:
    """Where each cell's runs start (an early epoch) and end in (rho, saturation)."""
    early = epochs.filter((F.col("config") == config) & (F.col("epoch") == epoch)).groupBy(cell).agg(
        F.avg("rho").alias("rho_early"), F.avg("s_tau").alias("s_early"))
    late = finals.filter(F.col("config") == config).groupBy(cell).agg(
        F.avg("rho_last").alias("rho_final"), F.avg("S_tau").alias("s_final"))
    return early.join(late, cell)


def ordered_by(df: DataFrame, names: Sequence[str], column: str = "config") -> DataFrame:
    """Keeps the named rows and adds their position in the list."""
    dim = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"{column} string, position int")
    return df.join(F.broadcast(dim), column)


def forest_table(significance: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Differences and intervals in percentage points; does the interval leave out zero?"""
    d = ordered_by(significance, order)
    return d.select(
        *keys, "config", "position", (F.col("mean_diff") * 100).alias("diff_pp"), (F.col("ci95_lo") * 100).alias("lo_pp"),
        (F.col("ci95_hi") * 100).alias("hi_pp"), ((F.col("ci95_lo") > 0) | (F.col("ci95_hi") < 0)).alias("excludes_zero"))


def results_with_tests(results: DataFrame, tests: DataFrame, order: Sequence[str], baseline: str) -> DataFrame:
    """Results in a fixed order, each with its test columns; the baseline has none."""
    t = tests.filter(F.col("config") != baseline)
    return ordered_by(results, order).join(t, "config", "left")


def warning_rates(finals: DataFrame, config: str = "full", seeds: tuple[int, int] = BALANCED_SEEDS, cell: str = "cell") -> DataFrame:
    """How many runs show each warning sign, for the seeds all cells share and for all."""
    d = finals.filter(F.col("config") == config)
    tags = F.array(F.when(F.col("seed").between(*seeds), F.lit("balanced")), F.lit("all_available"))
    ok = finite("S_tau").isNotNull() & finite("rho_last").isNotNull()
    d1, d2 = ok & (F.col("S_tau") > SATURATION_THRESHOLD), ok & (F.col("rho_last") > RHO_THRESHOLD)

    def n(c):
        return F.count(F.when(c, 1))

    out = d.withColumn("subset", F.explode(F.filter(tags, lambda t: t.isNotNull()))).groupBy("subset").agg(
        n(ok).alias("n_runs"), F.array_join(F.array_sort(F.collect_set(cell)), ",").alias("cells"),
        n(d1).alias("n_d1"), n(d2).alias("n_d2"), n(d1 & d2).alias("n_both"))
    for c in ("d1", "d2", "both"):
        out = out.withColumn(f"rate_{c}", F.try_divide(f"n_{c}", "n_runs"))
    return out


def routing_advice(s_tau, rho, degradation) -> Column:
    """Advice for a run under a kind of degradation, from its two indicators."""
    s, r, d = F.col(s_tau), F.col(rho), F.col(degradation)
    responsive = s > SATURATION_THRESHOLD
    noisy = d.startswith("gaussian_noise") | (d == "dropout")
    return (
        F.when(noisy, "spectral-free")
        .when((d == "bias") & responsive, "spectral-only")
        .when(d == "bias", "full")
        .when(d == "drift", "full with warning")
        .when(responsive, "responsive")
        .when(r > 3.0, "temporal dominates")
        .when(r < 0.8, "spectral dominates")
        .when(r.isNotNull(), "balanced")
        .otherwise("spectral-free")
    )


def per_seed_matrix(finals: DataFrame, seeds: Sequence[int], preferred: Sequence[str] = ()) -> DataFrame:
    """Scores in percent, one row per (config, metric), one column per seed, plus mean and deviation."""
    long = finals.select("config", "seed", (F.col("accuracy") * 100).alias("Acc"), (F.col("macro_f1") * 100).alias("F1")).unpivot(
        ["config", "seed"], ["Acc", "F1"], "metric", "value")
    wide = long.groupBy("config", "metric").pivot("seed", list(seeds)).agg(F.round(F.avg("value"), 2))
    stats = long.groupBy("config", "metric").agg(F.avg("value").alias("mean"), std_or_zero(F.col("value")).alias("std"))
    names = F.array(*[F.lit(p) for p in preferred]).cast("array<string>")
    place = F.coalesce(F.nullif(F.array_position(names, F.col("config")), F.lit(0)), F.lit(len(preferred) + 1))
    return wide.join(stats, ["config", "metric"]).withColumn("place", place.cast("long")).orderBy("place", "config", "metric")


def seed_by_cell(finals: DataFrame, value: str, cells: Sequence[str], config: str = "full", cell: str = "cell") -> DataFrame:
    """One indicator, seeds down and cells across, with rows of means and deviations."""
    d = finals.filter(F.col("config") == config)

    label = F.explode(F.array(F.col("seed").cast("string"), F.lit("Mean"), F.lit("SD")))
    text = d.select(cell, label.alias("seed"), value)

    def at(name):
        return F.when(F.col(cell) == name, F.col(value))

    return text.groupBy("seed").agg(*[
        F.when(F.max("seed") == "SD", F.when(F.count(at(c)) > 0, F.coalesce(F.stddev_samp(at(c)), F.lit(0.0)))).otherwise(F.avg(at(c))).alias(c)
        for c in cells])


def seed_coverage(finals: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    """Configurations with fewer seeds than the best covered one."""
    n = finals.groupBy(*keys).agg(F.count_distinct("seed").alias("seeds"))
    return n.withColumn("most", F.max("seeds").over(Window.partitionBy())).filter(F.col("seeds") < F.col("most"))


def merge_runs(primary: DataFrame, extra: DataFrame, keys: Sequence[str] = ("config", "seed")) -> DataFrame:
    """Union in which the extra run wins where both have one."""
    cols = [c for c in primary.columns if c not in keys]
    both = primary.withColumn("_rank", F.lit(1)).unionByName(extra.withColumn("_rank", F.lit(0)))
    best = both.groupBy(*keys).agg(F.min_by(F.struct(*cols), "_rank").alias("_r"))
    return best.select(*keys, "_r.*")


def borrow_baseline(runs: DataFrame, other: DataFrame, baseline: str) -> DataFrame:
    """Adds another table's baseline runs for seeds that have none here."""
    have = runs.filter(F.col("config") == baseline).select("config", "seed")
    return runs.unionByName(other.filter(F.col("config") == baseline).join(have, ["config", "seed"], "left_anti"))


def missing_runs(configs: DataFrame, seeds: DataFrame, done: DataFrame) -> DataFrame:
    """(config, seed) pairs of the grid with no finished run.

    The seed list is one array value on each configuration, not a join of two tables.
    """
    listed = seeds.agg(F.array_sort(F.collect_set("seed")).alias("s"))
    grid = configs.select("config").withColumn("seed", F.explode(listed.scalar()))
    return grid.join(done.select("config", "seed"), ["config", "seed"], "left_anti")


def rerun_comparison(original: DataFrame, rerun: DataFrame, order: Sequence[str]) -> DataFrame:
    """Original against rerun: (config, metric, original, rerun, deviation, text in pp).

    Both sides are long (config, metric, value); accuracies deviate in percentage points.
    """
    a = original.withColumnRenamed("value", "original")
    b = rerun.withColumnRenamed("value", "rerun")
    both = ordered_by(a.join(b, ["config", "metric"], "full"), order)
    gap = F.col("rerun") - F.col("original")
    pp = (F.col("metric") == "accuracy") & gap.isNotNull()
    return both.select(
        "config", "metric", "original", "rerun", F.when(F.col("metric") == "accuracy", gap * 100).otherwise(gap).alias("deviation"),
        F.when(pp, F.format_string("%+.2fpp", gap * 100)).alias("text"))
