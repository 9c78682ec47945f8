"""Diagnostics of routing weights and gates, and fusion of two score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeflow.functions.hashing import key_hash
from gaugeflow.functions.scalars import EPS, array_sum, array_var_pop, binary_entropy, let, sigmoid
from gaugeflow.operators.ranking import counted_ranks

HISTOGRAM_BINS = 60
SATURATED = 0.9


def routing_entropy(alpha: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean two-way entropy over every element; arrays are folded before the shuffle."""
    h = F.aggregate("series", F.lit(0.0), lambda acc, a: acc + binary_entropy(a))
    return alpha.groupBy(*group).agg((F.sum(h) / F.sum(F.size("series"))).alias("entropy"))


def temporal_variance(alpha: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Variance over time of each (window, channel), averaged."""
    return alpha.groupBy(*group).agg(F.avg(array_var_pop("series")).alias("temporal_variance"))


def window_means(alpha: DataFrame, window: str, label: str = "class") -> DataFrame:
    """Mean weight of each window over its channels and time."""
    return (
        alpha.groupBy(window, label)
        .agg(F.sum(array_sum("series")).alias("s"), F.sum(F.size("series")).alias("n"))
        .select(window, label, (F.col("s") / F.col("n")).alias("alpha"))
    )


def class_means(means: DataFrame, label: str = "class") -> DataFrame:
    return means.groupBy(label).agg(F.avg("alpha").alias("alpha_mean"), F.count(F.lit(1)).alias("windows"))


def global_and_class_means(means: DataFrame, label: str = "class") -> DataFrame:
    """One row per class and one, with scope "global", over all windows."""
    return means.rollup(label).agg(
        F.grouping(label).alias("_all"), F.avg("alpha").alias("alpha_mean"), F.count(F.lit(1)).alias("windows")
    ).select(F.when(F.col("_all") == 1, "global").otherwise("class").alias("scope"), label, "alpha_mean", "windows")


def class_profile(means: DataFrame, label: str = "class") -> DataFrame:
    """Mean and sample deviation of window means per class in lower-case name order, with
    the lowest, highest and spread of the class means."""
    per = means.groupBy(label).agg(
        F.avg("alpha").alias("alpha_mean"), F.coalesce(F.stddev_samp("alpha"), F.lit(0.0)).alias("alpha_std"),
        F.count(F.lit(1)).alias("windows"))
    every = Window.partitionBy()  # one row per class
    lo, hi = F.min("alpha_mean").over(every), F.max("alpha_mean").over(every)
    return per.select("*", lo.alias("band_min"), hi.alias("band_max"), (hi - lo).alias("band_spread")).orderBy(F.lower(label), label)


def gate_saturation(gates: DataFrame, group: Sequence[str] = (), tau: float = SATURATED) -> DataFrame:
    """Share of gate values strictly above ``tau``."""
    over = F.aggregate("series", F.lit(0).cast("long"), lambda acc, g: acc + F.when(g > tau, 1).otherwise(0))
    return gates.groupBy(*group).agg((F.sum(over) / F.sum(F.size("series"))).alias("saturation"))


def histogram(alpha: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal bins over [0, 1]; the last bin includes 1."""
    values = alpha.select(F.explode("series").alias("a")).filter("a BETWEEN 0 AND 1")
    b = F.least(F.lit(bins - 1), F.floor(F.col("a") * bins)).cast("int")
    return values.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("elements"))


def exact_quantiles(values: DataFrame, value: str, probs: Sequence[float], lo: float, hi: float,
                    cells: int = 65536) -> DataFrame:
    """Exact quantiles (linear interpolation) of a column with values in [lo, hi].

    Counting values in narrow cells finds the few cells that hold the wanted ranks; only
    their distinct values are then ordered, and a cell with very many of them is cut again by
    its own values. Nothing gathers the column, even when all values crowd into one cell.
    """
    spark = values.sparkSession
    cell = F.least(F.lit(cells - 1), F.floor((F.col(value) - lo) / ((hi - lo) / cells))).cast("int")
    placed = values.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"), cell.alias("cell"))
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    run = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # at most `cells` rows
    edges = counts.select("cell", "n", F.sum("n").over(run).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("rows"))
    wanted = edges.select("cell", (F.col("upto") - F.col("n")).alias("before"), "upto", "rows",
                          F.explode(F.array(*[F.lit(p) for p in probs])).alias("prob"))
    at = F.col("prob") * (F.col("rows") - 1)
    picks = wanted.withColumn("rank", F.explode(F.array(F.floor(at), F.ceil(at)))).withColumn(
        "frac", at - F.floor(at)).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))
    picks = picks.distinct()
    distinct = placed.join(picks.select("cell").distinct(), "cell").groupBy("cell", "v").agg(F.count(F.lit(1)).alias("c"))
    ranked = counted_ranks(distinct, ["cell"], "v", "c").select("cell", "v", "c", F.col("before").alias("_below"))
    at = F.col("rank") - F.col("before")
    hit = picks.join(ranked, "cell").filter((at >= F.col("_below")) & (at < F.col("_below") + F.col("c")))
    return hit.groupBy("prob").agg(
        (F.min("v") + (F.max("v") - F.min("v")) * F.first("frac")).alias("quantile"))


def moving_average_variance(series: Column, width: int = 3) -> Column:
    """Variance over time of a short moving average: depends on the order of the samples."""

    def smooth(s):
        parts = [F.slice(s, j + 1, F.size(s) - width + 1) for j in range(width)]
        total = parts[0]
        for p in parts[1:]:
            total = F.zip_with(total, p, lambda a, b: a + b)
        return array_var_pop(F.transform(total, lambda x: x / width))

    return let(series, smooth)


def permuted_series(series: Column, row: Sequence, replicate: Column, seed: int) -> Column:
    """The series in a random time order, the same for all channels of a window."""
    keyed = F.transform(series, lambda v, i: F.struct(key_hash(*row, replicate, i, seed).alias("h"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def permutation_null(windows: DataFrame, row: Sequence[str], replicates: int, seed: int,
                     statistic=moving_average_variance) -> DataFrame:
    """Observed statistic, its null distribution under shuffled time, and z.

    Replicates are extra rows of the same tasks, reduced on the map side; replicate 0 is the
    observed order, so the windows are read once. z is NULL where it would be 0/0.
    """
    reps = windows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    s = F.col("series")
    shuffled = F.when(F.col("replicate") == 0, s).otherwise(permuted_series(s, row, F.col("replicate"), seed))
    stats = reps.withColumn("series", shuffled).groupBy("replicate").agg(F.avg(statistic(s)).alias("stat"))
    observed = F.max(F.when(F.col("replicate") == 0, F.col("stat"))).over(Window.partitionBy())  # one row per replicate
    return null_summary(stats.withColumn("observed", observed).filter("replicate > 0"))


def null_summary(null: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Rows (replicate, stat, observed) to observed, null mean and deviation, and z."""
    m = null.groupBy(*group).agg(
        F.max("observed").alias("observed"), F.avg("stat").alias("null_mean"),
        F.coalesce(F.stddev_samp("stat"), F.lit(0.0)).alias("null_std"))
    gap = F.col("observed") - F.col("null_mean")
    degenerate = (F.col("null_std") < EPS) & (F.abs(gap) < EPS)
    return m.withColumn("z", F.when(~degenerate, gap / (F.col("null_std") + EPS)))


def load_balance(alpha: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """2 * sum over the two experts of mean probability times share of choices; a tie
    counts for the first expert."""
    p = F.sum(array_sum("series"))
    u = F.sum(F.aggregate("series", F.lit(0.0), lambda acc, a: acc + F.when(a >= 1.0 - a, 1.0).otherwise(0.0)))
    n = F.sum(F.size("series"))
    return alpha.groupBy(*group).agg(
        (2.0 * ((p / n) * (u / n) + (1.0 - p / n) * (1.0 - u / n))).alias("balance"))


def softmax_over(df: DataFrame, group: Sequence[str], score: str, out: str = "p") -> DataFrame:
    w = Window.partitionBy(*group)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return df.withColumn(out, e / F.sum(e).over(w))


def _running(group: Sequence[str], score: str, tie: Sequence[str]):
    return Window.partitionBy(*group).orderBy(F.desc(score), *tie).rowsBetween(Window.unboundedPreceding, 0)


def sparsemax_over(df: DataFrame, group: Sequence[str], score: str, tie: Sequence[str], out: str = "p") -> DataFrame:
    """Projection of a group's scores on the probability simplex (exact zeros).

    The group is one window's classes or channels, so it stays small.
    """
    w = _running(group, score, tie)
    d = df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), *tie)))
    d = d.withColumn("_cum", F.sum(score).over(w))
    inside = 1.0 + F.col("_k") * F.col(score) > F.col("_cum")
    tau = F.max_by(F.when(inside, (F.col("_cum") - 1.0) / F.col("_k")), F.when(inside, F.col("_k"))).over(
        Window.partitionBy(*group))
    return d.withColumn(out, F.greatest(F.col(score) - tau, F.lit(0.0))).drop("_k", "_cum")


def entmax15_over(df: DataFrame, group: Sequence[str], score: str, tie: Sequence[str], out: str = "p") -> DataFrame:
    """Entmax with exponent 1.5: squared distance above the threshold that makes the sum 1."""
    w = _running(group, "_x", tie)
    d = df.withColumn("_x", F.col(score) / 2.0)
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_x"), *tie)))
    d = d.withColumn("_m", F.avg("_x").over(w)).withColumn("_q", F.avg(F.col("_x") * F.col("_x")).over(w))
    var = F.col("_q") - F.col("_m") * F.col("_m")
    room = (1.0 - F.col("_k") * var) / F.col("_k")
    d = d.withColumn("_tau", F.when(room >= 0, F.col("_m") - F.sqrt(F.greatest(room, F.lit(0.0)))))
    inside = F.col("_tau") <= F.col("_x")
    tau = F.max_by(F.when(inside, F.col("_tau")), F.when(inside, F.col("_k"))).over(Window.partitionBy(*group))
    over = F.greatest(F.col("_x") - tau, F.lit(0.0))
    return d.withColumn(out, over * over).drop("_x", "_k", "_m", "_q", "_tau")


def norm_ratio(df: DataFrame, part: str, value: str, first: str, second: str, group: Sequence[str] = ()) -> DataFrame:
    """Length of one part's values over the other's."""
    def norm(name):
        return F.sqrt(F.coalesce(F.sum(F.when(F.col(part) == name, F.col(value) * F.col(value))), F.lit(0.0)))

    return df.groupBy(*group).agg(norm(first).alias("norm_a"), norm(second).alias("norm_b")).withColumn(
        "ratio", F.col("norm_a") / (F.col("norm_b") + EPS))


def fuse(scores: DataFrame, alpha: Column) -> DataFrame:
    """Weighted mean of the columns s_t and s_f; a weight outside [0, 1] fails the job."""
    a = F.when((alpha >= 0) & (alpha <= 1), alpha).otherwise(
        F.raise_error(F.concat(F.lit("fusion weight outside [0, 1]: "), alpha.cast("string"))))
    return scores.withColumn("score", a * F.col("s_t") + (1.0 - a) * F.col("s_f"))


def join_branches(temporal: DataFrame, spectral: DataFrame, keys: Sequence[str]) -> DataFrame:
    return temporal.select(*keys, F.col("score").alias("s_t")).join(
        spectral.select(*keys, F.col("score").alias("s_f")), list(keys))


def class_weights(scores: DataFrame, means: DataFrame, label: str = "class") -> DataFrame:
    """Attaches the fixed weight of the true class; a class without one fails the job."""
    joined = scores.join(means, label, "left")
    return joined.withColumn("alpha", F.coalesce(
        "alpha", F.raise_error(F.concat(F.lit("no weight for class "), F.col(label).cast("string")))))


def two_expert_weight(logit, temperature: float = 1.0, paired: bool = False) -> Column:
    """Soft probability of the first expert; ``paired`` uses the two scores (x, -x)."""
    x = (F.col(logit) if isinstance(logit, str) else logit) / max(temperature, 1e-6)
    return sigmoid(2.0 * x) if paired else sigmoid(x)


def route_hard(alpha: Column, s_t: Column, s_f: Column) -> Column:
    return F.when(alpha >= 0.5, s_t).otherwise(s_f)


def argmax_class(scores: DataFrame, keys: Sequence[str], label: str = "class", score: str = "score",
                 out: str = "y_pred") -> DataFrame:
    """Best class per window, the lowest label on a tie."""
    return scores.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col(score), F.col(label))).alias(out))
