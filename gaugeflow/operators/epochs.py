"""Training curves: early stopping, trajectories, branch balancing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

RUN = ("config", "seed")
RHO_THRESHOLD = 1.5


def early_stopping(epochs: DataFrame, patience: int, run: Sequence[str] = RUN, metric: str = "val_acc") -> DataFrame:
    """Best epoch (the first with the highest value before the stop), the epoch training
    stopped at, and how many epochs ran. A run's epochs are few, so its window is small."""
    w = Window.partitionBy(*run).orderBy("epoch")
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | (F.col(metric) > before)
    d = epochs.select(*run, "epoch", metric).withColumn("_n", F.row_number().over(w)).withColumn("_better", better)
    last_best = F.last(F.when(F.col("_better"), F.struct("_n", "epoch", F.col(metric).alias("value"))), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_best", last_best).withColumn("_bad", F.col("_n") - F.col("_best._n"))
    stop = F.min(F.when(F.col("_bad") >= patience, F.col("_n"))).over(Window.partitionBy(*run))
    d = d.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("_n") <= F.col("_stop")))
    return d.groupBy(*run).agg(
        F.max_by("_best", "_n").alias("_b"), F.max("epoch").alias("last_epoch"), F.count(F.lit(1)).alias("epochs_run"),
        F.max(F.col("_stop").isNotNull()).alias("stopped"),
    ).select(*run, F.col("_b.epoch").alias("best_epoch"), F.col("_b.value").alias("best_value"), "last_epoch", "epochs_run", "stopped")


def last_value(epochs: DataFrame, value: str = "rho", run: Sequence[str] = RUN) -> DataFrame:
    return epochs.groupBy(*run).agg(F.max_by(value, "epoch").alias(f"{value}_last"))


def curve(epochs: DataFrame, value: str = "rho") -> DataFrame:
    """(config, seed, epoch, value) without missing values."""
    return epochs.filter(F.col(value).isNotNull()).select(*RUN, "epoch", value)


def mean_curve(epochs: DataFrame, values: Sequence[str] = ("rho",), group: Sequence[str] = ("config",)) -> DataFrame:
    """Seed average and sample deviation per epoch (0 for a single seed)."""
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_std")]
    return epochs.groupBy(*group, "epoch").agg(*aggs, F.count(F.lit(1)).alias("runs"))


def curve_summary(epochs: DataFrame, value: str = "rho", threshold: float = RHO_THRESHOLD, edge: int = 5,
                  group: Sequence[str] = ("config",)) -> DataFrame:
    """Median, share of epochs above the threshold, and means of the first and last epochs
    of the seed-averaged curve (one row per epoch, so the windows are short)."""
    c = epochs.filter(F.col(value).isNotNull()).groupBy(*group, "epoch").agg(F.avg(value).alias("v"))
    up = F.row_number().over(Window.partitionBy(*group).orderBy("epoch"))
    down = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("epoch")))
    c = c.withColumn("_up", up).withColumn("_down", down)
    return c.groupBy(*group).agg(
        F.median("v").alias("median"),
        (100.0 * F.avg(F.when(F.col("v") > threshold, 1.0).otherwise(0.0))).alias("above_pct"),
        F.avg(F.when(F.col("_up") <= edge, F.col("v"))).alias("first_mean"),
        F.avg(F.when(F.col("_down") <= edge, F.col("v"))).alias("last_mean"))


def early_epochs(epochs: DataFrame, upto: int = 15, config: str | None = None) -> DataFrame:
    d = epochs.filter(F.col("epoch") <= upto)
    return d.filter(F.col("config") == config) if config else d


def smoothed(epochs: DataFrame, values: dict[str, str], momentum: float, run: Sequence[str] = RUN) -> DataFrame:
    """(run, epoch, one column per value): e_1 = x_1, then e = momentum e + (1 - momentum) x along each run.

    A step is an affine map of the average so far, and maps compose, so the recursion is a scan: runs are cut into chunks of
    epochs, a chunk's rows are composed by one running sum scaled with powers of the momentum, and chunks hand each other their last value. The same
    sum composes the chunks of a run (one short row each), in stretches over which the powers stay in a double's range;
    beyond the stretch before, nothing is left that a double could hold. Values must not be NULL.
    """
    if not 0 < momentum < 1:
        raise ValueError("momentum must lie between 0 and 1")
    reach = max(2, int(230 / -math.log(momentum)))  # momentum ** reach is about 1e-100
    m = lambda k: F.pow(F.lit(momentum), k.cast("double"))
    rows = epochs.select(*run, "epoch", *[F.col(c).cast("double").alias(f"_x_{n}") for n, c in values.items()]).withColumn("_chunk", F.floor(F.col("epoch") / reach))
    at = Window.partitionBy(*run, "_chunk").orderBy("epoch")
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_j", F.row_number().over(at) - 1)
    for n in values:
        rows = rows.withColumn(f"_b_{n}", (1 - momentum) * m(F.col("_j")) * F.sum(F.col(f"_x_{n}") * m(-F.col("_j"))).over(upto))
    chunks = rows.groupBy(*run, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"), *[F.max_by(f"_b_{n}", "_j").alias(f"_b_{n}") for n in values], *[F.min_by(f"_x_{n}", "_j").alias(f"_x_{n}") for n in values])
    by = Window.partitionBy(*run).orderBy("_chunk")
    before = by.rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.withColumn("_end", F.sum("_n").over(before)).withColumn("_first", F.row_number().over(by) == 1)
    chunks = chunks.withColumn("_stretch", F.floor(F.col("_end") / reach))
    left = F.col("_end") - F.col("_stretch") * reach
    in_stretch = Window.partitionBy(*run, "_stretch").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*run).orderBy("_stretch").rangeBetween(Window.unboundedPreceding, -1)
    for n in values:
        # the first epoch seeds the average: it is what the run starts with, too
        b = F.col(f"_b_{n}") + F.when(F.col("_first"), m(F.col("_n")) * F.col(f"_x_{n}")).otherwise(0.0)
        chunks = chunks.withColumn(f"_p_{n}", m(left) * F.sum(b * m(-left)).over(in_stretch))
        last = F.max(F.struct("_end", f"_p_{n}")).over(earlier)
        end = F.col(f"_p_{n}") + F.coalesce(m(F.col("_end") - last["_end"]) * last[f"_p_{n}"], F.lit(0.0))
        chunks = chunks.withColumn(f"_e_{n}", end)
    carry = chunks.select(*run, "_chunk", *[F.when(F.col("_first"), F.col(f"_x_{n}")).otherwise(F.lag(f"_e_{n}").over(by)).alias(f"_in_{n}") for n in values])
    out = rows.join(carry, [*run, "_chunk"])
    return out.select(*run, "epoch", *[(F.col(f"_b_{n}") + m(F.col("_j") + 1) * F.col(f"_in_{n}")).alias(n) for n in values])


def balancing_coefficients(epochs: DataFrame, momentum: float = 0.9, run: Sequence[str] = RUN,
                           first: str = "acc_t_aux", second: str = "acc_f_aux") -> DataFrame:
    """Smoothed accuracies of two branches turned into coefficients that add up to 2; the
    weaker branch gets the larger one. The first epoch seeds the average; epochs that lack one of the accuracies are left out."""
    out = smoothed(epochs.filter(F.col(first).isNotNull() & F.col(second).isNotNull()), {"ema_t": first, "ema_f": second}, momentum, run)
    total = F.col("ema_t") + F.col("ema_f") + 1e-8
    return out.withColumn("coef_t", 2.0 * F.col("ema_f") / total).withColumn("coef_f", 2.0 * F.col("ema_t") / total)
