"""Seven sensor faults on a window table.

Windows are rows (window keys, channel, series). Every fault is a column expression on
such a row, so faults need no shuffle: the only aggregate is the short table of channel
moments that some of them are scaled by. Rows and the input frame stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.functions.hashing import fast_uniform, key_hash, normal_from, uniform, uniform_from
from gaugeflow.functions.scalars import array_sum, array_sum_sq, let
from gaugeflow.operators.windows import with_channel_stats

# Names in evaluation order, and the offset of their seeds from the run seed.
DEGRADATIONS = (
    "gaussian_noise_snr20", "gaussian_noise_snr10", "drift", "bias", "stuck", "dropout", "downsample",
)
SEED_OFFSET = 10_000


def degradation_seed(run_seed: int, name: str) -> int:
    return run_seed + SEED_OFFSET + DEGRADATIONS.index(name)


def channel_moments(windows: DataFrame) -> DataFrame:
    """Per channel: mean power and population standard deviation over windows and time.

    Each array is folded to its sums first, so one short row per channel and task is shuffled.
    """
    n, s, q = F.sum(F.size("series")), F.sum(array_sum("series")), F.sum(array_sum_sq("series"))
    return windows.groupBy("channel").agg(
        (q / n).alias("power"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("std"))


def subset_size(total: int, frac: float) -> int:
    """At least one; Python's round is half to even, as wanted here."""
    return max(1, int(round(frac * total)))


def channel_names(windows: DataFrame) -> list[str]:
    """The sensors of a window table: a short list, like a schema."""
    return sorted(r[0] for r in windows.select("channel").distinct().collect())


def picked_items(row: Sequence[str], items: Sequence[str], k: int, seed: int) -> Column:
    """Exactly ``k`` of the items for every row key, by the order of their hashes.

    Each row draws the whole short list itself instead of meeting its window's other rows.
    """
    drawn = F.transform(F.array(*[F.lit(i) for i in items]),
                        lambda i: F.struct(key_hash(*row, i, seed).alias("h"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(drawn), 1, k), lambda s: s["i"])


def random_subset(df: DataFrame, row: Sequence[str], item: str, items: Sequence[str], k: int, seed: int,
                  flag: str = "picked") -> DataFrame:
    """Marks exactly ``k`` items of every row group."""
    return df.withColumn(flag, F.array_contains(picked_items(row, items, k, seed), F.col(item)))


def noise_series(row: Sequence[str], seed: int, snr_db: float, exact_hash: bool = True) -> Column:
    """White noise whose power lies ``snr_db`` below the channel's.

    ``exact_hash`` draws from md5 (the same in any SQL engine); otherwise from xxhash64,
    which is far cheaper per element.
    """
    sigma = F.sqrt(F.col("_power") / (10.0 ** (snr_db / 10.0)))

    def noisy(v, i):
        if exact_hash:
            digest = key_hash(*row, "channel", i, seed)
            z = normal_from(uniform_from(digest, 1), uniform_from(digest, 9))
        else:
            z = normal_from(fast_uniform(*row, "channel", i, seed), fast_uniform(*row, "channel", i, seed + 1))
        return v + z * sigma

    return F.transform("series", noisy)


def drift_series(seed: int, magnitude: float = 0.5) -> Column:
    """A straight ramp up to ``magnitude`` channel deviations, up or down per channel."""
    sign = F.when(uniform("channel", seed) < 0.5, -1.0).otherwise(1.0)
    top, last = sign * F.col("_std") * magnitude, F.greatest(F.size("series") - 1, F.lit(1))
    return F.transform("series", lambda v, i: v + top * i / last)


def bias_series(row: Sequence[str], seed: int, channels: Sequence[str], frac: float = 0.1, magnitude: float = 0.5) -> Column:
    """A constant offset on a random tenth of the channels of each window."""
    hit = F.array_contains(picked_items(row, channels, subset_size(len(channels), frac), seed), F.col("channel"))
    return F.when(hit, F.transform("series", lambda v: v + F.col("_std") * magnitude)).otherwise(F.col("series"))


def stuck_series(row: Sequence[str], seed: int, channels: Sequence[str], frac: float = 0.05) -> Column:
    """Some channels of each window keep their first value."""
    hit = F.array_contains(picked_items(row, channels, subset_size(len(channels), frac), seed), F.col("channel"))
    return F.when(hit, F.array_repeat(F.element_at("series", 1), F.size("series"))).otherwise(F.col("series"))


def dropped_positions(row: Sequence[str], seed: int, length: Column, frac: float) -> Column:
    """Positions lost in a window: the same for each of its channels."""
    k = F.greatest(F.lit(1), F.bround(length * frac)).cast("int")
    drawn = F.transform(F.sequence(F.lit(0), length - 1),
                        lambda i: F.struct(key_hash(*row, i, seed).alias("h"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(drawn), F.lit(1), k), lambda s: s["i"])


def dropout_series(row: Sequence[str], seed: int, frac: float = 0.1) -> Column:
    """A tenth of the time samples of each window read zero."""
    lost = dropped_positions(row, seed, F.size("series"), frac)
    return let(lost, lambda gone: F.transform("series", lambda v, i: F.when(F.array_contains(gone, i), 0.0).otherwise(v)))


def downsampled_series(stride: int = 2) -> Column:
    """Every ``stride``-th sample kept, the others on a straight line between kept ones;
    past the last kept sample its value repeats."""
    s = F.col("series")
    last_kept = F.floor((F.size(s) - 1) / stride) * stride

    def at(v, i):
        left = (F.floor(i / stride) * stride).cast("int")
        right = F.least(left + stride, last_kept).cast("int")
        w = (i - left) / F.lit(float(stride))
        return F.when(i % stride == 0, v).otherwise(F.get(s, left) * (1.0 - w) + F.get(s, right) * w)

    return F.transform(s, at)


def _expression(name: str, row: Sequence[str], run_seed: int, channels: Sequence[str]) -> Column:
    if name not in DEGRADATIONS:
        raise ValueError(f"unknown degradation {name!r}; expected one of {list(DEGRADATIONS)}")
    seed = degradation_seed(run_seed, name)
    if name.startswith("gaussian_noise_snr"):
        return noise_series(row, seed, float(name.removeprefix("gaussian_noise_snr")))
    return {
        "drift": lambda: drift_series(seed),
        "bias": lambda: bias_series(row, seed, channels),
        "stuck": lambda: stuck_series(row, seed, channels),
        "dropout": lambda: dropout_series(row, seed),
        "downsample": downsampled_series,
    }[name]()


def _with_moments(windows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds the channel moments when one of the faults is scaled by them."""
    if not any(n.startswith("gaussian") or n in ("drift", "bias") for n in names):
        return windows
    moments = channel_moments(windows).select("channel", F.col("power").alias("_power"), F.col("std").alias("_std"))
    return with_channel_stats(windows, moments, ["_power", "_std"])


def degrade(windows: DataFrame, name: str, row: Sequence[str], run_seed: int, channels: Sequence[str] | None = None) -> DataFrame:
    """The fault of that name, with its own seed."""
    needs_names = name in ("bias", "stuck")
    channels = channels or (channel_names(windows) if needs_names else [])
    series = _expression(name, row, run_seed, channels)
    return _with_moments(windows, [name]).withColumn("series", series).select(*windows.columns)


def all_degradations(windows: DataFrame, row: Sequence[str], run_seed: int, with_clean: bool = True,
                     channels: Sequence[str] | None = None) -> DataFrame:
    """Clean and degraded windows in one table with a ``degradation`` column.

    The windows are read once; each row fans out into its variants inside its task.
    """
    channels = channels or channel_names(windows)
    variants = [("clean", F.col("series"))] if with_clean else []
    variants += [(n, _expression(n, row, run_seed, channels)) for n in DEGRADATIONS]
    fan = F.explode(F.array(*[F.struct(F.lit(n).alias("degradation"), s.alias("series")) for n, s in variants]))
    keep = [c for c in windows.columns if c != "series"]
    return _with_moments(windows, DEGRADATIONS).withColumn("_v", fan).select(*keep, "_v.degradation", "_v.series")
