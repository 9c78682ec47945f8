"""Normalization, rate alignment and sliding windows on long samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeflow.functions.scalars import array_mean

POOL_FACTOR = 16
FLAT_STD = 1e-8


def channel_stats(df: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    """Mean and population standard deviation per channel; a flat channel gets 1."""
    std = F.stddev_pop(value)
    return df.groupBy(channel).agg(
        F.avg(value).alias("mean"), F.when(std < FLAT_STD, 1.0).otherwise(std).alias("std"))


def with_channel_stats(df: DataFrame, stats: DataFrame, columns: Sequence[str], channel: str = "channel") -> DataFrame:
    """Adds its channel's statistics to each row out of one map that goes along with the plan as a single value.

    Channels are a short dictionary, like the columns of a schema; a join on so few keys would put all rows of a channel into one partition
    wherever it is not broadcast. Rows without a channel, or with one that has no statistics, are left out.
    """
    entry = F.struct(F.col(channel), F.struct(*columns))
    table = stats.filter(F.col(channel).isNotNull()).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    found = df.select("*", F.try_element_at(table.scalar(), F.col(channel)).alias("_of")).filter("_of IS NOT NULL")
    return found.select(*df.columns, *[F.col(f"_of.{c}").alias(c) for c in columns])


def train_stats(df: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    """(channel, mean, std) of the train rows, of all rows where there is no train row at all.

    One aggregate carries both, so the samples are read once for it; a flat channel gets a deviation of 1.
    """
    train = F.when(F.col("split") == "train", F.col(value))
    sums = df.groupBy(channel).agg(
        F.avg(train).alias("_m1"), F.stddev_pop(train).alias("_s1"), F.avg(value).alias("_m0"),
        F.stddev_pop(value).alias("_s0"), F.count(train).alias("_n1"))
    any_train = F.sum("_n1").over(Window.partitionBy()) > 0  # one row per channel
    mean = F.when(any_train, F.col("_m1")).otherwise(F.col("_m0"))
    std = F.when(any_train, F.col("_s1")).otherwise(F.col("_s0"))
    return sums.select(channel, mean.alias("mean"), F.when(std < FLAT_STD, 1.0).otherwise(std).alias("std"))


def zscore_by_train(df: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    """Scales samples by the statistics of the train rows alone; no sample is shuffled."""
    known = with_channel_stats(df, train_stats(df, channel, value), ["mean", "std"], channel)
    return known.withColumn(value, (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")


def scale_windows(windows: DataFrame, stats: DataFrame, channel: str = "channel", series: str = "series") -> DataFrame:
    """The same scaling on packed windows: one look at the statistics per window, not per sample."""
    known = with_channel_stats(windows, stats, ["mean", "std"], channel)
    return known.withColumn(series, F.transform(series, lambda v: (v - F.col("mean")) / F.col("std"))).drop("mean", "std")


def mean_pool(df: DataFrame, keys: Sequence[str], factor: int = POOL_FACTOR, value: str = "value") -> DataFrame:
    """Mean of each full block of ``factor`` samples; a partial last block is left out."""
    block = F.floor(F.col("pos") / factor).cast("long")
    return (
        df.groupBy(*keys, block.alias("pos"))
        .agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == factor)
        .drop("_n")
    )


def align_rates(samples: DataFrame, unit: str, fast_channels: Sequence[str], slow_channels: Sequence[str],
                factor: int = POOL_FACTOR, record: str = "record") -> DataFrame:
    """One row per (unit, pos) with all channels on the slow grid.

    Fast channels are mean-pooled, slow ones kept, other channels ignored, and the unit
    ends with its shortest channel. Samples are long: unit, channel, pos, value; both rates
    go through one grouping. A unit without one of the channels has no row here;
    ``missing_channels`` lists it.

    A unit may hold several records of a channel; the first one counts, whole. ``record`` names the column of record
    numbers: blocks are built by record, and the least number of (unit, channel) is known when its blocks, not its samples, come together. A table
    without that column has one record per channel; a position that is repeated then counts once, with its least value.
    """
    names = [*fast_channels, *slow_channels]
    fast = F.col("channel").isin(*fast_channels)
    pos = F.col("pos").cast("long")
    block = F.when(fast, F.floor(pos / factor)).otherwise(pos).cast("long")
    known = samples.filter(F.col("channel").isin(*names))
    if record in samples.columns:
        pooled = known.groupBy(unit, "channel", record, block.alias("pos")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("_n"))
        least = F.min(record).over(Window.partitionBy(unit, "channel"))
        pooled = pooled.withColumn("_first", least).filter(F.col(record) == F.col("_first"))
    else:
        # the place in the block has an aggregate of its own: combined before the shuffle, repeated or not
        place = F.when(fast, F.pmod(pos, F.lit(factor))).otherwise(0).cast("int")
        seen = [F.bit_or(F.when(F.floor(place / 60) == j, F.call_function("shiftleft", F.lit(1).cast("long"), place % 60))) for j in range(-(-factor // 60))]
        cells = F.array(*[F.min(F.when(place == i, F.col("value"))) for i in range(factor)])
        count = sum((F.bit_count(F.coalesce(m, F.lit(0).cast("long"))) for m in seen), F.lit(0))
        pooled = known.groupBy(unit, "channel", block.alias("pos")).agg(F.filter(cells, lambda v: v.isNotNull()).alias("_cells"), count.alias("_n"))
        pooled = pooled.withColumn("value", F.when(F.size("_cells") > 0, array_mean("_cells"))).drop("_cells")
    pooled = pooled.filter(~fast | (F.col("_n") == factor))
    # positions are contiguous from 0, so rows with every channel are the common length
    wide = pooled.groupBy(unit, "pos").agg(
        *[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in names],
        *[F.count(F.when(F.col("channel") == c, 1)).alias(f"_{c}") for c in names])
    for c in names:
        wide = wide.filter(F.col(f"_{c}") > 0).drop(f"_{c}")
    return wide


def missing_channels(df: DataFrame, unit: str, channels: Sequence[str]) -> DataFrame:
    """(unit, channel) pairs that are required and absent."""
    seen = df.select(unit, "channel").distinct()
    wanted = seen.select(unit).distinct().withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    return wanted.join(seen, [unit, "channel"], "left_anti")


def rate_warnings(lengths: DataFrame, factor: int = POOL_FACTOR, tolerance: float = 0.5) -> DataFrame:
    """Units (unit, fast_len, slow_len) whose length ratio is far from the pooling factor."""
    ratio = F.col("fast_len") / F.greatest(F.col("slow_len"), F.lit(1))
    return lengths.withColumn("ratio", ratio).withColumn(
        "rate_off", (F.col("fast_len") > 0) & (F.col("slow_len") > 0) & (F.abs(ratio - factor) > tolerance))


def window_count(length, window: int, stride) -> Column:
    """Windows that fit into a run."""
    n = F.col(length) if isinstance(length, str) else length
    stride = stride if isinstance(stride, Column) else F.lit(stride)
    return F.when(n >= window, F.floor((n - window) / stride) + 1).otherwise(0).cast("long")


def sliding_windows(samples: DataFrame, window: int, stride: int | str, keys: Sequence[str],
                    value: str = "value", block_windows: int = 64) -> DataFrame:
    """One row per window and key: win_idx, start and the window's values in order.

    A run is never gathered whole. It is cut into blocks of ``block_windows`` strides;
    each block also receives the samples its last windows reach into, so a sample is sent
    once, or twice near a block border. Positions must run from 0 without gaps. ``stride``
    is a number or the name of an integer column that is constant per key.
    """
    own_stride = isinstance(stride, str)
    step = F.col(stride) if own_stride else F.lit(stride)
    by = [*keys, stride] if own_stride and stride not in keys else list(keys)
    per_block = F.greatest(F.lit(block_windows), F.ceil(F.lit(window) / step).cast("int"))
    span = per_block * step
    pos = F.col("pos").cast("long")
    own = F.floor(pos / span)
    # the block before still reaches into the first samples of this one
    blocks = F.when((own > 0) & (pos % span < window - step), F.array(own, own - 1)).otherwise(F.array(own))
    spread = samples.select(*by, pos.alias("pos"), F.col(value).alias("value")).withColumn("_block", F.explode(blocks))
    packed = spread.groupBy(*by, "_block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("_values"))
    fit = F.least(per_block, F.floor((F.size("_values") - window) / step) + 1).cast("int")
    cut = packed.filter(F.size("_values") >= window).withColumn("_j", F.explode(F.sequence(F.lit(0), fit - 1)))
    index = F.col("_block") * per_block + F.col("_j")
    return cut.select(
        *keys,
        index.alias("win_idx"),
        (index * step).alias("start"),
        F.slice("_values", F.col("_j") * step + 1, window).alias("series"),
    )
