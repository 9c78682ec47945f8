"""From samples to scaled windows: the whole preparation of a set of recordings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from gaugeflow.operators.splitting import WITHIN_RUN_STRIDE, split_runs, split_within_run
from gaugeflow.operators.windows import scale_windows, sliding_windows, train_stats
from gaugeflow.session import checkpointed


def run_lengths(samples: DataFrame) -> DataFrame:
    """(run_id, class, length), counted: positions run from 0 without gaps, so they need not
    be worked out for this."""
    per_channel = samples.groupBy("run_id", "class", "channel").agg(F.count(F.lit(1)).alias("n"))
    return per_channel.groupBy("run_id", "class").agg(F.max("n").alias("length"))


def assign_segments(lengths: DataFrame, window: int, stride: int, seed: int,
                    exact: Mapping[str, tuple[int, int, int]] | None = None,
                    within_stride: int = WITHIN_RUN_STRIDE) -> DataFrame:
    """(run_id, class, split, from_pos, to_pos, stride): whole runs, or parts in time of a
    run that is the only one of its class."""
    runs = split_runs(lengths, seed, exact)
    cols = ["run_id", "class", "split", "from_pos", "to_pos", "stride"]
    whole = runs.filter("n > 1").select(
        "run_id", "class", "split", F.lit(0).cast("long").alias("from_pos"), F.col("length").cast("long").alias("to_pos"), F.lit(stride).alias("stride"))
    parts = split_within_run(runs.filter("n = 1").drop("split"), window)
    own = F.when(F.col("way") == "test only", stride).otherwise(within_stride)
    return whole.unionByName(parts.withColumn("stride", own).select(*cols))


def prepare(samples: DataFrame, window: int, stride: int, seed: int, exact: Mapping[str, tuple[int, int, int]] | None = None,
            within_stride: int = WITHIN_RUN_STRIDE) -> DataFrame:
    """Windows (run_id, class, split, from_pos, channel, win_idx, start, series).

    Split by run, scaling by train samples alone, windows inside segments: no window and no
    statistic ever crosses a split. The segments, about one row per run, are written once,
    because both the statistics and the windows join them.
    """
    segments = checkpointed(assign_segments(run_lengths(samples), window, stride, seed, exact, within_stride).drop("class"))
    placed = samples.join(segments, "run_id").filter("pos >= from_pos AND pos < to_pos").withColumn("pos", F.col("pos") - F.col("from_pos"))
    keys = ["run_id", "class", "split", "from_pos", "channel"]
    return scale_windows(sliding_windows(placed, window, "stride", keys), train_stats(placed))
