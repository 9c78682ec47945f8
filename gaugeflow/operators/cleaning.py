"""Gap handling and run checks on long samples (run, channel, pos, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gaugeflow.functions.scalars import finite, normalized_name
from gaugeflow.operators.ranking import CHUNK_ROWS, fill_neighbours

# Column names (normalized) that hold time or an index, not a sensor.
TIME_LIKE_NAMES = (
    "TIME", "T", "TIMESTAMP", "TIMESTEP", "STEP", "INDEX", "IDX", "SAMPLE", "SAMPLENO", "NO", "ID",
    "ITER", "ITERATION", "SECOND", "SECONDS", "CLOCK",
)
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def sensor_columns(df: DataFrame, keep: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are neither time-like, unnamed nor listed in ``keep``."""
    import re

    found = []
    for name, kind in df.dtypes:
        plain = re.sub("[^A-Z0-9]", "", name.upper())
        if name in keep or plain in TIME_LIKE_NAMES or plain.startswith("UNNAMED"):
            continue
        if kind.split("(")[0] in NUMERIC_TYPES:
            found.append(name)
    return found


def select_sensors(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *sensor_columns(df, keep))


def is_time_like(name):
    plain = normalized_name(name)
    return plain.isin(*TIME_LIKE_NAMES) | plain.startswith("UNNAMED")


def to_long(df: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """One row per (keys, channel); NaN and infinities become NULL."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in channels]).unpivot(
        list(keys), list(channels), "channel", "value")
    return long.withColumn("value", finite("value"))


def channel_fill(df: DataFrame, group: Sequence[str] = ("run_id", "channel")) -> DataFrame:
    """Samples and filled samples of every channel of every run."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("samples"), F.count("value").alias("filled"))


def drop_empty_channels(df: DataFrame, group: Sequence[str] = ("run_id", "channel")) -> DataFrame:
    """Without the channels that hold no value at all in their run."""
    empty = channel_fill(df, group).filter("filled = 0").select(*group)
    return df.join(empty, list(group), "left_anti")


def drop_gappy_channels(df: DataFrame, group: Sequence[str] = ("run_id", "channel")) -> DataFrame:
    """Without the channels that still hold a gap in their run."""
    gappy = channel_fill(df, group).filter("filled < samples").select(*group)
    return df.join(gappy, list(group), "left_anti")


def interpolate(df: DataFrame, group: Sequence[str] = ("run_id", "channel"), pos: str = "pos",
                value: str = "value", drop_empty: bool = True, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Straight line between filled neighbours by position; edges repeat the nearest value.

    A channel without any value in its run has no neighbour at all; its rows are dropped
    here, which saves counting values beforehand.
    """
    d = fill_neighbours(df, group, pos, value, chunk_rows)
    p0, v0, p1, v1 = F.col("prev.pos"), F.col("prev.value"), F.col("next.pos"), F.col("next.value")
    line = v0 + (v1 - v0) * (F.col(pos) - p0) / (p1 - p0)
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(p0.isNull(), v1)
        .when(p1.isNull(), v0)
        .otherwise(line)
    )
    out = d.withColumn(value, filled).drop("prev", "next")
    return out.filter(F.col(value).isNotNull()) if drop_empty else out


def channel_coverage(df: DataFrame) -> DataFrame:
    """Per channel: in how many runs it occurs, and whether every run has it.

    The rollup counts the runs of each channel and of all channels in one pass.
    """
    counts = df.rollup("channel").agg(F.count_distinct("run_id").alias("in_runs"), F.grouping("channel").alias("_all"))
    runs = F.max(F.when(F.col("_all") == 1, F.col("in_runs"))).over(Window.partitionBy())  # one row per channel
    return counts.withColumn("kept", F.col("in_runs") == runs).filter("_all = 0").drop("_all")


def shared_channels(df: DataFrame) -> DataFrame:
    """Only the channels that every run has."""
    return df.join(channel_coverage(df).filter("kept").select("channel"), "channel", "left_semi")


def run_checks(runs: DataFrame, window: int) -> DataFrame:
    """Why a run (class, length) cannot be used; NULL when it can."""
    reason = (
        F.when(F.col("class").isNull(), "unknown label")
        .when(F.coalesce("length", F.lit(0)) == 0, "empty")
        .when(F.col("length") < window, "short")
    )
    return runs.withColumn("reason", reason)


def finite_only(df: DataFrame, *cols: str) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & finite(c).isNotNull()
    return df.filter(cond)


def quarantine(units: DataFrame, channels: DataFrame, required: Sequence[str]):
    """Splits units into usable ones and (unit, reason) rows, before any split.

    ``channels`` holds one row per (unit, channel): length, gaps. The checks are one
    aggregate; nothing about the samples is read again.
    """
    names = list(required)
    have = channels.groupBy("unit").agg(
        *[F.max(F.when(F.col("channel") == n, F.lit(1))).alias(f"_has{i}") for i, n in enumerate(names)],
        F.min(F.when(F.col("channel").isin(names), F.col("length"))).alias("_shortest"),
        F.sum(F.when(F.col("channel").isin(names), F.col("gaps"))).alias("_gaps"),
    )
    missing = F.concat_ws(",", *[F.when(F.col(f"_has{i}").isNull(), F.lit(n)) for i, n in enumerate(names)])
    reason = (
        F.when(missing != "", F.concat(F.lit("missing "), missing))
        .when(F.col("_shortest") == 0, "empty channel")
        .when(F.col("_gaps") > 0, "not finite")
    )
    checked = units.join(have, "unit", "left").withColumn("reason", reason)
    drop = [c for c in have.columns if c != "unit"]
    good = checked.filter("reason IS NULL").drop("reason", *drop)
    bad = checked.filter("reason IS NOT NULL").drop(*drop)
    return good, bad


def lost_classes(classes: DataFrame, good: DataFrame) -> DataFrame:
    """Classes with no usable unit left."""
    return classes.join(good.select("class"), "class", "left_anti")
