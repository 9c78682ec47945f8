"""Spectral features of window arrays.

The transforms themselves are numpy calls on Arrow batches; Spark splits and joins the
windows and does all aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gaugeflow.functions.scalars import array_mean

# Short-time transform settings and pooled spectrum length.
FRAME, HOP, BANDS, POWER_FLOOR = 64, 16, 8, 1e-8
SPECTRUM_LENGTH = 64


def _by_length(batch: pd.Series, fn) -> pd.Series:
    """Applies ``fn`` to a matrix of all series of equal length at once."""
    out = np.empty(len(batch), object)
    lengths = batch.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        if n == 0:
            rows = [[]] * len(at)
        else:
            rows = list(fn(np.stack(batch.iloc[at].to_list()).astype(float)))
        for i, r in zip(at, rows):
            out[i] = r
    return pd.Series(out, index=batch.index)


@F.pandas_udf(ArrayType(DoubleType()))
def magnitude_spectrum(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Magnitudes of bins 1..T/2 (the constant part is left out)."""
    for batch in batches:
        yield _by_length(batch, lambda x: np.abs(np.fft.rfft(x, axis=1))[:, 1:])


def _pool_edges(size: int, parts: int) -> list[tuple[int, int]]:
    return [(i * size // parts, -(-(i + 1) * size // parts)) for i in range(parts)]


def _band_power(x: np.ndarray) -> np.ndarray:
    half = FRAME // 2
    padded = np.pad(x, ((0, 0), (half, half)), mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME, axis=1)[:, ::HOP]
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    power = np.abs(np.fft.rfft(frames * taper, axis=2)) ** 2
    logs = np.log(power + POWER_FLOOR)
    bands = [logs[:, :, a:b].mean(axis=2) for a, b in _pool_edges(logs.shape[2], BANDS)]
    return np.concatenate(bands, axis=1)


@F.pandas_udf(ArrayType(DoubleType()))
def band_log_power(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Log power of overlapping frames, averaged into 8 bands, band by band.

    Series must be longer than half a frame (32) for the mirrored edges.
    """
    for batch in batches:
        yield _by_length(batch, _band_power)


def adaptive_pool(series, length: int = SPECTRUM_LENGTH) -> Column:
    """Means of ``length`` nearly equal, possibly overlapping stretches of an array."""
    s = F.col(series) if isinstance(series, str) else series
    n = F.size(s)

    def part(i):
        a = F.floor(i * n / length).cast("int")
        b = F.ceil((i + 1) * n / length).cast("int")
        return array_mean(F.slice(s, a + 1, b - a))

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), part)


def dominant_periods(windows: DataFrame, length: int, top_k: int, group: Sequence[str] = ()) -> DataFrame:
    """The ``top_k`` strongest frequency bins of the mean spectrum, their periods and weights.

    The mean over windows and channels is a plain aggregate of (group, bin); the ranking
    afterwards sees at most ``length / 2`` rows per group.
    """
    bins = windows.select(*group, F.posexplode(magnitude_spectrum("series")).alias("_p", "amp")).select(
        *group, (F.col("_p") + 1).alias("bin"), "amp")
    mean = bins.groupBy(*group, "bin").agg(F.avg("amp").alias("amplitude"))
    w = Window.partitionBy(*group).orderBy(F.desc("amplitude"), "bin")
    top = mean.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    every = Window.partitionBy(*group)
    e = F.exp(F.col("amplitude") - F.max("amplitude").over(every))
    return top.select(
        *group, "rank", "bin", "amplitude",
        F.greatest(F.lit(2), F.ceil(F.lit(length) / F.col("bin"))).cast("int").alias("period"),
        (e / F.sum(e).over(every)).alias("weight"),
    )


def fold_by_period(windows: DataFrame, period: Column) -> DataFrame:
    """Series as a grid of whole periods: one row per (window, channel, cycle), phases in
    order, the last cycle filled up with zeros."""
    n = F.size("series")
    cycles = F.ceil(n / F.col("_period")).cast("int")
    cycle = F.transform(
        F.sequence(F.lit(0), F.col("_period") - 1),
        lambda j: F.coalesce(F.get(F.col("series"), (F.col("cycle") * F.col("_period") + j).cast("int")), F.lit(0.0)))
    return (
        windows.withColumn("_period", period)
        .withColumn("cycle", F.explode(F.sequence(F.lit(0), cycles - 1)))
        .withColumn("phases", cycle)
        .drop("series")
        .withColumnRenamed("_period", "period")
    )
