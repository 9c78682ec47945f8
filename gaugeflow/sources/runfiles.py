"""Recordings as files: one file is one run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gaugeflow.operators.cleaning import sensor_columns, to_long
from gaugeflow.sources.places import PLACE, numbered, placed

# Columns of a process frame, in order.
PROCESS_META = ("faultNumber", "simulationRun", "sample")
PROCESS_CHANNELS = tuple([f"xmeas_{i}" for i in range(1, 42)] + [f"xmv_{i}" for i in range(1, 12)])


def scan_runs(spark: SparkSession, root: str, schema: StructType | str, pos_column: str | None = None,
              keep: Sequence[str] = (), run: str | None = None) -> DataFrame:
    """All run files below a folder, in long form with their path and the ``keep`` columns.

    A position column of the file gives the order of samples. Without one, samples are numbered as they stand: with
    ``run``, a pattern whose first group names a run in a path, over all part files of a run, otherwise over each file.
    Either way a large file is read in blocks by many tasks.
    """
    wide = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(root)
    if pos_column is None:
        rows = placed(wide)
        if run is not None:
            rows = rows.withColumn("run", F.regexp_extract("path", run, 1))
        wide = numbered(rows, "file_row", ["path"] if run is None else ["run"]).drop(*(c for c in PLACE if c != "path"), "run")
    else:
        wide = wide.select("*", F.col("_metadata.file_path").alias("path"), F.col(pos_column).alias("file_row"))
    ids = ["path", "file_row", *keep]
    channels = [c for c in sensor_columns(wide, ids) if c != pos_column]
    return to_long(wide, ids, channels)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes below a folder; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.col("path"), F.col("length"))


def absent_files(spark: SparkSession, listing: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected file names that the listing lacks."""
    want = spark.createDataFrame([(e,) for e in expected], "name string")
    have = listing.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return want.join(have, "name", "left_anti")


def canonical_frame(df: DataFrame, channels: Sequence[str] = PROCESS_CHANNELS, meta: Sequence[str] = PROCESS_META) -> DataFrame:
    """Renames columns to their canonical spelling (case and spaces do not matter).

    Only names are looked at, so a missing channel is reported before any data is read.
    """
    canon = {c.lower(): c for c in (*meta, *channels)}
    found = {canon[c.strip().lower()]: c for c in df.columns if c.strip().lower() in canon}
    lost = [c for c in channels if c not in found]
    if lost:
        raise ValueError(f"{len(lost)} channel columns are missing, for example {lost[:3]}; found {df.columns[:8]}")
    return df.select(*[F.col(f"`{found[c]}`").alias(c) for c in (*meta, *channels) if c in found])
