"""Readers with fixed schemas and report writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

PREDICTIONS = "window_idx INT, class_name STRING, y_true INT, y_pred INT, correct INT"
RHO_CURVE = "config STRING, seed INT, epoch INT, rho DOUBLE"
RESULT_CELLS = "config STRING, accuracy STRING, macro_f1 STRING"
CLASS_COUNTS = (
    "class STRING, within_run_split BOOLEAN, train_runs INT, val_runs INT, test_runs INT, "
    "train_windows INT, val_windows INT, test_windows INT"
)
REPORT_SCHEMA = (
    "seeds ARRAY<INT>, dataset_report STRUCT<window: INT, stride: INT, split_seed: INT, n_runs: INT, n_channels: INT, "
    "per_class: MAP<STRING, STRUCT<train_runs: INT, val_runs: INT, test_runs: INT, train_windows: INT, val_windows: INT, "
    "test_windows: INT>>, within_run_split_classes: ARRAY<STRING>, warnings: ARRAY<STRING>>"
)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header and a known schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_finals(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Per-seed finals whose columns vary: listed ones as numbers, the dotted prefix removed."""
    raw = spark.read.option("header", True).csv(path)
    picked = [F.col(f"`{c}`").cast("double").alias(c.removeprefix("final.")) for c in columns if c in raw.columns]
    return raw.select("config", F.col("seed").cast("int").alias("seed"), *picked)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)


def report_classes(report: DataFrame) -> DataFrame:
    """Per-class counts of a protocol report as rows."""
    d = report.select(F.explode("dataset_report.per_class").alias("class", "c"),
                      F.col("dataset_report.within_run_split_classes").alias("_w"))
    return d.select("class", F.array_contains("_w", F.col("class")).alias("within_run_split"), "c.*")


def write_report(df: DataFrame, path: str, csv: bool = False) -> None:
    """Report tables as Parquet, or as CSV for people; existing output is replaced."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if csv else writer.parquet(path)


def union_columns(frames: Sequence[DataFrame], first: Sequence[str] = ("config", "seed")) -> DataFrame:
    """Rows of all frames under the union of their columns, keys first, the rest by name."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.select(*first, *sorted(c for c in both.columns if c not in first))


def tag_cells(tables: Mapping[str, DataFrame], column: str = "cell") -> DataFrame:
    """One table out of the same table of several cells."""
    parts = [df.withColumn(column, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_cells(df: DataFrame, path: str, column: str = "cell") -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)
