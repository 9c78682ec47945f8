"""Run logs to report tables as one plan.

Every line is parsed once. The parsed records are written as one typed table, out of which the broken and unfinished logs, the
last final record of each run, the curves, and from the finals (written too, one row per run) all
tables by configuration are read, each with the nested columns it needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.operators import epochs as ep, reports, significance as sig
from gaugeflow.plans import grids
from gaugeflow.session import written
from gaugeflow.sources import runlogs


def log_reports(spark: SparkSession, folder: str, baseline: str = "full", configs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Reports by name: results, indicators, null, curves, significance, logs. Slugs that the dictionary of configurations lacks are left out."""
    configs = grids.config_grid(spark) if configs is None else configs
    parsed = runlogs.parse_lines(runlogs.read_logs(spark, folder))
    records = written(parsed.select("file", "slug", "seed", "line_at", "rec"), "records")
    finals = written(runlogs.name_configs(runlogs.final_records(records), configs), "finals")
    epochs = runlogs.name_configs(runlogs.epoch_records(records), configs)
    final = F.col("rec._bad").isNull() & F.col("rec.final").isNotNull()
    state = records.groupBy("file").agg(F.count_if(F.col("rec._bad").isNotNull()).alias("bad"), F.max(final).alias("done"))
    return {
        "results": reports.results_table(finals),
        "indicators": reports.indicator_table(finals),
        "null": reports.null_table(finals.withColumn("z", F.col("perm_null_z"))),
        "curves": ep.mean_curve(epochs),
        "significance": sig.significance_table(finals, baseline),
        "logs": state.agg(F.count(F.lit(1)).alias("logs"), F.sum("bad").alias("broken_lines"), F.count_if(~F.col("done")).alias("unfinished")),
    }


def as_measures(tables: Mapping[str, DataFrame], keys: Sequence[str] = ("config", "metric", "epoch")) -> DataFrame:
    """Tables with different columns as one: report, the keys as text, measure, value. Text columns that are no key are left out."""
    parts = []
    for name, df in tables.items():
        ids = [F.col(k).cast("string").alias(k) if k in df.columns else F.lit(None).cast("string").alias(k) for k in keys]
        measures = [c for c, kind in df.dtypes if c not in keys and kind not in ("string", "boolean")]
        wide = df.select(F.lit(name).alias("report"), *ids, *[F.col(c).cast("double").alias(c) for c in measures])
        parts.append(wide.unpivot(["report", *keys], measures, "measure", "value"))
    return reduce(DataFrame.unionByName, parts)
