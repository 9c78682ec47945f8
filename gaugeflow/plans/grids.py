"""Class lists, aliases and configuration grids as small tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Class names in label order, and other names a folder or file may use for them.
PLANT_CLASSES = (
    "Normal", "ATWS", "FLB", "LACP", "LLB", "LOCA", "LOCAC", "LOF", "LR",
    "MD", "RI", "RW", "SGATR", "SGBTR", "SLBIC", "SLBOC", "SP", "TT",
)
PLANT_ALIASES = {
    "NORM": "Normal", "NORMALOPERATION": "Normal", "BASELINE": "Normal",
    "ANTICIPATEDTRANSIENTWITHOUTSCRAM": "ATWS",
    "FEEDWATERLINEBREAK": "FLB", "FWLB": "FLB",
    "LOSSOFACPOWER": "LACP", "LOSSOFAC": "LACP",
    "LETDOWNLINEBREAK": "LLB",
    "LOSSOFCOOLANTACCIDENT": "LOCA",
    "LOSSOFCOOLANTACCIDENTCOLDLEG": "LOCAC", "COLDLEGLOCA": "LOCAC",
    "LOSSOFFLOW": "LOF",
    "LOADREJECTION": "LR", "LOSSOFREGULATION": "LR",
    "MALFUNCTION": "MD", "MALFUNCTIONDISTURBANCE": "MD",
    "REACTIVITYINSERTION": "RI",
    "RODWITHDRAWAL": "RW", "REACTIVITYWITHDRAWAL": "RW",
    "SGTRLOOPA": "SGATR", "SGTRLOOPB": "SGBTR",
    "SGTUBERUPTUREA": "SGATR", "SGTUBERUPTUREB": "SGBTR",
    "STEAMLINEBREAKINSIDECONTAINMENT": "SLBIC", "SLBINSIDECONTAINMENT": "SLBIC",
    "STEAMLINEBREAKOUTSIDECONTAINMENT": "SLBOC", "SLBOUTSIDECONTAINMENT": "SLBOC",
    "SPURIOUS": "SP", "SPURIOUSTRIP": "SP",
    "TURBINETRIP": "TT",
}
# The compared configurations. Columns: name, use_temporal, use_spectral,
# fusion, gating, spectral_frontend, r1_balanced, r2_load_balanced, r2_gumbel.
FULL_GRID = (
    ("full", True, True, "adaptive", "dynamic", "fft", False, False, False),
    ("w/o_spectral", True, False, "adaptive", "dynamic", "fft", False, False, False),
    ("w/o_temporal", False, True, "adaptive", "dynamic", "fft", False, False, False),
    ("w/o_fusion", True, True, "none", "dynamic", "fft", False, False, False),
    ("w/o_dynamic_gating", True, True, "adaptive", "static", "fft", False, False, False),
    ("w/o_gating", True, True, "adaptive", "none", "fft", False, False, False),
    ("full_r1", True, True, "adaptive", "dynamic", "fft", True, False, False),
    ("full_r3_stft", True, True, "adaptive", "dynamic", "stft", False, False, False),
    ("full_r3_sinc", True, True, "adaptive", "dynamic", "sinc", False, False, False),
    ("full_r1_r3", True, True, "adaptive", "dynamic", "stft", True, False, False),
    ("full_r2", True, True, "adaptive", "dynamic", "fft", False, True, False),
    ("full_r2_gumbel", True, True, "adaptive", "dynamic", "fft", False, True, True),
    ("full_r4_sparsemax", True, True, "adaptive", "sparsemax", "fft", False, False, False),
    ("full_r4_entmax", True, True, "adaptive", "entmax", "fft", False, False, False),
    ("full_r4_lstm", True, True, "adaptive", "lstm", "fft", False, False, False),
    ("full_r1_r2_r3", True, True, "adaptive", "dynamic", "stft", True, True, False),
    ("full_all", True, True, "adaptive", "lstm", "stft", True, True, False),
    ("r1_w/o_spectral", True, False, "adaptive", "dynamic", "fft", True, False, False),
    ("full_fixed_global", True, True, "fixed_global", "dynamic", "fft", False, False, False),
    ("full_fixed_class", True, True, "fixed_class", "dynamic", "fft", False, False, False),
)
PLAIN_PERIODIC = ("tsnet_vanilla", True, False, "none", "none", "fft", False, False, False)
REPLICATION = ("full", "w/o_spectral", "w/o_temporal", "w/o_fusion", "w/o_gating", "full_r1", "full_r2_gumbel")
SMOKE = {"full": ("full", "full_r2", "full_r4_lstm"), "replication": ("full", "full_r2_gumbel", "tsnet_vanilla")}
ABLATIONS = ("full", "w/o_spectral", "w/o_temporal", "w/o_fusion", "w/o_dynamic_gating", "w/o_gating")
REMEDIES = (
    "full_r1", "full_r3_stft", "full_r3_sinc", "full_r1_r3", "full_r2", "full_r2_gumbel", "full_r4_sparsemax",
    "full_r4_entmax", "full_r4_lstm", "full_r1_r2_r3", "full_all", "r1_w/o_spectral", "full_fixed_global", "full_fixed_class",
)

CONFIG_SCHEMA = (
    "position int, config string, use_temporal boolean, use_spectral boolean, fusion string, gating string, "
    "spectral_frontend string, r1_balanced boolean, r2_load_balanced boolean, r2_gumbel boolean"
)


def class_table(spark: SparkSession, classes: Sequence[str] = PLANT_CLASSES) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(classes)], "label int, class string")


def alias_table(spark: SparkSession) -> DataFrame:
    """Normalized alias to class name, the class names themselves included."""
    rows = [(re.sub("[^A-Z0-9]", "", c.upper()), c) for c in PLANT_CLASSES]
    rows += list(PLANT_ALIASES.items())
    return spark.createDataFrame(rows, "alias string, class string")


def config_grid(spark: SparkSession, cell: str = "full", periodic: bool = False, smoke: bool = False,
                only: Sequence[str] | None = None) -> DataFrame:
    """The configurations of an experiment, in order; a name that is not among them is an error."""
    if cell not in SMOKE:
        raise ValueError(f"unknown cell {cell!r}; expected one of {tuple(SMOKE)}")
    rows = [c for c in FULL_GRID if cell == "full" or c[0] in REPLICATION]
    if cell == "replication":
        rows.sort(key=lambda c: REPLICATION.index(c[0]))
        rows += [PLAIN_PERIODIC] if periodic else []
    if smoke:
        rows = [c for c in rows if c[0] in SMOKE[cell]]
    unknown = sorted(set(only or ()) - {c[0] for c in rows})
    if unknown:
        raise ValueError(f"unknown configurations: {unknown}")
    rows = [c for c in rows if only is None or c[0] in only]
    return spark.createDataFrame([(i, *c) for i, c in enumerate(rows)], CONFIG_SCHEMA)
