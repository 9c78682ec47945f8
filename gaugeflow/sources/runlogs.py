"""Run logs: one JSON object per line, epochs first, the final record last.

A log is a text file, or a folder of part files whose names give their order, called ``{slug}_seed{n}.jsonl``. Files of
any length are read in blocks by many tasks; the order of lines is that of their places.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gaugeflow.functions.scalars import config_slug, finite, once
from gaugeflow.sources.places import PLACE, numbered, placed

LOG_NAME = r"^(.+)_seed(\d+)\.jsonl$"

EPOCH_FIELDS = (
    "epoch INT, train_loss DOUBLE, val_acc DOUBLE, rho DOUBLE, L_balance DOUBLE, acc_t_aux DOUBLE, acc_f_aux DOUBLE, "
    "coef_t DOUBLE, coef_f DOUBLE, h_alpha DOUBLE, s_tau DOUBLE"
)
FINAL_TYPE = (
    "STRUCT<accuracy: DOUBLE, macro_f1: DOUBLE, epochs_run: INT, rho_last: DOUBLE, H_alpha: DOUBLE, alpha_tvar: DOUBLE, "
    "S_tau: DOUBLE, per_class_alpha: MAP<STRING, DOUBLE>, perm_null: STRUCT<observed_var: DOUBLE, null_mean: DOUBLE, "
    "null_std: DOUBLE, z: DOUBLE, null_values: ARRAY<DOUBLE>>, degradation: MAP<STRING, DOUBLE>>"
)
LINE_SCHEMA = f"{EPOCH_FIELDS}, final {FINAL_TYPE}, _bad STRING"


def _named(lines: DataFrame) -> DataFrame:
    """Lines of files, or of part files in folders, that are named like a log."""
    return lines.withColumn("file", F.regexp_extract("path", r"([^/=]+_seed\d+\.jsonl)(/[^/]+)?$", 1)).filter("file <> ''")


def _text(spark: SparkSession, folder: str) -> DataFrame:
    return _named(placed(spark.read.option("recursiveFileLookup", True).text(folder)).withColumnRenamed("value", "line"))


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all logs: file, line_at, line. ``line_at`` orders the lines of a log; blank lines are left out."""
    return _text(spark, folder).filter(F.trim("line") != "").select("file", F.struct(*PLACE).alias("line_at"), "line")


def read_numbered_logs(spark: SparkSession, folder: str) -> DataFrame:
    """The same with ``line_no``, the 0-based number of the line in its log, blank lines counted."""
    lines = numbered(_text(spark, folder), "line_no", ["file"])
    return lines.filter(F.trim("line") != "").select("file", F.struct(*PLACE).alias("line_at"), "line_no", "line")


def write_logs(lines: DataFrame, folder: str, order: str = "line_no") -> None:
    """Lines (file, ``order``, line) as logs; a long one is cut into part files at places of its order."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own keeps Spark from writing all with one task
    parts = lines.repartitionByRange(n, "file", order).sortWithinPartitions("file", order)
    parts.select(F.col("file").alias("log"), "line").write.partitionBy("log").text(folder)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds config slug and seed of the file name and the parsed record ``rec``; files with
    other names are left out, a malformed line has ``rec._bad``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    named = lines.filter(F.col("file").rlike(LOG_NAME)).select(
        "*", F.regexp_extract("file", LOG_NAME, 1).alias("slug"), F.regexp_extract("file", LOG_NAME, 2).cast("int").alias("seed"))
    return once(named, "rec", F.from_json("line", LINE_SCHEMA, options))


def malformed_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter("rec._bad IS NOT NULL").groupBy("file").agg(F.count(F.lit(1)).alias("bad_lines"))


def final_records(parsed: DataFrame) -> DataFrame:
    """The last final record of each file; files without one do not appear."""
    f = _holding(parsed, "final").filter("rec._bad IS NULL AND rec.final IS NOT NULL")
    last = f.groupBy("slug", "seed").agg(F.max_by("rec.final", "line_at").alias("final"))
    return last.select("slug", "seed", *flatten_final())


def _holding(parsed: DataFrame, word: str) -> DataFrame:
    """A plain text test ahead of the parse, which is the costly part, where the text is still there."""
    return parsed.filter(F.col("line").contains(f'"{word}"')) if "line" in parsed.columns else parsed


def flatten_final() -> list[Column]:
    """Final record as flat columns; NaN becomes NULL."""
    plain = ("accuracy", "macro_f1", "rho_last", "H_alpha", "alpha_tvar", "S_tau")
    return [
        *[finite(f"final.{c}").alias(c) for c in plain], F.col("final.epochs_run").alias("epochs_run"),
        *[finite(f"final.perm_null.{c}").alias(c) for c in ("observed_var", "null_mean", "null_std")],
        finite("final.perm_null.z").alias("perm_null_z"),
        F.col("final.per_class_alpha").alias("per_class_alpha"), F.col("final.degradation").alias("degradation"),
    ]


def unfinished_files(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("file").agg(
        F.max((F.col("rec._bad").isNull() & F.col("rec.final").isNotNull()).cast("int")).alias("done")).filter("done = 0").select("file")


def epoch_records(parsed: DataFrame) -> DataFrame:
    fields = [f.strip().split(" ")[0] for f in EPOCH_FIELDS.split(",")]
    return _holding(parsed, "epoch").filter("rec._bad IS NULL AND rec.epoch IS NOT NULL").select("slug", "seed", *[F.col(f"rec.{f}").alias(f) for f in fields])


def name_configs(df: DataFrame, configs: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Slug to configuration name by a small dictionary; unknown slugs are left out or kept as they are."""
    dim = configs.select("config", config_slug("config").alias("slug"))
    out = df.join(dim, "slug", "left" if keep_unknown else "inner")
    return out.withColumn("config", F.coalesce("config", "slug")).drop("slug") if keep_unknown else out.drop("slug")


def dotted_columns(df: DataFrame, prefix: str = "") -> list[Column]:
    """Every leaf of nested structs as a column named by its path."""
    out = []
    for field in (df.schema if not prefix else df.select(f"{prefix}.*").schema).fields:
        path = f"{prefix}.{field.name}" if prefix else field.name
        if field.dataType.typeName() == "struct":
            out += dotted_columns(df, path)
        else:
            out.append(F.col(path).alias(path))
    return out


def objects_in(text: str | None, required: Sequence[str]) -> Iterator[tuple[str, str]]:
    """(path, object) of every object of a JSON text, at any depth, that has a value for all required keys, outer ones first.

    NULL, malformed text, numbers that JSON does not have, and text nested deeper than the parser goes hold none; of a repeated key the last value counts.
    """
    # a key that occurs nowhere in the text needs no parse; escapes could spell it otherwise
    if text is None or ("\\" not in text and any(json.dumps(k, ensure_ascii=False) not in text for k in required)):
        return
    try:
        open_ = [("$", json.loads(text, parse_constant=_no_number))]
    except (ValueError, RecursionError):
        return
    while open_:
        path, value = open_.pop()
        if isinstance(value, dict):
            if all(value.get(k) is not None for k in required):
                yield path, json.dumps(value, ensure_ascii=False, separators=(",", ":"))
            inner = [(f"{path}.{k}", v) for k, v in value.items()]
        else:
            inner = [(f"{path}[{i}]", v) for i, v in enumerate(value)] if isinstance(value, list) else []
        open_ += [x for x in reversed(inner) if isinstance(x[1], (dict, list))]


def _no_number(name: str):
    raise ValueError(name)


def objects_holding(lines: DataFrame, column: str, required: Sequence[str]) -> DataFrame:
    """Objects at any depth of a JSON text that hold all required keys: (other columns, json_path, object), in one pass over the rows."""
    ids = [f for f in lines.schema.fields if f.name != column]
    required = list(required)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, paths, objects = [], [], []
            for i, text in enumerate(b.column(b.num_columns - 1)):
                for path, found in objects_in(text.as_py(), required):
                    at.append(i)
                    paths.append(path)
                    objects.append(found)
            rows = pa.array(at, pa.int32())
            yield pa.record_batch([*(c.take(rows) for c in b.columns[:-1]), pa.array(paths, pa.string()), pa.array(objects, pa.string())],
                                  names=[*(f.name for f in ids), "json_path", "object"])

    schema = StructType([*ids, StructField("json_path", StringType()), StructField("object", StringType())])
    return lines.select(*[F.col(f"`{f.name}`") for f in ids], F.col(f"`{column}`").cast("string")).mapInArrow(walk, schema)
