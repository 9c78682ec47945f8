"""Labels from names, and picks of runs and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gaugeflow.functions.scalars import normalized_name
from gaugeflow.operators.ranking import hash_ranked, sequence_positions

# File names are {setting}_{bearing}_{run}, bearings a class code and a number.
RUN_FILE = r"^(N\d+_M\d+_F\d+)_([A-Za-z]+\d+)_(\d+)$"
BEARING = r"^(K[ABI]?)(\d{2,3})$"
FAULT_ONSET_SAMPLE = 21
EXCLUDED_FAULTS = (3, 9, 15)


def label_candidates(df: DataFrame, path: str = "path") -> DataFrame:
    """Name parts that may hold the class, in order of trust."""
    parts = F.split(F.col(path), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    lead = F.regexp_extract(stem, r"^[A-Za-z_\-]+", 0)
    found = F.array(*[
        F.struct(F.lit(i).alias("trust"), normalized_name(c).alias("candidate"))
        for i, c in enumerate((folder, stem, lead))
    ])
    return df.withColumn("_c", F.explode(found)).select(*df.columns, "_c.*").filter("candidate <> ''")


def infer_labels(df: DataFrame, aliases: DataFrame, path: str = "path") -> DataFrame:
    """Class of each path, NULL when no alias fits.

    An exact match of any candidate beats every prefix match; then the more trusted
    candidate, then the longer alias. Instead of comparing every path with every alias,
    a candidate is joined on each of its own prefixes no longer than the longest alias, so
    the join is an equality.
    """
    cands = label_candidates(df.select(path).distinct(), path)
    longest = aliases.agg(F.max(F.length("alias")).alias("n")).scalar()
    sized = cands.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.length("candidate"), longest))))
    fits = sized.withColumn("alias", F.substring(F.col("candidate"), F.lit(1), F.col("_n"))).join(aliases, "alias")
    exact = F.when(F.col("alias") == F.col("candidate"), 0).otherwise(1)
    order = F.struct(exact, F.col("trust"), -F.length("alias"))
    best = fits.groupBy(path).agg(F.min_by("class", order).alias("class"))
    return df.join(best, path, "left")


def parse_run_names(df: DataFrame, stem: str = "stem", strict: bool = False) -> DataFrame:
    """setting, bearing, code and run number of a file name.

    ``strict`` fails the job on a name that does not fit; otherwise ``bad_name`` says why.
    """
    bearing = F.regexp_extract(stem, RUN_FILE, 2)
    code = F.regexp_extract(bearing, BEARING, 1)
    bad = F.when(~F.col(stem).rlike(RUN_FILE), "not a run-file name").when(code == "", "unknown bearing code")
    if strict:
        code = F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(": "), F.col(stem)))).otherwise(code)
    out = df.select(
        "*",
        F.regexp_extract(stem, RUN_FILE, 1).alias("setting"),
        bearing.alias("bearing"),
        code.alias("code"),
        F.expr(f"try_cast(regexp_extract({stem}, '{RUN_FILE.replace(chr(92), chr(92) * 2)}', 3) AS int)").alias("run"),
        bad.alias("bad_name"),
    )
    return out.drop("bad_name") if strict else out


def first_file_wins(df: DataFrame, unit: Sequence[str], path: str = "path") -> DataFrame:
    """One file per unit, the first in path order, plus how many were given up.

    ``min`` combines on the map side, so a unit with very many copies is no hot task.
    """
    return df.groupBy(*unit).agg(F.min(path).alias(path), (F.count(F.lit(1)) - 1).alias("duplicates"))


def keep_classes(df: DataFrame, ordered: Sequence[str], column: str = "class") -> DataFrame:
    """Only the listed classes; ``label`` is their position in the list."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(c, i) for i, c in enumerate(ordered)], f"{column} string, label int")
    return df.join(F.broadcast(dim), column)


def without_faults(df: DataFrame, column: str, excluded: Sequence[int] = EXCLUDED_FAULTS) -> DataFrame:
    return df.filter(~F.col(column).isin(*excluded))


def trim_onset(df: DataFrame, normal: str = "Normal", onset: int = FAULT_ONSET_SAMPLE) -> DataFrame:
    """Faulty runs start at the onset; normal runs stay whole. Positions start at 0 again."""
    shift = F.when(F.col("class") == normal, 0).otherwise(onset)
    return df.filter(F.col("pos") >= shift).withColumn("pos", F.col("pos") - shift)


def evenly_spaced_runs(ids: DataFrame, picks: int, group: str = "class", run: str = "run_no") -> DataFrame:
    """``picks`` runs per group, evenly spaced over its sorted distinct run numbers.

    Fails when a group has fewer runs than asked for.
    """
    distinct = ids.select(group, run).distinct()
    ranked = sequence_positions(distinct, [group], [run], run, pos="rank")
    sizes = distinct.groupBy(group).agg(F.count(F.lit(1)).alias("runs"))
    step = (F.col("runs") - 1) / F.lit(max(picks - 1, 1))
    wanted = sizes.withColumn(
        "runs",
        F.when(F.col("runs") < picks, F.raise_error(F.concat(F.lit("too few runs in "), F.col(group).cast("string"))))
        .otherwise(F.col("runs")),
    ).select(group, F.explode(F.sequence(F.lit(0), F.lit(picks - 1))).alias("pick"), step.alias("_step"))
    wanted = wanted.select(group, "pick", F.bround(F.col("pick") * F.col("_step")).cast("long").alias("rank"))
    return ranked.join(wanted, [group, "rank"]).select(group, "pick", "rank", run)


def first_windows(df: DataFrame, order: Sequence[str], count: int = 256) -> DataFrame:
    """The first ``count`` rows in a fixed order (a top-k: each task keeps ``count`` rows)."""
    return df.orderBy(*order).limit(count)


def stratified_subsample(df: DataFrame, label: str, key: Sequence[str], size: int, seed: int) -> DataFrame:
    """``size`` rows: an equal share per class, the shortfall topped up from the rest.

    A table of at most ``size`` rows is returned whole.
    """
    rows = df.count()
    if rows <= size:
        return df
    classes = df.select(label).distinct().count()
    share = max(1, size // classes)
    ranked = hash_ranked(df, [label], key, seed, rank="_rank", total=None)
    first = ranked.filter(F.col("_rank") <= share).drop("_rank")
    rest = ranked.filter(F.col("_rank") > share).drop("_rank")
    short = size - first.count()
    if short <= 0:
        return first
    everyone = rest.withColumn("_all", F.lit(1))
    top_up = hash_ranked(everyone, ["_all"], key, seed + 1, rank="_rank", total=None)
    return first.unionByName(top_up.filter(F.col("_rank") <= short).drop("_rank", "_all"))
