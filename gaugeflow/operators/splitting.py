"""Splits that keep every recording (or every unit of hardware) on one side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeflow.functions.hashing import key_hash
from gaugeflow.operators.ranking import hash_ranked
from gaugeflow.operators.windows import window_count

SPLITS = ("train", "val", "test")

# Bearings per class in (train, val, test) when whole bearings are held out.
BEARING_QUOTAS = {"K": (4, 1, 1), "KA": (7, 3, 2), "KI": (7, 2, 2), "KB": (1, 1, 1)}
WITHIN_RUN_STRIDE = 32


def proportional_counts(n: Column) -> tuple[Column, Column]:
    """(test, val) of n runs: 15 % each, rounded half up, at least one, and never the
    whole class; two runs give one test run and no val run."""
    share = F.greatest(F.lit(1), F.floor(n * 0.15 + 0.5))
    share = F.when(share * 2 >= n, 1).otherwise(share)
    test = F.when(n >= 2, F.when(n == 2, 1).otherwise(share)).otherwise(n)
    val = F.when(n >= 3, share).otherwise(0)
    return test.cast("long"), val.cast("long")


def sixty_twenty_counts(n: Column) -> Column:
    """Struct (train, val, test) of 60/20/20 with half-to-even rounding; NULL without train."""
    share = F.greatest(F.lit(1), F.bround(n * 0.2)).cast("long")
    train = (n - share * 2).cast("long")
    return F.when(train >= 1, F.struct(train.alias("n_train"), share.alias("n_val"), share.alias("n_test")))


def split_runs(runs: DataFrame, seed: int, exact: Mapping[str, tuple[int, int, int]] | None = None,
               key: str = "run_id", group: str = "class") -> DataFrame:
    """Adds ``split`` to each run: seeded order within the class, test first, then val.

    ``exact`` asks for (train, val, test) counts of some classes; they hold where they add
    up to the class's runs (at least three), otherwise the proportions apply and
    ``fell_back`` is true. A class with a single run is left to ``split_within_run``.
    """
    ranked = hash_ranked(runs, [group], [key], seed)
    n = F.col("n")
    test, val = proportional_counts(n)
    fell_back = F.lit(False)
    if exact:
        for name, (tr, va, te) in exact.items():
            if tr <= 0 or va < 0 or te <= 0:
                raise ValueError(f"split counts of {name} need train > 0, val >= 0 and test > 0: {(tr, va, te)}")
        dim = runs.sparkSession.createDataFrame(
            [(c, *v) for c, v in exact.items()], f"{group} string, _tr long, _va long, _te long")
        ranked = ranked.join(F.broadcast(dim), group, "left")
        fits = (n >= 3) & (n == F.col("_tr") + F.col("_va") + F.col("_te"))
        asked = F.col("_tr").isNotNull() & (n >= 3)
        test = F.when(fits, F.col("_te")).otherwise(test)
        val = F.when(fits, F.col("_va")).otherwise(val)
        fell_back = F.coalesce(asked & ~fits, F.lit(False))
    split = (
        F.when(n == 1, F.lit(None).cast("string"))
        .when(F.col("rank") <= test, "test")
        .when(F.col("rank") <= test + val, "val")
        .otherwise("train")
    )
    return ranked.select(*runs.columns, "n", split.alias("split"), fell_back.alias("fell_back"))


def split_within_run(runs: DataFrame, window: int, length: str = "length") -> DataFrame:
    """Segments (split, from_pos, to_pos, way) of the only run of its class.

    Long runs are cut 70/15/15 in time; shorter ones keep a window-long test tail and, if
    they can, a val tail; a run too short for that is test as a whole.
    """
    L = F.col(length)
    b1, b2 = F.floor(L * 0.70), F.floor(L * 0.85)
    W = F.lit(window)

    def seg(name, lo, hi):
        return F.struct(F.lit(name).alias("split"), F.lit(lo).cast("long").alias("from_pos") if not isinstance(lo, Column)
                        else lo.cast("long").alias("from_pos"), hi.cast("long").alias("to_pos"))

    parts = (
        F.when((b1 >= W) & (b2 - b1 >= W) & (L - b2 >= W),
               F.array(seg("train", 0, b1), seg("val", b1, b2), seg("test", b2, L)))
        .when(L >= 3 * W, F.array(seg("train", 0, L - 2 * W), seg("val", L - 2 * W, L - W), seg("test", L - W, L)))
        .when(L >= 2 * W, F.array(seg("train", 0, L - W), seg("test", L - W, L)))
        .otherwise(F.array(seg("test", 0, L)))
    )
    way = (
        F.when((b1 >= W) & (b2 - b1 >= W) & (L - b2 >= W), "proportional")
        .when(L >= 3 * W, "fixed tails")
        .when(L >= 2 * W, "test tail")
        .otherwise("test only")
    )
    return runs.withColumn("way", way).withColumn("_seg", F.explode(parts)).select("*", "_seg.*").drop("_seg")


def deal_quotas(cells: DataFrame, seed: int, cell: Sequence[str], group: str = "class") -> DataFrame:
    """Cells (group, cell, size) with the units of each that go to train and val (``q_train``, ``q_val``); the rest are test.

    A split with at least one unit per cell first reserves one in each; the rest is dealt one by one over the cells in a
    seeded order that starts one cell later per split, within each cell's size. Dealing fills all cells to one level, or to their size where that is less,
    and one more in the first cells that have room: the level follows from running sums over the cells by room. All of it is
    windows over the table of cells with one partitioning. Classes too small for the counts get NULL.
    """
    whole = Window.partitionBy(group)
    # one hash column and one order: every window below reuses the same exchange
    d = cells.withColumn("_hash", key_hash(*cell, seed)).select(
        *[F.col(c) for c in (group, *cell)], "size",
        (F.row_number().over(whole.orderBy("_hash", *cell)) - 1).alias("_turn"), F.count(F.lit(1)).over(whole).alias("_k"),
        sixty_twenty_counts(F.sum("size").over(whole)).alias("_asked"))
    reserved, left = {}, F.col("size")
    for s in SPLITS:
        reserved[s] = F.when((F.col(f"_asked.n_{s}") >= F.col("_k")) & (left > 0), 1).otherwise(0)
        d = d.withColumn(f"_own_{s}", reserved[s])
        left = left - F.col(f"_own_{s}")
    d = d.withColumn("_room", left)
    for shift, s in enumerate(("train", "val")):
        d = d.withColumn("_rem", F.col(f"_asked.n_{s}") - F.sum(f"_own_{s}").over(whole))
        d = d.withColumn("_place", F.pmod(F.col("_turn") - shift, F.col("_k")))
        up = whole.orderBy("_room", "_place").rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("_i", F.count(F.lit(1)).over(up)).withColumn("_sum", F.sum("_room").over(up))
        used = F.col("_sum") + F.col("_room") * (F.col("_k") - F.col("_i"))
        full = F.when(used <= F.col("_rem"), F.struct("_i", F.col("_room").alias("level"), used.alias("used")))
        none = F.struct(F.lit(0).cast("long").alias("_i"), F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("used"))
        d = d.withColumn("_full", F.coalesce(F.max(full).over(whole), none))
        open_ = F.col("_k") - F.col("_full._i")
        more = F.when(open_ > 0, F.floor((F.col("_rem") - F.col("_full.used")) / F.nullif(open_, F.lit(0)))).otherwise(0)
        d = d.withColumn("_level", F.col("_full.level") + more).withColumn("_over", F.col("_rem") - F.col("_full.used") - more * open_)
        has = F.when(F.col("_room") > F.col("_level"), 1).otherwise(0)
        lap = F.sum(has).over(whole.orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
        d = d.withColumn("_got", F.least("_room", "_level") + F.when((has == 1) & (lap <= F.col("_over")), 1).otherwise(0))
        d = d.withColumn(f"q_{s}", F.col(f"_own_{s}") + F.col("_got")).withColumn("_room", F.col("_room") - F.col("_got"))
    return d.select(group, *cell, "size", *[F.when(F.col("_asked").isNotNull(), F.col(q)).cast("long").alias(q) for q in ("q_train", "q_val")])


def split_stratified(units: DataFrame, seed: int, cell: Sequence[str], key: str = "unit",
                     group: str = "class") -> DataFrame:
    """60/20/20 split of units with every (group, cell) represented in every split it can be.

    A class too small for these counts (two units at most) takes the proportional split, whatever its cells; NULL
    classes and cells are classes and cells of their own. Every unit comes out once. One pass ranks all units: by cell, or by class in a small class.
    """
    keys = [group, *cell]
    sizes = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    quotas = deal_quotas(sizes, seed, cell, group).drop("size").withColumnsRenamed({k: f"_q_{k}" for k in keys})
    met = units.join(quotas, [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in keys])
    dealt = F.col("q_train").isNotNull()
    met = met.select(*units.columns, "q_train", "q_val", *[F.when(dealt, F.col(c)).alias(f"_c_{c}") for c in cell])
    ranked = hash_ranked(met, [group, *[f"_c_{c}" for c in cell]], [key], seed, rank="_rank", total="_n")
    test, val = proportional_counts(F.col("_n"))
    rank = F.col("_rank")
    split = F.when(
        dealt, F.when(rank <= F.col("q_train"), "train").when(rank <= F.col("q_train") + F.col("q_val"), "val").otherwise("test")
    ).otherwise(F.when(rank <= test, "test").when(rank <= test + val, "val").otherwise("train"))
    return ranked.select(*units.columns, split.alias("split"))


def split_groups(units: DataFrame, seed: int, quotas: Mapping[str, tuple[int, int, int]] = BEARING_QUOTAS,
                 code: str = "code", member: str = "bearing") -> DataFrame:
    """Whole groups (bearings) go to one split, by the quota of their class.

    Fails when a class does not have exactly as many groups as its quota adds up to.
    """
    dim = units.sparkSession.createDataFrame(
        [(c, *q) for c, q in quotas.items()], f"{code} string, _tr long, _va long, _te long")
    groups = units.select(code, member).distinct()
    ranked = hash_ranked(groups, [code], [member], seed).join(F.broadcast(dim), code, "left")
    need = F.col("_tr") + F.col("_va") + F.col("_te")
    wrong = F.concat_ws(" ", F.lit("class"), F.col(code), F.lit("needs"), need.cast("string"),
                        F.lit("groups, found"), F.col("n").cast("string"))
    split = (
        F.when(need.isNull(), F.raise_error(F.concat(F.lit("no quota for class "), F.col(code))))
        .when(need != F.col("n"), F.raise_error(wrong))
        .when(F.col("rank") <= F.col("_te"), "test")
        .when(F.col("rank") <= F.col("_te") + F.col("_va"), "val")
        .otherwise("train")
    )
    return units.join(ranked.select(code, member, split.alias("split")), [code, member])


def leakage(df: DataFrame, group: str) -> DataFrame:
    """Groups that occur in more than one split (empty when the split is clean)."""
    return df.groupBy(group).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def uncovered_cells(df: DataFrame, cell: Sequence[str], splits: Sequence[str] = SPLITS) -> DataFrame:
    """(cell, split) pairs with no unit."""
    seen = df.select(*cell, "split").distinct()
    wanted = seen.select(*cell).distinct().withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))
    return wanted.join(seen, [*cell, "split"], "left_anti")


def split_summary(segments: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """Runs and windows of each class in each split; classes without runs show zeros.

    ``segments`` has one row per run (or part of a run): class, split, from_pos, to_pos and
    stride. The windows follow from the lengths, so no sample is read for this table.
    """
    wins = window_count(F.col("to_pos") - F.col("from_pos"), window, F.col("stride"))
    found = segments.groupBy("class").agg(
        *[F.count(F.when(F.col("split") == s, 1)).alias(f"{s}_runs") for s in SPLITS],
        *[F.sum(F.when(F.col("split") == s, wins)).alias(f"{s}_windows") for s in SPLITS])
    out = classes.join(found, "class", "left")
    cols = [f"{s}_runs" for s in SPLITS] + [f"{s}_windows" for s in SPLITS]
    return out.select("class", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in cols])


def split_warnings(assigned: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """(class, warning) for every departure from the plain protocol.

    ``assigned`` is the output of ``split_runs`` with the length of each run.
    """
    per = assigned.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.max("length").alias("length"), F.max("fell_back").alias("fell_back"))
    warning = (
        F.when(F.col("n").isNull(), "no runs at all")
        .when((F.col("n") == 1) & (F.col("length") >= 2 * window), "one run, split in time")
        .when(F.col("n") == 1, "one run, too short to split, test only")
        .when(F.col("n") == 2, "two runs, no val")
        .when(F.col("fell_back"), "asked counts do not add up, split in proportion")
    )
    joined = classes.select("class").join(per, "class", "left")
    return joined.select("class", warning.alias("warning")).filter("warning IS NOT NULL")


def classes_without_runs(classes: DataFrame, runs: DataFrame) -> DataFrame:
    return classes.select("class").join(runs.select("class"), "class", "left_anti")
