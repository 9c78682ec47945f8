"""Ranks inside groups of any size.

``row_number()`` over a group sends the whole group to one task. When one run or class
holds a large share of all rows that task never ends, so ranks are built in two steps:
rows are ranked inside small chunks, and each chunk adds the number of rows in the
chunks before it. Only the chunk counts, not the rows, meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeflow.functions.hashing import key_hash
from gaugeflow.session import checkpointed, written

CHUNK_ROWS = 2_000_000
CHUNK_DIGITS = 3
VALUE_CELLS = 512


def _offsets(chunks: DataFrame, group: Sequence[str], chunk: str, size: str) -> DataFrame:
    """Rows before each chunk, and rows of the whole group."""
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    return chunks.select(
        *group,
        chunk,
        F.coalesce(F.sum(size).over(before), F.lit(0)).alias("_before"),
        F.sum(size).over(whole).alias("_total"),
    )


def _sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))


def _rank_chunks(df: DataFrame, group: Sequence[str], chunk: str, order: Sequence[Column],
                 rank: str, total: str | None, sizes: DataFrame | None = None) -> DataFrame:
    keys = [*group, chunk]
    if sizes is None:
        sizes = _sizes(df, keys)
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    offsets = _offsets(sizes, group, chunk, "_size").withColumnsRenamed({k: f"_o_{k}" for k in keys})
    # null-safe: rows without a group or a time are ranked among themselves, not lost
    same = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    ranked = df.withColumn("_local", local).join(offsets, same).drop(*[f"_o_{k}" for k in keys])
    out = ranked.withColumn(rank, (F.col("_before") + F.col("_local")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("long"))
    return out.drop(chunk, "_local", "_before", "_total")


def hash_ranked(df: DataFrame, group: Sequence[str], key: Sequence[str], seed: int,
                rank: str = "rank", total: str | None = "n", digits: int = CHUNK_DIGITS) -> DataFrame:
    """1-based rank of each row in its group, in a seeded random but repeatable order.

    The first hex digits of the hash spread every group evenly over 16^digits chunks; one
    more digit makes the chunks of a very large group sixteen times smaller.
    """
    hashed = df.withColumn("_hash", key_hash(*key, seed)).withColumn("_chunk", F.substring("_hash", 1, digits))
    order = [F.col("_hash"), *[F.col(k) for k in key]]
    return _rank_chunks(hashed, group, "_chunk", order, rank, total).drop("_hash")


def _as_number(df: DataFrame, name: str) -> Column:
    """A number that never decreases where the column increases."""
    kind, c = dict(df.dtypes)[name], F.col(name)
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":  # by its clock reading: no time zone, no daylight saving
        return F.unix_date(F.to_date(c)) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.unix_date(c) if kind == "date" else c


def sequence_positions(df: DataFrame, group: Sequence[str], order: Sequence[str], grid: str,
                       pos: str = "pos", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """0-based position of each row of its group in ``order`` (a total order).

    ``grid`` is the leading order column. Three exact ways, chosen by counted sizes:
    a table of at most ``chunk_rows`` rows has no larger group and takes a plain window;
    otherwise the leading column is cut into equal steps; when some (group, step) is
    still too large, for example one busy instant, rows are range-partitioned by the
    full order, which splits any group.
    """
    lead = _as_number(df, grid)
    cols = [F.col(c) for c in order]
    rows = df.count()
    if rows <= chunk_rows:
        at = F.row_number().over(Window.partitionBy(*group).orderBy(*cols))
        return df.withColumn(pos, (at - 1).cast("long"))
    span = df.agg(F.min(lead).alias("lo"), F.max(lead).alias("hi")).first()
    steps = max(1, -(-rows * 8 // chunk_rows))
    lo, hi = (float(span[k] or 0) for k in ("lo", "hi"))
    width = (hi - lo) / steps or 1.0
    stepped = df.withColumn("_chunk", F.floor((lead.cast("double") - lo) / width))
    sizes = checkpointed(_sizes(stepped, [*group, "_chunk"]))  # read twice: here and for the offsets
    if sizes.agg(F.max("_size")).first()[0] > chunk_rows:
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // chunk_rows))
        ranged = df.repartitionByRange(parts, *group, *order)
        # range bounds come from a sample: fix them before two branches read them
        stepped = checkpointed(ranged.withColumn("_chunk", F.spark_partition_id()))
        sizes = None
    ranked = _rank_chunks(stepped, group, "_chunk", cols, "_rank", None, sizes)
    return ranked.withColumn(pos, F.col("_rank") - 1).drop("_rank")


def counted_ranks(counts: DataFrame, group: Sequence[str], value: str, size: str, cells: int = VALUE_CELLS) -> DataFrame:
    """Adds ``before``, the rows of the group with a smaller value, and ``rows``, those with any value.

    ``counts`` has one row per (group, value) and its number of rows, so tied rows are one and a cut never
    parts them. Each group's values are cut into ``cells`` ranges that hold about the same number of distinct
    values; running sums are taken inside a range, and only the sums of ranges meet in one task. The cuts come
    from an approximate aggregate; they are written, since both branches must see the same ones, and the
    result is exact wherever they lie. A NULL value has no rank and is not counted; a NULL group is a group.
    """
    counts = written(counts, "counts")
    probs = ", ".join(f"{i / cells}D" for i in range(1, cells))
    cuts = counts.groupBy(*group).agg(
        F.sum(F.when(F.col(value).isNotNull(), F.col(size))).alias("_rows"),
        F.array_distinct(F.expr(f"percentile_approx(`{value}`, array({probs}), {10 * cells})")).alias("_cuts"))
    cuts = written(cuts, "cuts").withColumnsRenamed({g: f"_g_{g}" for g in group})
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    cell = F.when(F.col(value).isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col(value)))).otherwise(F.lit(cells))
    placed = counts.join(cuts, same).withColumn("_cell", cell).drop("_cuts", *[f"_g_{g}" for g in group])
    keys = [*group, "_cell"]
    offsets = _offsets(placed.groupBy(*keys).agg(F.sum(size).alias("_size")), group, "_cell", "_size")
    offsets = offsets.drop("_total").withColumnsRenamed({k: f"_o_{k}" for k in keys})
    upto = F.sum(size).over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    before = F.when(F.col(value).isNotNull(), F.col("_before") + F.col("_upto") - F.col(size)).cast("long")
    return placed.withColumn("_upto", upto).join(offsets, met).select(
        *counts.columns, before.alias("before"), F.coalesce("_rows", F.lit(0)).cast("long").alias("rows"))


def average_rank(df: DataFrame, group: Sequence[str], value: str, out: str, cells: int = VALUE_CELLS) -> DataFrame:
    """Rank of each row in its group by value, tied rows sharing their mean; a NULL value has a NULL rank.

    Groups of any size: distinct values are ranked in ranges and found again by their value. The rows are written
    first: a value that is a sum of doubles may differ in its last bit each time it is computed, and would not be found.
    """
    df = written(df, "ranked")
    keys = [*group, value]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranks = counted_ranks(counts, group, value, "_n", cells).select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], (F.col("before") + (F.col("_n") + 1) / 2.0).alias(out))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(ranks, same).drop(*[f"_r_{k}" for k in keys])


def fill_neighbours(df: DataFrame, group: Sequence[str], pos: str, value: str,
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``prev`` and ``next``: the nearest filled sample (pos, value) at or before and
    at or after each row. Chunks of consecutive positions carry only their first and last
    filled sample to one another.

    Both directions are running frames; a frame that ends in "unbounded following" would
    be evaluated anew for every row.
    """
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("pos"), F.col(value).alias("value")))
    d = df.withColumn("_chunk", F.floor(F.col(pos) / chunk_rows)).withColumn("_at", at)
    keys = [*group, "_chunk"]
    filled = F.when(F.col(value).isNotNull(), F.col(pos))
    ends = d.groupBy(*keys).agg(
        F.min(filled).alias("_p0"), F.min_by(value, filled).alias("_v0"),
        F.max(filled).alias("_p1"), F.max_by(value, filled).alias("_v1"))

    def end(p, v):
        return F.when(F.col(p).isNotNull(), F.struct(F.col(p).alias("pos"), F.col(v).alias("value")))

    ends = ends.select(*keys, end("_p0", "_v0").alias("_first"), end("_p1", "_v1").alias("_last"))
    down = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy(*group).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys,
        F.last("_last", ignorenulls=True).over(down).alias("_carry_prev"),
        F.last("_first", ignorenulls=True).over(up).alias("_carry_next"),
    )
    here_down = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    here_up = Window.partitionBy(*keys).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("_prev", F.last("_at", ignorenulls=True).over(here_down)).withColumn(
        "_next", F.last("_at", ignorenulls=True).over(here_up))
    return (
        local.join(carry, keys)
        .withColumn("prev", F.coalesce("_prev", "_carry_prev"))
        .withColumn("next", F.coalesce("_next", "_carry_next"))
        .drop("_chunk", "_at", "_prev", "_next", "_carry_prev", "_carry_next")
    )
