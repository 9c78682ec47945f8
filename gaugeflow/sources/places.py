"""Places of rows in text files that are read in blocks.

A large file is cut into blocks that different tasks read, so no task can count its rows from the start.
Inside a block rows keep their order, and a block knows where in the file it starts: that orders all rows of a file. For dense numbers every block counts its rows,
and a running sum over a file's blocks (one short row each) says where each one begins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gaugeflow.session import written

#: File, byte at which the row's block begins, and a number that grows inside the block.
PLACE = ("path", "block", "at")


def placed(rows: DataFrame) -> DataFrame:
    """Adds the place of each row of a freshly opened file source. Good for ordering; ``at`` has gaps, and
    belongs to one reading of the files."""
    return rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("at"))


def numbered(rows: DataFrame, to: str = "file_row", whole: Sequence[str] = ("path",)) -> DataFrame:
    """Rows of ``placed`` with their 0-based number in ``whole``, a file or a folder of part files in the order of their names.

    The rows are written once, because the cuts between blocks may differ from one reading to the next; the index of
    blocks is a table too, so that Spark knows its size when it chooses the join.
    """
    stored = written(rows, "placed")
    blocks = list(dict.fromkeys([*whole, "path", "block"]))
    before = Window.partitionBy(*whole).orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    index = stored.groupBy(*blocks).agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("_first")).select(
        "path", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = stored.join(written(index, "blocks"), ["path", "block"])
    return joined.select(*rows.columns, (F.col("_before") + F.col("at") - F.col("_first")).alias(to))
