"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash; buckets over the byte limit, and
only these, split on one more bit. The directory itself is a table, built from sums per
hash prefix; no row reaches the driver.

Defined results: a NULL text has no bytes; every row costs ``ROW_BYTES`` besides its text; a row
larger than the limit is a shard of its own. A document's shard follows from its key and text and the rest of the table, however
that is partitioned; repeated rows hash apart by their number among equal ones. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import only
from gaugeflow.operators.ranking import hash_ranked
from gaugeflow.session import checkpointed

LIMIT = 8 << 20
ROW_BYTES = 16
MAX_BITS = 62


def _prefix(bits: int):
    return F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes): ``shard`` is the bucket's prefix in binary digits."""
    rows = checkpointed(only(docs, key, text).toDF("key", "text").select(
        "key", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("n_bytes"),
        F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("uid")))
    rows = hash_ranked(rows, ["key", "n_bytes", "t"], ["uid"], 4, total=None)
    rows = checkpointed(rows.select("key", "n_bytes", F.xxhash64("key", "t", "rank").alias("h")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(MAX_BITS, max(1, math.ceil(math.log2(max(total, 1) / limit)) + 2)) if total else 1
    while True:  # the directory doubles until no cell of several rows is over the limit
        cells = checkpointed(rows.groupBy(_prefix(bits).alias("p")).agg(F.sum("n_bytes").alias("s"), F.count(F.lit(1)).alias("n")))
        if bits >= MAX_BITS or not cells.filter((F.col("s") > limit) & (F.col("n") > 1)).limit(1).count():
            break
        bits = min(MAX_BITS, bits + 2)
    # from the deepest cells up: two buckets stay apart only if together they are over the limit
    level = cells.select("p", "s", "n", F.lit(bits).alias("depth"))
    directory = cells.select(F.col("p").alias("cell"), "p", "s", F.lit(bits).alias("depth"))
    for d in range(bits - 1, -1, -1):
        level = level.groupBy(F.shiftrightunsigned("p", 1).alias("p")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        fits = level.filter((F.col("s") <= limit) | (F.col("n") == 1)).select(F.col("p").alias("q"), F.col("s").alias("t"))
        joined = directory.withColumn("q", F.shiftrightunsigned("cell", bits - d)).join(fits, "q", "left")
        directory = joined.select(
            "cell", F.coalesce(F.when(F.col("t").isNotNull(), F.col("q")), "p").alias("p"), F.coalesce("t", "s").alias("s"),
            F.when(F.col("t").isNotNull(), F.lit(d)).otherwise(F.col("depth")).alias("depth"))
        if d % 6 == 0:
            level, directory = checkpointed(level), checkpointed(directory)
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(p), depth, '0')"))
    return rows.withColumn("cell", _prefix(bits)).join(directory, "cell").select(
        F.col("key").alias(key), "n_bytes", name.alias("shard"), F.col("depth").cast("int").alias("depth"), F.col("s").alias("shard_bytes"))
