"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are cut into blocks of words and passed over once per epoch, each time in
another seeded order. A source gives as many whole epochs, and then as many blocks of the next
one, as bring it to its target. The exact block quotas of all sources are divided among output
shards by a tree: each node draws how many blocks of each source its left half gets. A shard then
owns a run of ranks in every source's order, so blocks are disjoint, and orders them locally.

Defined results: a NULL text has size 0 and is never taken; NULL sources are one source, last; an
empty table gives no rows; repeated rows are separate documents. Rows without a key are ordered by their place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gaugeflow.llm.common import WORD, only
from gaugeflow.session import checkpointed

BLOCK, SHARD_WORDS, SEED, MOST = 512, 1 << 24, 11, 3
CHUNKS, RANKS = 4096, 4096
#: Above this the generator cannot draw; such nodes are halved in proportion.
DRAWABLE = 10**9 - 1


def targets(sizes: list[tuple[str | None, int]], most: int = MOST) -> dict[str | None, float]:
    """Each source's target: all words shared by weights 1, 2, 3, 1, …, at most ``most`` times its size."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: i % 3 + 1 for i, (s, _) in enumerate(order)}
    left, open_, out = float(sum(n for _, n in order)), dict(order), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = [s for s, n in open_.items() if rate * weight[s] >= most * n]
        if not full:
            return out | {s: rate * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * open_.pop(s))
            left = max(0.0, left - out[s])
    return out


def split_node(quota: np.ndarray, lo: int, hi: int, seed: int) -> tuple[np.ndarray, int]:
    """(left quotas, middle): how many blocks of each source the shards lo..mid-1 of lo..hi-1 get."""
    mid = (lo + hi) // 2
    total = int(quota.sum())
    take = total * (mid - lo) // (hi - lo)
    if total <= DRAWABLE:
        rng = np.random.default_rng([seed, lo, hi])
        return rng.multivariate_hypergeometric(quota, take, method="marginals"), mid
    left = np.array([int(q) * take // total for q in quota])
    short = take - int(left.sum())
    left[np.argsort(left - quota, kind="stable")[:short]] += 1
    return left, mid


@dataclass
class Mix:
    """documents: uid, key, source, size, source_size, target. blocks: uid, epoch, block, start, words, shard, place."""

    documents: DataFrame
    blocks: DataFrame


def _intervals(spark, quota: np.ndarray, shards: int, seed: int) -> DataFrame:
    """(src, shard, lo, hi): the ranks of every source that each shard owns."""
    depth = min(8, max(0, (shards - 1).bit_length()))

    def leaves(lo, hi, q, off):
        todo = [(lo, hi, q, off)]
        while todo:
            lo, hi, q, off = todo.pop()
            if hi - lo == 1:
                yield from ((s, lo, int(off[s]), int(off[s] + q[s])) for s in np.flatnonzero(q))
                continue
            left, mid = split_node(q, lo, hi, seed)
            todo += [(lo, mid, left, off), (mid, hi, q - left, off + left)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["id"]:
                lo, hi, q, off = 0, shards, quota, np.zeros_like(quota)
                for bit in range(depth - 1, -1, -1):
                    right = path >> bit & 1
                    if hi - lo == 1:
                        if right:
                            break
                        continue
                    left, mid = split_node(q, lo, hi, seed)
                    lo, hi, q, off = (mid, hi, q - left, off + left) if right else (lo, mid, left, off)
                else:
                    rows = list(leaves(lo, hi, q, off))
                    if rows:
                        yield pd.DataFrame(rows, columns=["src", "shard", "lo", "hi"])

    return spark.range(1 << depth).mapInPandas(run, "src int, shard long, lo long, hi long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED, most: int = MOST) -> Mix:
    spark = docs.sparkSession
    rows = checkpointed(only(docs, key, text, source).toDF("key", "text", "source").select(
        F.monotonically_increasing_id().alias("uid"), "key", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    # one row per source: a dictionary
    sizes = [(r[0], r[1]) for r in rows.groupBy("source").agg(F.sum("size")).collect()]
    goal = targets(sizes, most)
    names = sorted(goal, key=lambda s: (s is None, s or ""))
    plan = spark.createDataFrame(
        [(i, s, n, goal[s], int(goal[s] // n) if n else 0, goal[s] - n * (goal[s] // n) if n else 0.0)
         for i, s in enumerate(names) for n in [dict(sizes)[s]]],
        "src int, _source string, source_size long, target double, whole int, rest double")
    documents = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    passes = (
        documents.filter("size > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least("whole", F.lit(most - 1)))))
        .filter("epoch < whole OR rest > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))))
        .withColumn("start", F.col("block") * block)
        .withColumn("words", F.least(F.lit(block).cast("long"), F.col("size") - F.col("start")))
        .withColumn("h", F.xxhash64(F.lit(seed), "src", F.coalesce("key", F.lit(-1) - F.col("uid")), "size", "epoch", "block"))
        .withColumn("chunk", F.pmod("h", F.lit(CHUNKS)))
        .select("uid", "src", "whole", "rest", "epoch", "block", "start", "words", "h", "chunk"))
    keys = ["src", "epoch", "chunk"]
    before = Window.partitionBy("src", "epoch").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = passes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w")).select(
        *keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
        F.sum("n").over(Window.partitionBy("src", "epoch")).alias("n_epoch"))
    local = Window.partitionBy(*keys).orderBy("h", "uid", "block")
    ranked = (
        passes.withColumn("at", F.row_number().over(local) - 1)
        .withColumn("w_at", F.sum("words").over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        .join(chunks, keys)
        .filter((F.col("epoch") < F.col("whole")) | (F.col("w_before") + F.col("w_at") + F.col("words") / 2 <= F.col("rest"))))
    taken = checkpointed(ranked.select(
        "uid", "src", "epoch", "block", "start", "words",
        (F.col("epoch") * F.col("n_epoch") + F.col("n_before") + F.col("at")).alias("rank")))
    drawn = taken.groupBy("src").agg(F.count(F.lit(1)), F.sum("words")).collect()
    quota = np.zeros(max(1, len(names)), np.int64)
    for s, n, _ in drawn:
        quota[s] = n
    shards = max(1, -(-sum(w for *_, w in drawn) // shard_words))
    cells = _intervals(spark, quota, shards, seed).withColumn(
        "cell", F.explode(F.sequence(F.expr(f"lo div {RANKS}"), F.expr(f"(hi - 1) div {RANKS}"))))
    owned = taken.withColumn("cell", F.expr(f"rank div {RANKS}")).join(cells, ["src", "cell"]).filter("rank >= lo AND rank < hi")
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "src", "rank"), "src", "rank")
    blocks = owned.withColumn("place", F.row_number().over(shuffled)).select(
        "uid", "epoch", "block", "start", "words", "shard", "place")
    out = documents.select("uid", F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target")
    return Mix(out, blocks)


def taken_words(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """(key, size, source_size, target, taken): one row per document, with the words the mix takes of it."""
    m = mix(docs, key, **how)
    took = m.blocks.groupBy("uid").agg(F.sum("words").alias("taken"))
    return m.documents.join(took, "uid", "left").select(
        F.col(f"`{key}`"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
