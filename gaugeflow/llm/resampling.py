"""Importance resampling towards a target distribution.

Features are runs of words, counted in hashed buckets over all documents and over all target texts. A bucket's gain is the scaled
logarithm of its smoothed target share over its document share; the gains stand in one array, and a document's weight is their sum over
its features. Adding Gumbel noise drawn from a hash of the id and keeping the highest scores draws documents without replacement
with chances that follow the weights.

The cutoff key is found by weighted median-of-medians selection: every partition reports the median of what remains in it, the
median of those medians, weighted by the remaining sizes, has at least a fourth of all remaining keys on either side, and the side that cannot hold the
cutoff is discarded. The count behind a pivot and the next medians of both sides come from one pass. Only the winners are sorted.

Defined results: a NULL text has no words; a NULL id draws its noise from the empty string and comes last among ties; rows that agree in score and id are taken
in any order, each with a rank of its own; an empty target or document table leaves smoothed counts; other columns go no further. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gaugeflow.llm.common import only, written

BUCKETS = 10_000
SEED = 2024
#: Documents below this number of words are not drawn; percent of the others that are.
LEAST_WORDS, PERCENT = 20, 10
#: Remaining keys that are sorted at once at the end of a selection.
FEW = 4096
#: The remaining keys are written anew when they have become this many times fewer.
SHRUNK = 8
#: A word: a run of ASCII letters, digits and everything beyond ASCII, on lower-cased bytes.
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LAST_ID = (1 << 63) - 1


def features(text: bytes | None, shortest: int, longest: int) -> tuple[int, Counter]:
    """Number of words, and the features with how often they occur."""
    words = re.findall(WORD, text.lower()) if text else []
    out = Counter(words) if shortest == 1 else Counter()
    for n in range(max(shortest, 2), longest + 1):
        out.update(b" ".join(words[i:i + n]) for i in range(len(words) - n + 1))
    return len(words), out


def bucket_counts(texts: DataFrame, text: str, shortest: int, longest: int, buckets: int) -> np.ndarray:
    """Features per bucket over all rows; a task sends one row per bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(buckets, np.int64), Counter()

        def empty_out():
            for f, n in seen.items():
                total[zlib.crc32(f) % buckets] += n
            seen.clear()

        for b in batches:
            for t in b.column(0):
                seen.update(features(t.as_py(), shortest, longest)[1])
                if len(seen) > 1 << 18:
                    empty_out()
        empty_out()
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    counted = only(texts, text).toDF("text").select(F.col("text").cast("binary")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():  # at most ``buckets`` numbers, whatever the number of texts
        out[bucket] = n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of smoothed shares by bucket, rounded down."""
    size, s_all, t_all = len(docs), int(docs.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * (s_all + size) / (float(s + 1) * (t_all + size))))
                     for s, t in zip(docs.tolist(), target.tolist())], np.int64)


def noise(key: object, seed: int = SEED) -> int:
    """Scaled Gumbel noise from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _beyond(keys: np.ndarray, at: tuple) -> np.ndarray:
    """Which of the keys, one per column, come after ``at``."""
    (a, b, c), (x, y, z) = keys, at
    return (a > x) | (a == x) & ((b > y) | (b == y) & (c > z))


def _median(keys: np.ndarray) -> list:
    """Size and lower median of some keys."""
    n = keys.shape[1]
    if not n:
        return [0, None, None, None]
    at = np.lexsort(keys[::-1])[(n - 1) // 2]
    return [n, *keys[:, at].tolist()]


def weighted_median(found: list[tuple]) -> tuple | None:
    """Lower median of (size, key…) rows, each key counted as often as its size says."""
    rows = sorted((tuple(k), n) for n, *k in found if n)
    half, so_far = sum(n for _, n in rows), 0
    for key, n in rows:
        so_far += n
        if 2 * so_far >= half:
            return key
    return None


def cutoff(keys: DataFrame, k: int) -> tuple | None:
    """The k-th key of a table of three long columns, in ascending order; None if k is 0. Keys are distinct and at least k."""
    if k < 1:
        return None
    names = keys.columns
    out = ", ".join(f"{side}{c} long" for side in ("below_", "above_") for c in ("n", *names))

    def ask(table: DataFrame, low: tuple | None, high: tuple | None, pivot: tuple | None) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
            x = np.concatenate(got, axis=1) if got else np.zeros((3, 0), np.int64)
            for bound, after in ((low, True), (high, False)):
                if bound is not None:
                    x = x[:, _beyond(x, bound) == after]
            past = _beyond(x, pivot) if pivot is not None else np.zeros(x.shape[1], bool)
            row = _median(x[:, ~past]) + _median(x[:, past])
            if row[0] or row[4]:
                yield pa.record_batch([pa.array([v], pa.int64()) for v in row], names=[f"c{i}" for i in range(8)])

        return [tuple(r) for r in table.mapInArrow(run, out).collect()]  # one row per partition

    a, b, c = (F.col(n) for n in names)
    after = lambda t: (a > t[0]) | ((a == t[0]) & ((b > t[1]) | ((b == t[1]) & (c > t[2]))))
    table, low, high, pivot = keys, None, None, None
    rows = ask(table, low, high, pivot)
    stored = left = sum(r[0] for r in rows)
    while True:
        if pivot is None:
            side = [r[:4] for r in rows]
        else:
            before = sum(r[0] for r in rows)
            if k == before:
                return pivot
            if k < before:
                high, side, left = pivot, [r[:4] for r in rows], before
            else:
                low, side, left, k = pivot, [r[4:] for r in rows], left - before, k - before
        between = table
        if low is not None:
            between = between.filter(after(low))
        if high is not None:
            between = between.filter(~after(high))
        if left <= FEW:
            return sorted(tuple(r) for r in between.collect())[k - 1]
        if left * SHRUNK <= stored:
            table, stored = written(between), left
        pivot = weighted_median(side)
        rows = ask(table, low, high, pivot)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 1, longest: int = 1, buckets: int = BUCKETS,
             least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank): one row per document, the rank NULL where it is not drawn. Ids are whole numbers."""
    kind = docs.schema[key].dataType.simpleString()
    table = gains(bucket_counts(docs, text, shortest, longest, buckets), bucket_counts(target, text, shortest, longest, buckets))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(2)):
                n_words, found = features(t.as_py(), shortest, longest)
                at = np.fromiter((zlib.crc32(f) for f in found), np.int64, len(found)) % buckets
                times = np.fromiter(found.values(), np.int64, len(found))
                weight = int((table[at] * times).sum())
                out.append((n_words >= least_words, int(times.sum()), weight, weight + noise(k, seed)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cols[0], pa.bool_()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                                  names=["key", "uid", "drawable", "n_features", "weight", "score"])

    rows = only(docs, key, text).toDF("key", "text").select("key", F.monotonically_increasing_id().alias("uid"), F.col("text").cast("binary"))
    scored = written(rows.mapInArrow(score, f"key {kind}, uid long, drawable boolean, n_features long, weight long, score long"))
    keys = scored.filter("drawable").select((-F.col("score")).alias("a"), F.coalesce(F.col("key").cast("long"), F.lit(LAST_ID)).alias("b"), F.col("uid").alias("c"))
    at = cutoff(keys, percent * keys.count() // 100)
    cols = ["key", "n_features", "weight", "score"]
    a, b, c = -F.col("score"), F.coalesce(F.col("key").cast("long"), F.lit(LAST_ID)), F.col("uid")
    drawn = F.lit(False) if at is None else F.col("drawable") & ((a < at[0]) | ((a == at[0]) & ((b < at[1]) | ((b == at[1]) & (c <= at[2])))))
    won = scored.filter(drawn)
    # ranks: places inside value ranges, behind the sizes of the ranges before (one short row each)
    ranged = written(won.repartitionByRange(a, b, c).sortWithinPartitions(a, b, c).select(*cols, F.monotonically_increasing_id().alias("place")))
    part = F.shiftright("place", 33)
    before = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    winners = ranged.withColumn("part", part).join(F.broadcast(before), "part").select(
        *cols, (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))
    others = scored.filter(~drawn).select(*cols, F.lit(None).cast("long").alias("rank"))
    return winners.union(others).withColumnRenamed("key", key)
