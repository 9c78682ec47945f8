"""Centroid clustering on whole numbers, with drift bounds tightened by geometry.

Every vector keeps a lower bound of its distance to all centroids but its own. When centroids move, its distance to its
own is computed anew; while that lies below the bound nothing else can be nearer, and only the vectors left are compared with all centroids.

The bound is loosened by less than the full drift. A cluster's vectors lie in a ball around its old centroid. For a centroid moving from a to b, with
middle m and drift d, a vector x gains |x-a| - |x-b| = 2 d (x-m).u / (|x-a| + |x-b|), u being the direction of the move, and |x-a| + |x-b| >= 2 |x-m|; so it gains d cos(x-m, u) at most.
In the plane of the ball's centre and the move, the ball is seen from m under a half angle, which bounds the cosine for all of the cluster at once.
A centroid that moves away from the ball loosens nothing.

A pass reads vectors, assignments and bounds, and writes the new ones as a table; its batches also carry sums, radii and inertia by cluster, so the vectors
are read once a round. Distances are exact whole numbers; bounds are doubles and decide only where they are apart by more than rounding.

Defined results: only vectors of exactly ``dim`` finite components are kept, others get no row; repeated rows and vectors with NULL ids
count as vectors of their own, a NULL id drawn by the hash of the empty string; equal hashes are ordered by components; with fewer vectors than ``k`` each one is a first
centroid; an empty table gives no rows; scaled components are held within ``FAR`` of zero, so that distances fit a long; other columns go no further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import discard, only, written

DIM, K, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Scaled components beyond are moved here.
FAR = 1 << 26
#: What rounding may take from a bound, as a share.
SLACK = 1e-9
#: Up to this component, products of doubles are whole and exact.
EXACT = 1 << 20


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids."""
    top = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if top <= EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([own_distance(x, c[None]) for c in centroids], axis=1)


def own_distance(x: np.ndarray, centroid_of: np.ndarray) -> np.ndarray:
    gap = x - centroid_of
    return np.einsum("ij,ij->i", gap, gap)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For every cluster, how much nearer another centroid may have come to any vector of its ball."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    move, middle = new - old, (old + new) / 2
    drift = np.linalg.norm(move, axis=1)
    unit = move / np.where(drift > 0, drift, 1)[:, None]
    out = np.zeros(len(old))
    for i, (centre, r) in enumerate(zip(old, radius)):
        to = centre - middle
        far = np.linalg.norm(to, axis=1)
        inside = far <= r * (1 + SLACK)
        safe = np.where(inside | (far == 0), 1, far)
        half = np.arcsin(np.minimum(r / safe, 1)) + SLACK
        angle = np.arccos(np.clip((to * unit).sum(1) / safe, -1, 1))
        cos = np.where(inside, 1.0, np.maximum(np.cos(np.maximum(angle - half, 0)), 0))
        gain = drift * np.minimum(cos + SLACK, 1) * (1 + SLACK)
        gain[drift == 0] = 0
        gain[i] = 0
        out[i] = gain.max(initial=0)
    return out


def assign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray | None = None, bound: np.ndarray | None = None,
           loosened: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, lower bound to the others, rows compared with all centroids)."""
    n = len(x)
    if cluster is None:
        cluster, bound, open_ = np.zeros(n, np.int32), np.zeros(n), np.arange(n)
        own = np.zeros(n, np.int64)
    else:
        bound = bound - loosened[cluster]
        own = own_distance(x, centroids[cluster])
        open_ = np.flatnonzero(np.sqrt(own) * (1 + SLACK) >= bound * (1 - SLACK) - SLACK)
        cluster = cluster.copy()
    if len(open_):
        d = distances(x[open_], centroids)
        at = d.argmin(1)  # the first of equals
        rows = np.arange(len(open_))
        cluster[open_], own[open_] = at, d[rows, at]
        d[rows, at] = np.iinfo(np.int64).max
        bound[open_] = np.sqrt(d.min(1).astype(np.float64))
    return cluster, own, bound, len(open_)


def _summary(x: np.ndarray, cluster: np.ndarray, own: np.ndarray, scanned: int, k: int) -> np.ndarray:
    """By cluster: size, inertia, largest squared distance, rows scanned (first cluster), then the sum of every component."""
    out = np.zeros((k, 4 + x.shape[1]), np.int64)
    out[:, 0] = np.bincount(cluster, minlength=k)
    np.add.at(out[:, 1], cluster, own)
    np.maximum.at(out[:, 2], cluster, own)
    out[0, 3] = scanned
    order = np.argsort(cluster, kind="stable")
    met = np.flatnonzero(out[:, 0])
    out[met, 4:] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(out[met, 0])[:-1]]), axis=0) if len(met) else 0
    return out


def _pass(rows: DataFrame, kind: str, dim: int, centroids: np.ndarray, loosened: np.ndarray | None) -> DataFrame:
    """The table after one assignment; ``summary`` stands on the first row of every batch."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            before = (None, None) if loosened is None else (b.column(2).to_numpy(), b.column(3).to_numpy())
            cluster, own, bound, scanned = assign(x, centroids, *before, loosened)
            summary = pa.array([_summary(x, cluster, own, scanned, k).tobytes()] + [None] * (len(x) - 1), pa.binary())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array(bound), pa.array(own), summary],
                                  names=["key", "vec", "cluster", "bound", "distance", "summary"])

    columns = ["key", "vec"] + ([] if loosened is None else ["cluster", "bound"])
    return written(rows.select(*columns).mapInArrow(run, f"key {kind}, vec array<int>, cluster int, bound double, distance long, summary binary"))


def _totals(state: DataFrame, k: int, dim: int) -> np.ndarray:
    """Summaries of all batches in one; k x (4 + dim) numbers reach the driver."""
    width = 4 + dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for s in b.column(0):
                one = np.frombuffer(s.as_py(), np.int64).reshape(k, width)
                if total is None:
                    total = one.copy()
                else:
                    radius = np.maximum(total[:, 2], one[:, 2])
                    total += one
                    total[:, 2] = radius
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(k * width, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    parts = state.filter("summary IS NOT NULL").select("summary").mapInArrow(run, "i int, v long")
    found = parts.groupBy("i").agg(F.sum("v").alias("total"), F.max("v").alias("most")).collect()
    out = np.zeros(k * width, np.int64)
    for i, total, most in found:
        out[i] = most if i % width == 2 else total
    return out.reshape(k, width)


def cluster_rounds(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED,
                   dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, np.ndarray, list[int]]:
    """(table of key, vec, cluster, distance; final centroids; inertia by cluster; rows compared with all centroids in every pass)."""
    kind = vectors.schema[key].dataType.simpleString()
    rows = only(vectors, key, vec).toDF("key", "vec").withColumn("vec", F.col("vec").cast("array<double>"))
    sound = (F.size("vec") == dim) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = F.transform("vec", lambda v: F.greatest(F.least(F.floor(F.least(F.greatest(v * scale, F.lit(-2.0 * FAR)), F.lit(2.0 * FAR))), F.lit(FAR)), F.lit(-FAR)).cast("int"))
    rows = rows.filter(F.coalesce(sound, F.lit(False))).select("key", held.alias("vec"))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    first = rows.select(mark.alias("mark"), "vec").orderBy("mark", "vec").limit(k).collect()
    centroids = np.array([r.vec for r in first], np.int64).reshape(-1, dim)
    if not len(centroids):
        return rows.select("key", "vec", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids, np.zeros(0, np.int64), []
    state, scanned, loosened = rows, [], None
    for turn in range(rounds + 1):
        new = _pass(state, kind, dim, centroids, loosened)
        if turn:
            discard(state)
        state = new
        totals = _totals(state, len(centroids), dim)
        scanned.append(int(totals[0, 3]))
        if turn == rounds:
            break
        filled = totals[:, 0] > 0
        moved = centroids.copy()
        moved[filled] = totals[filled, 4:] // totals[filled, :1]  # rounds down, below zero too
        loosened = loosening(centroids, moved, np.sqrt(totals[:, 2].astype(np.float64)))
        centroids = moved
    return state.select("key", "vec", "cluster", "distance"), centroids, totals[:, 1], scanned


def clusters(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED,
             dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector that is kept."""
    state, centroids, inertia, _ = cluster_rounds(vectors, key, vec, k, rounds, seed, dim, scale)
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = vectors.sparkSession.createDataFrame(
        [(i, int(n), int(inertia.sum()), m) for i, (n, m) in enumerate(zip(inertia, marks))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select(F.col("key").alias(key), "cluster", "distance").join(F.broadcast(facts), "cluster").select(  # one row per cluster
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
