"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.session import checkpointed, shared_dir

#: A word, in Java's, Python's and DuckDB's notation alike: a run without blanks, tabs and line ends.
WORD = r"[^\x20\x09-\x0D]+"
#: Edges of a graph that one task joins, about.
EDGES = 1 << 17


def per_worker(key, build: Callable):
    """What ``build`` returns, made once in each Python worker process and kept for later tasks.

    Functions travel to executors by value, so a module's own globals start anew in every task.
    """
    store = sys.modules.setdefault("_gaugeflow_worker", types.ModuleType("_gaugeflow_worker")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns; extra columns, whatever their names, go no further."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The rows as a Parquet table in the shared folder: read again after a lost executor, not computed again."""
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table made by ``written`` whose rows are no longer wanted, lost executors or not."""
    jvm = table.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def as_unsigned(c: Column) -> Column:
    """A long's bits as sixteen lower-case hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


class Forest:
    """Union-find over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i]: roots hook onto smaller roots until nothing changes."""
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(len(self.up)) if at is None else at
        r = self.up[at]
        while True:
            nxt = self.up[r]
            if (nxt == r).all():
                break
            r = nxt
        self.up[at] = r
        return r


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge table; the component is its
    smallest node. Self-loops and edges with a NULL are ignored.

    Large-star and small-star steps, each one join and one map-side minimum, until the edges
    stop changing. Nothing but a row count and a checksum reaches the driver, and every round
    is cut by a reliable checkpoint. A hub's rows are halved by partial minima before they meet.
    First every task joins its own edges, in as many tasks as their number asks for (``EDGES``), and leaves one edge
    a node; where one task is enough that is all. Few edges in many rounds over many partitions would
    leave more files of shuffles than rows.
    """
    now = checkpointed(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .filter("a <> b").distinct())
    tasks = max(1, -(-now.count() // EDGES))
    now = checkpointed(now.coalesce(tasks).mapInArrow(_forest, f"a {now.dtypes[0][1]}, b {now.dtypes[1][1]}"))  # no step adds edges
    mark = _mark(now) if tasks > 1 else None
    while tasks > 1:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # large star: every larger neighbour hooks onto the least of the neighbourhood
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: the node and its smaller neighbours hook onto the least of them
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(small.union(least.select("a", F.col("m").alias("b"))).distinct()).coalesce(tasks)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a task's edges next to the smallest one that they lead to."""
    ends = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if ends:
        nodes, at = np.unique(np.concatenate([np.stack(e) for e in ends], axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        forest = Forest(len(nodes))
        forest.union(a, b)
        root = forest.roots()
        below = root != np.arange(len(nodes))
        yield pa.record_batch([pa.array(nodes[below]), pa.array(nodes[root[below]])], names=["a", "b"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def cut_words(text: str, starts: list[int], size: int) -> str:
    """The words starts[i] to starts[i] + size - 1 of a text with what stands between them, one blank between pieces."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    merged: list[list[int]] = []
    for s in starts:
        end = min(s + size, len(spans))
        if merged and merged[-1][1] == s:
            merged[-1][1] = end
        else:
            merged.append([s, end])
    return " ".join(text[spans[a][0]:spans[b - 1][1]] for a, b in merged)
