"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors of a label are turned into principal axes and ordered by the first of them. Two unit vectors with
cosine c differ by sqrt(2 - 2c) at most along any axis, so only tiles in the same or the next cell
of that width meet. In a pair of tiles leading dimensions are multiplied first; a pair goes on only
while the partial product plus the product of the remaining norms can still reach the threshold.
What goes all the way is verified in double precision on the given vectors.

Equal vectors of a label are one node with a weight, and a tile reports weights and a spanning
forest, so groups of copies of any size stay short. Defined results: NULL, zero, empty and
non-finite vectors, vectors with a NULL component and vectors without a label link with nothing; vectors of
different lengths never link; a NULL id keeps its row, links and is never the smallest id;
repeated rows are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import Forest, connected_components, only
from gaugeflow.session import checkpointed

THRESHOLD = 0.98
TILE = 1024
#: Dimensions multiplied before the first bound, and before each later one.
STEP = 8
#: What rounding may take from a bound.
SLACK = 1e-9


def principal_axes(nodes: DataFrame, dim: int) -> np.ndarray:
    """Axes of the unit vectors, most spread first, from one sum of products over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), np.float64).reshape(-1, dim)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    sums = nodes.filter(F.size("vec") == dim).select("vec").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect()
    cov = np.zeros(dim * dim)
    for i, v in sums:  # dim x dim numbers, whatever the number of vectors
        cov[i] = v
    return np.linalg.eigh(cov.reshape(dim, dim))[1][:, ::-1].copy()


def compare(a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs with cosine >= threshold. ``ta`` and ``tb`` are unit vectors in principal axes."""
    dim = ta.shape[1]

    def suffix(x):  # norms of what is left after 0, STEP, 2 STEP … dimensions
        squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
        return {k: np.sqrt(squares[:, k]) for k in range(STEP, dim, STEP)}

    ra, rb = suffix(ta), suffix(tb)
    part = ta[:, :STEP] @ tb[:, :STEP].T
    if dim > STEP:
        i, j = np.nonzero(part + np.outer(ra[STEP], rb[STEP]) >= threshold - SLACK)
    else:
        i, j = np.nonzero(part >= threshold - SLACK)
    found_i, found_j = [], []
    for at in range(0, len(i), 1 << 18):
        x, y = i[at:at + (1 << 18)], j[at:at + (1 << 18)]
        dots = part[x, y]
        for k in range(STEP, dim, STEP):
            dots = dots + np.einsum("ij,ij->i", ta[x, k:k + STEP], tb[y, k:k + STEP])
            if k + STEP < dim:
                open_ = dots + ra[k + STEP][x] * rb[k + STEP][y] >= threshold - SLACK
                x, y, dots = x[open_], y[open_], dots[open_]
        close = dots >= threshold - SLACK
        x, y = x[close], y[close]
        u, v = a[x], b[y]
        exact = np.einsum("ij,ij->i", u, v) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v)))
        found_i.append(x[exact >= threshold])
        found_j.append(y[exact >= threshold])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, int),) * 2


def _tile_rows(nodes: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(label, dim, cell, node, weight, vec): the cell is the place along the first axis, in widths no link exceeds."""
    width = np.sqrt(2 - 2 * threshold) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column(b.schema.get_field_index("vec")).to_pylist()
            cells = []
            for v in vecs:
                x = np.array(v, np.float64)
                cells.append(int(np.floor(float(x @ axes[len(v)][:, 0]) / np.linalg.norm(x) / width)))
            yield pa.record_batch([*b.columns, pa.array(cells, pa.int32())], names=[*b.schema.names, "cell"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields) + ", cell int"
    return nodes.mapInArrow(run, schema)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept): one row per row of ``vectors``."""
    rows = only(vectors, key, vec, label).toDF("key", "vec", "label").withColumn("vec", F.col("vec").cast("array<double>"))
    sound = (F.col("label").isNotNull() & F.col("vec").isNotNull()
             & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists("vec", lambda x: x != 0))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # -0.0 and 0.0 are one value
    digest = F.sha2(F.concat_ws(",", F.transform("vec", lambda x: (x + F.lit(0.0)).cast("string"))), 256)
    rows = checkpointed(rows.withColumn("code", F.when(F.col("sound"), digest)))
    # squares of very small or very large components leave the range of doubles: a power of two brings them back without rounding
    top = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    scale = F.when((top < 1e-100) | (top > 1e100), F.pow(F.lit(2.0), F.floor(F.log2(top)))).otherwise(F.lit(1.0))
    nodes = checkpointed(rows.filter("sound").groupBy("label", "code").agg(
        F.count(F.lit(1)).alias("weight"), F.min("key").alias("least"), F.first("vec").alias("vec"))
        .withColumn("scale", scale).withColumn("vec", F.transform("vec", lambda x: x / F.col("scale"))).drop("scale")
        .withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))
    dims = [r[0] for r in nodes.select("dim").distinct().collect()]
    axes = {d: principal_axes(nodes, d) for d in dims}
    placed = checkpointed(_tile_rows(nodes.select("label", "dim", "node", "weight", "vec"), axes, threshold))
    sizes = placed.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    sizes = checkpointed(sizes.select("label", "dim", "cell", "tiles"))
    # each cell with its neighbours' numbers of tiles: a short table, spread over salts for hot cells
    near = sizes
    for name, shift in (("up", 1), ("down", -1)):
        other = sizes.select("label", "dim", (F.col("cell") - shift).alias("cell"), F.col("tiles").alias(name))
        near = near.join(other, ["label", "dim", "cell"], "left")
    near = near.fillna(0, ["up", "down"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    own = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(16)).cast("int")).join(near, ["label", "dim", "cell", "salt"])
    own = own.withColumn("t", F.pmod(F.xxhash64("node", F.lit(3)), F.col("tiles")).cast("int"))
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def role(cell_a, t_a, cell_b, t_b, first):
        return F.struct(cell_a.alias("ca"), t_a.alias("ta"), cell_b.alias("cb"), t_b.alias("tb"), F.lit(first).alias("first"))

    c, t = F.col("cell"), F.col("t")
    pairs = F.concat(
        F.transform(F.sequence(t, F.col("tiles") - 1), lambda s: role(c, t, c, s, True)),
        F.transform(up_to(t), lambda s: role(c, s, c, t, False)),
        F.transform(up_to(F.col("up")), lambda s: role(c, t, c + 1, s, True)),
        F.transform(up_to(F.col("down")), lambda s: role(c - 1, s, c, t, False)))
    sent = own.select("label", "dim", "node", "weight", "vec", F.explode(pairs).alias("r")).select("label", "dim", "r.*", "node", "weight", "vec")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf["first"].to_numpy()
        x = np.array(pdf["vec"].tolist(), np.float64)
        turned = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[x.shape[1]]
        same = pdf["ca"].iloc[0] == pdf["cb"].iloc[0] and pdf["ta"].iloc[0] == pdf["tb"].iloc[0]
        node, weight = pdf["node"].to_numpy(), pdf["weight"].to_numpy()
        left, right = np.flatnonzero(one), np.flatnonzero(one if same else ~one)
        gain, forest = np.zeros(len(node), np.int64), Forest(len(node))
        for at in range(0, len(left), 256):
            l = left[at:at + 256]
            if not len(right):
                break
            i, j = compare(x[l], x[right], turned[l], turned[right], threshold)
            i, j = l[i], right[j]
            if same:
                other = i != j
                i, j = i[other], j[other]
                np.add.at(gain, i, weight[j])
            else:
                np.add.at(gain, i, weight[j])
                np.add.at(gain, j, weight[i])
            forest.union(i, j)
        root = forest.roots()
        touched = np.flatnonzero((gain > 0) | (root != np.arange(len(node))))
        return pd.DataFrame({"node": node[touched], "gain": gain[touched], "to": node[root[touched]]})

    met = checkpointed(sent.groupBy("label", "dim", "ca", "ta", "cb", "tb").applyInPandas(meet, "node long, gain long, to long"))
    gains = met.groupBy("node").agg(F.sum("gain").alias("gain"))
    comps = connected_components(met.select(F.col("node").alias("a"), F.col("to").alias("b")))
    known = nodes.select("label", "code", "node", "weight", "least").join(gains, "node", "left").join(comps, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select(
        "label", "code", (F.coalesce("gain", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = rows.filter("sound").join(known, ["label", "code"]).select("key", "n_links", "component_id")
    alone = rows.filter("NOT sound").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
