"""Prediction tables: accuracy, macro-F1, confusion, silhouette, picked examples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeflow.session import checkpointed


def count_pairs(preds: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The K x K counts everything else derives from; the prediction rows are read once."""
    return preds.groupBy(*group, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def class_scores(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of every class seen as truth or prediction (0 for 0/0)."""
    sides = pairs.select(*group, "n", F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.lit(True).alias("truth")),
        F.struct(F.col("y_pred").alias("label"), F.lit(False).alias("truth")))).alias("s"),
        (F.col("y_true") == F.col("y_pred")).alias("hit"))
    c = sides.groupBy(*group, F.col("s.label").alias("label")).agg(
        F.sum(F.when(F.col("s.truth"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("s.truth"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("s.truth") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return c.withColumn("precision", ratio(tp, predicted)).withColumn("recall", ratio(tp, support)).withColumn(
        "f1", ratio(2.0 * tp, support + predicted))


def accuracy_macro_f1(preds: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    per = class_scores(count_pairs(preds, group), group)
    return per.groupBy(*group).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"),
        F.sum("support").cast("long").alias("n"))


def confusion_matrix(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """All label pairs with counts, shares of the true row (0 for an empty row).

    The label list (a class dictionary) is attached to each label as an array.
    """
    names = labels.agg(F.array_sort(F.collect_set("label")).alias("all"))
    grid = labels.select(F.col("label").alias("y_true")).distinct().withColumn("y_pred", F.explode(names.scalar()))
    m = grid.join(count_pairs(preds), ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = F.sum("n").over(Window.partitionBy("y_true"))
    return m.withColumn("share", F.when(row > 0, F.col("n") / row).otherwise(0.0))


def implied_accuracy(matrix: DataFrame) -> DataFrame:
    hits = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    return matrix.agg((hits / F.sum("n")).alias("accuracy"))


def prediction_dump(preds: DataFrame, classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, class name, truth, prediction, correct) with names from the class dictionary."""
    names = classes.select(F.col("label").alias("y_true"), F.col("class").alias("class_name"))
    return preds.join(names, "y_true").select(
        *keys, "class_name", "y_true", "y_pred", (F.col("y_true") == F.col("y_pred")).cast("int").alias("correct"))


def example_windows(preds: DataFrame, panels: int = 5, window: str = "window_id") -> DataFrame:
    """First correct window of each of the first classes, else the class's first window."""
    order = F.struct(F.when(F.col("y_true") == F.col("y_pred"), 0).otherwise(1), F.col(window))
    first = preds.groupBy("y_true").agg(
        F.min_by(window, order).alias(window), F.max((F.col("y_true") == F.col("y_pred")).cast("int")).alias("has_correct"))
    return first.orderBy("y_true").limit(panels)


def attach_saturation(picks: DataFrame, gates: DataFrame, tau: float = 0.9, window: str = "window_id") -> DataFrame:
    over = F.aggregate("series", F.lit(0), lambda acc, g: acc + F.when(g > tau, 1).otherwise(0))
    sat = gates.join(picks.select(window), window, "left_semi").groupBy(window).agg(
        (F.sum(over) / F.sum(F.size("series"))).alias("saturation"))
    return picks.join(sat, window, "left")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, d: acc + d)


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per class, built element by element with combinable sums."""
    parts = df.select(label, F.posexplode(vector).alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("v"))
    return parts.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centroid"))


def centroid_scores(df: DataFrame, centres: DataFrame, keys: Sequence[str], label: str, vector: str) -> DataFrame:
    """Score of each window for each class: minus its distance to the class centroid.

    The centroids (one short vector per class of the dictionary) come in as one array value.
    """
    table = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("class"), "centroid"))).alias("t"))
    scored = df.select(*keys, F.col(vector).alias("_v"), F.explode(table.scalar()).alias("_c"))
    return scored.select(*keys, F.col("_c.class").alias("class"),
                         (-F.sqrt(squared_distance(F.col("_v"), F.col("_c.centroid")))).alias("score"))


def nearest_class(df: DataFrame, centres: DataFrame, keys: Sequence[str], label: str, vector: str, out: str = "y_pred") -> DataFrame:
    """Class of the nearest centroid, the lowest label on a tie, found inside each row:
    scores of all classes are neither written out nor shuffled."""
    table = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("class"), "centroid"))).alias("t"))
    d = df.select(*keys, F.col(vector).alias("_v"), table.scalar().alias("_t"))
    reached = F.transform("_t", lambda c: F.struct(squared_distance(F.col("_v"), c["centroid"]).alias("d"), c["class"].alias("class")))
    return d.select(*keys, F.array_min(reached)["class"].alias(out))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs; close pairs are taken from the differences, where products would round."""
    both = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    square = both - 2.0 * (x @ y.T)
    i, j = np.nonzero(square <= 1e-3 * both)
    for at in range(0, len(i), 1 << 16):
        u, v = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
        square[u, v] = ((x[u] - y[v]) ** 2).sum(1)
    return np.sqrt(np.maximum(square, 0.0))


def silhouette(points: DataFrame, key: str, label: str, vector: str, tile: int = 4096, limit: int | None = None) -> DataFrame:
    """Mean silhouette (Euclidean) of all points.

    Points are dealt to blocks by a hash. Each pair of blocks meets once, in a task of its own, which returns one
    partial sum of distances per point of either side and label; so no pair leaves a task, and a point is sent once per block. The work is quadratic by definition:
    with ``limit`` more points than that are refused. A point without a label scores 0 and is no one's neighbour; points without a vector, or
    with a missing component, are left out.
    """
    points = points.filter(F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull()))
    pts = checkpointed(points.select(F.col(label).cast("string").alias("label"), F.col(vector).alias("v"), F.xxhash64(key).alias("h"))
                       .withColumn("row", F.monotonically_increasing_id()))
    size = pts.count()
    if limit is not None and size > limit:
        raise ValueError(f"{size} points; at most {limit} are wanted")
    blocks = max(1, -(-size // tile))
    named = pts.filter("label IS NOT NULL").withColumn("own", F.pmod(F.xxhash64("h", "row"), F.lit(blocks)).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j")))
    sent = named.select(F.explode(met).alias("p"), "own", "row", "label", "v").select("p.i", "p.j", (F.col("own") == F.col("p.i")).alias("low"), "row", "label", "v")

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        low, rows = pdf["low"].to_numpy(), pdf["row"].to_numpy()
        x = np.array(pdf["v"].tolist(), float)
        codes, names = pd.factorize(pdf["label"].to_numpy())
        member = np.eye(len(names))[codes]
        one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        mine, across = (np.arange(len(rows)),) * 2 if one else (np.flatnonzero(low), np.flatnonzero(~low))
        sums = np.zeros((len(rows), len(names)))
        for at in range(0, len(mine) if len(across) else 0, 256):
            part = mine[at:at + 256]
            d = _distances(x[part], x[across])
            if one:
                d[np.arange(len(part)), part] = 0.0
            else:
                sums[across] += d.T @ member[part]
            sums[part] += d @ member[across]
        return pd.DataFrame({"row": rows, "labels": [list(names)] * len(rows), "sums": list(sums)})

    parts = sent.groupBy("i", "j").applyInPandas(measure, "row long, labels array<string>, sums array<double>")
    sums = parts.select("row", F.explode(F.arrays_zip("labels", "sums")).alias("p")).groupBy("row", F.col("p.labels").alias("other")).agg(F.sum("p.sums").alias("s"))
    sizes = named.groupBy(F.col("label").alias("other")).agg(F.count(F.lit(1)).alias("m"))
    same = F.col("label") == F.col("other")
    per = sums.join(named.select("row", "label"), "row").join(sizes, "other").groupBy("row").agg(
        F.max(F.when(same & (F.col("m") > 1), F.col("s") / (F.col("m") - 1))).alias("a"), F.min(F.when(~same, F.col("s") / F.col("m"))).alias("b"))
    top = F.greatest("a", "b")
    score = F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    scored = per.select(score.alias("s")).union(pts.filter("label IS NULL").select(F.lit(0.0).alias("s")))
    return scored.agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))
