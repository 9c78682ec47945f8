"""SimHash fingerprints and near-duplicate classes by multi-index hashing.

Defined results: a NULL text counts as empty; a text without words has fingerprint zero and
links like any other; a text with fewer words than a shingle is one shingle. Repeated rows and
equal texts share a fingerprint and so a class. Rows with a NULL id keep their row and class;
the class id is the smallest non-NULL id. Texts are read whole, in pieces of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import Forest, connected_components, only
from gaugeflow.session import checkpointed

WORDS, SEED, RADIUS = 3, 42, 3
#: Shingles whose bits are unpacked at once.
STEP = 1 << 16
#: Pairs of a bucket that a plain join compares; larger buckets are compared in tiles.
PLAIN_PAIRS = 4096
TILE = 1024


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text (UTF-8), as an unsigned number."""
    w = (text or b"").lower().split()  # lowers A-Z and splits at blanks, tabs and line ends only
    if not w:
        return 0
    digest = partial(xxhash.xxh64_digest, seed=seed)
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) >= words else iter([b" ".join(w)])
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        h = b"".join(digest(s) for s, _ in zip(shingles, range(min(STEP, n - at))))
        ones += np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str, text: str, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(key, fp): the fingerprint of every row's whole text as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in b.column(1)], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(
        run, f"key {kind}, fp long")


def _halves(fp):
    return F.array(
        F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned(fp, 32).alias("seg_key")),
        F.struct(F.lit(1).alias("seg"), fp.bitwiseAND(F.lit(0xFFFFFFFF)).alias("seg_key")))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints at most ``radius`` (up to 3) bits apart
    into the same components.

    Of two such fingerprints one 32-bit half differs in at most one bit. Every fingerprint is
    filed under both halves and looks up the ball of radius one around each half. A pair whose
    halves differ by one bit is found from the side where that bit is 0, so only bits that are 0
    are flipped. Matches are verified over all 64 bits. Buckets with few pairs are compared by a
    join; larger ones (many near copies share a half) in tiles, which report a spanning forest
    of their verified links instead of the pairs.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two halves with balls of radius one find distances up to 3")
    table = fps.select("fp", F.explode(_halves(F.col("fp"))).alias("h")).select("h.seg", "h.seg_key", "fp")
    flips = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(31)),
                    lambda i: F.col("seg_key").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))),
        lambda k: k != F.col("seg_key"))
    sizes = checkpointed(table.groupBy("seg", "seg_key").agg(F.count(F.lit(1)).alias("n_table")))
    probes = table.select("seg", F.explode(flips).alias("seg_key"), "fp").join(sizes.select("seg", "seg_key"), ["seg", "seg_key"])
    probes = checkpointed(probes)
    hits = probes.groupBy("seg", "seg_key").agg(F.count(F.lit(1)).alias("n_probe"))
    buckets = (
        sizes.join(hits, ["seg", "seg_key"], "left").withColumn("n_probe", F.coalesce("n_probe", F.lit(0)))
        .filter("n_table > 1 OR n_probe > 0")
        .withColumn("n_all", F.col("n_table") + F.col("n_probe")))
    buckets = checkpointed(buckets)
    sides = table.select("seg", "seg_key", "fp", F.lit(True).alias("filed")).union(
        probes.select("seg", "seg_key", "fp", F.lit(False).alias("filed")))
    plain = F.col("n_table") * F.col("n_all") <= PLAIN_PAIRS
    few = buckets.filter(plain).select("seg", "seg_key")
    left = table.join(few, ["seg", "seg_key"]).withColumnRenamed("fp", "a")
    right = sides.join(few, ["seg", "seg_key"]).withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right, ["seg", "seg_key"]).filter(near & (~F.col("filed") | (F.col("a") < F.col("b")))).select("a", "b")
    return pairs.union(_tiled(sides.join(buckets.filter(~plain), ["seg", "seg_key"]), radius))


def _tiled(rows: DataFrame, radius: int) -> DataFrame:
    """Every filed row of a bucket against every row of it, tile by tile."""
    across = F.ceil(F.col("n_all") / TILE).cast("int")
    down = F.ceil(F.col("n_table") / TILE).cast("int")
    own = rows.filter("filed").withColumn("i", F.pmod(F.xxhash64("fp"), down)).withColumn(
        "j", F.explode(F.sequence(F.lit(0), across - 1))).withColumn("row", F.lit(True))
    others = rows.withColumn("j", F.pmod(F.xxhash64("fp", F.lit(1)), across)).withColumn(
        "i", F.explode(F.sequence(F.lit(0), down - 1))).withColumn("row", F.lit(False))
    keys = ["seg", "seg_key", "i", "j"]
    cols = [*keys, "row", "fp"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, row = pdf["fp"].to_numpy(), pdf["row"].to_numpy()
        nodes, at = np.unique(fp, return_inverse=True)
        a, b, forest = at[row], at[~row], Forest(len(nodes))
        for s in range(0, len(a), 256):
            bits = np.bitwise_count(nodes[a[s:s + 256], None] ^ nodes[b][None, :])
            x, y = np.nonzero(bits <= radius)
            forest.union(a[s:s + 256][x], b[y])
        root = forest.roots()
        open_ = root != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[open_], "b": nodes[root[open_]]})

    cast = [F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")]
    both = own.select(*[c for c in cols if c not in "ij"], *cast).union(others.select(*[c for c in cols if c not in "ij"], *cast))
    return both.groupBy(*keys).applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id): one row per row of ``docs``; component_id is the smallest key
    reachable over links. Equal fingerprints are one node from the start, so a group of copies
    of any size costs one row here."""
    rows = checkpointed(fingerprints(only(docs, key, text), key, text))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("key").alias("least")))
    comps = connected_components(links(nodes.select("fp"), radius))
    named = nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = checkpointed(named.select("fp", "component").join(least, "component").select("fp", "component_id"))
    return rows.join(classes, "fp").select(F.col("key").alias(key), "fp", "component_id")
