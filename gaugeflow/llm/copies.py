"""Classes of near copies: texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

First come SimHash fingerprints of the shingles and multi-index hashing (``simhash``): texts whose fingerprints are equal or
a few bits apart are candidates. Similar texts may be more bits apart than any radius reaches, so what is not yet in
one class is searched exactly. No pair is missed: texts are ordered by one global order of shingles, rare ones first, and two sets of sizes n >= m
with similarity t share a shingle among the first n - ceil(t n) + 1 of the one and the first m - ceil(t m) + 1 of the
other. Texts that share such a shingle are candidates, and every candidate is verified on the whole sets. The order
only decides how many candidates there are, so the common shingles may come from a sample.

Defined results: a NULL text counts as empty; texts of the same words in the same order (lower case) are one node;
texts without words are one class and link with nothing else; a text with fewer words than a shingle is one shingle.
Shingles and texts are told apart by 64-bit hashes. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.llm import simhash
from gaugeflow.llm.common import connected_components, only, written
from gaugeflow.session import checkpointed

WORDS, SIMILARITY = 5, 0.8
#: One text of so many is looked at for common shingles; a shingle is common from so many of these on; so many are sent to workers.
ONE_OF, COMMON, MOST = 16, 8, 1 << 16
#: Least bits of a set's bitmap. Two bitmaps differ in at most as many bits as the sets differ in shingles.
BITS = 1024
#: Texts of a bucket that all others are compared with in a round; another round follows while pair by pair there would be more than
#: so many pairs to a text, so many rounds at most.
HUBS, PAIRS, ROUNDS = 16, 4, 2
#: Words whose hashes a worker remembers; rows of a batch of texts that are looked at together.
REMEMBERED, ROWS = 1 << 16, 1 << 11
#: Cells of keys by which texts are left out before they meet the pairs that need them.
CELLS = 1 << 20
#: Leading shingles in a bucket, about; the number of buckets follows the texts. A task sorts when so many wait.
BUCKET, HELD = 1 << 18, 1 << 20
#: A shingle that leads no more texts than this has them paired where they meet; so many entries at a time.
FEW, AT_ONCE = 32, 1 << 15
ENTRY = np.dtype([("sig", np.uint64), ("node", np.int64), ("n", np.int32), ("place", np.int32), ("out", bool)])
#: What rounding may take from a bound.
SLACK = 1e-9


def shingles(text: bytes | None, known: dict, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text (UTF-8)."""
    w = (text or b"").lower().split()  # as simhash.fingerprint()
    if not w:
        return np.zeros(0, np.uint64)
    if len(known) > REMEMBERED:
        known.clear()
    ids = np.array([known[x] if x in known else known.setdefault(x, xxhash.xxh64_intdigest(x)) for x in w], np.uint64)
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ ids[i:len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def text_code(text: bytes | None) -> int:
    """A signed hash of a text's words."""
    return xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split()), 1) - (1 << 63)


def bitmap(h: np.ndarray) -> bytes:
    """For each cell, whether an odd number of shingles falls in it. Cells are BITS, or as many as there are shingles, as a power of two."""
    cells = max(BITS, 1 << (len(h) - 1).bit_length() if len(h) else 0)
    return np.packbits(np.bincount((h % np.uint64(cells)).astype(np.int64), minlength=cells) & 1).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Differing bits of two bitmaps, the longer one folded to the length of the other."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint8).reshape(-1, size)) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles that a similar text must share one of, rare ones first."""
    size = len(h) - math.ceil(similarity * len(h) - SLACK) + 1 if len(h) else 0
    if len(common) and len(h):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h[np.lexsort((h, np.where(common[at] == h, counts[at], 0)))]
    return h[:size]


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a sample of texts, sorted, with their numbers of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            found = [shingles(t.as_py(), known, words) for t in b.column("text") if text_code(t.as_py()) % ONE_OF == 0]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    top = rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    got = top.orderBy(F.desc("n"), "h").limit(MOST).collect()  # at most MOST short rows
    h, n = np.array([r.h for r in got], np.int64).view(np.uint64), np.array([r.n for r in got], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _fit(n: Column, at: Column, m: Column, other_at: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles whose first shared ones stand at these places can be similar."""
    need = F.ceil((n + m) * (similarity / (1 + similarity)) - SLACK)
    return (n - at >= need) & (m - other_at >= need)


def bounded(pairs: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose bitmaps allow them to be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = np.array([bits_apart(x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())], np.int64)
            most = (b.column("n").to_numpy() + b.column("m").to_numpy()) * ((1 - similarity) / (1 + similarity)) + SLACK
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(apart <= most))

    both = pairs.join(bits.toDF("a", "x", "n"), "a").join(bits.toDF("b", "y", "m"), "b")
    return both.select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) of nodes that are similar by the whole sets of their texts (node, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        unpack = zstandard.ZstdDecompressor().decompress
        last = (None, None)  # pairs come ordered by their second text
        for b in batches:
            keep = []
            for x, node, y in zip(b.column("x"), b.column("b").to_pylist(), b.column("y")):
                if node != last[0]:
                    last = node, shingles(unpack(y.as_py()), known, words)
                x, y = shingles(unpack(x.as_py()), known, words), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - SLACK)
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    return both.select("a", "x", "b", "y").mapInArrow(run, "a long, b long")


def needed_cells(pairs: DataFrame) -> np.ndarray:
    """One bit a cell, set where a text of the pairs falls in it. The bits are put together by Spark: CELLS of them reach the driver, in one job."""
    at = pairs.select(F.explode(F.array("a", "b")).alias("node")).select((F.pmod("node", F.lit(CELLS)) + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    cells = np.zeros(CELLS // 8, np.uint8)
    for r in parts.collect():
        cells.reshape(-1, len(r.bits))[r.part - 1] = np.frombuffer(r.bits, np.uint8)
    return cells


def _in_cells(batches: Iterator[pa.RecordBatch], cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(node, packed) of the texts whose cell is wanted, so that few texts are shuffled that no pair needs; copies that come together once."""
    wanted = np.unpackbits(cells, bitorder="little").astype(bool)
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
        got = {}
        for t in b.column("text"):  # one by one: a batch of texts is not held twice
            t = t.as_py()
            if wanted[(c := text_code(t)) % CELLS] and c not in got:
                got[c] = pack(t or b"")
        yield pa.record_batch([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.binary())], names=["node", "packed"])


def _spread(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, entries): the leading shingles of a batch of texts, as one packed array of ``ENTRY`` columns a bucket."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        node, first = np.unique(b.column("node").to_numpy(), return_index=True)  # copies in one batch are filed once
        heads = [np.frombuffer(b.column("head")[int(i)].as_py(), np.uint64) for i in first]
        size = np.array([len(x) for x in heads], np.int64)
        sig = np.concatenate([np.zeros(0, np.uint64), *heads])
        # 40 bits tell the shingles of a bucket apart; two that they confuse only make a candidate more
        cols = [(sig & np.uint64(0xFFFFFFFF)).astype(np.uint32), (sig >> np.uint64(32)).astype(np.uint8), np.repeat(node, size), np.repeat(b.column("n").to_numpy()[first], size),
                np.concatenate([np.zeros(0, np.int32), *[np.arange(k, dtype=np.int32) for k in size]])]
        at = _bucket(sig, buckets)
        order = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[order], prepend=-1, append=buckets))
        rows = [(int(at[order[s]]), pack(b"".join(c[order[s:e]].tobytes() for c in cols))) for s, e in zip(edges, edges[1:])]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "entries"])


def _bucket(sig: np.ndarray, buckets: int) -> np.ndarray:
    return ((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _settle(held: np.ndarray, few: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(kept, sent) of entries: what goes out is every entry of a shingle of more than ``few`` texts that is not out yet;
    one entry of such a shingle is kept to meet later ones, and all entries of the others."""
    held = held[np.lexsort((~held["out"], held["node"], held["sig"]))]
    fresh = np.ones(len(held), bool)
    fresh[1:] = (held["sig"][1:] != held["sig"][:-1]) | (held["node"][1:] != held["node"][:-1])
    held = held[fresh]
    starts = np.flatnonzero(np.diff(held["sig"], prepend=~held["sig"][:1]))
    count = np.diff(starts, append=len(held))
    shared = np.repeat((count > few) | np.logical_or.reduceat(held["out"], starts), count)
    sent = held[shared & ~held["out"]]
    held["out"] |= shared
    keep = ~shared
    keep[starts] = True
    return held[keep], sent


def _pairs_of_few(held: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """(greater, smaller) nodes of the entries of each shingle that can be similar by their sizes and places; entries come
    ordered by shingle and node, and a pair is given once for so many entries."""
    starts = np.flatnonzero(np.diff(held["sig"], prepend=~held["sig"][:1]))
    cuts = np.unique(np.append(starts[np.searchsorted(starts, np.arange(0, len(held), AT_ONCE), side="right") - 1], len(held))) if len(held) else []
    for s, e in zip(cuts, cuts[1:]):
        part, found = held[s:e], []
        for apart in range(1, FEW):
            x, y = part[:-apart], part[apart:]
            same = x["sig"] == y["sig"]
            if not same.any():
                break
            x, y = x[same], y[same]
            n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
            need = np.ceil((n + m) * (similarity / (1 + similarity)) - SLACK)
            fit = (n - x["place"] >= need) & (m - y["place"] >= need)
            found.append(np.stack([y["node"][fit], x["node"][fit]], 1))
        if found:
            yield np.unique(np.concatenate(found), axis=0)


MEMBER = "sig long, node long, n int, place int, other long"


def _members(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(sig, node, n, place) of the shingles that lead more than ``FEW`` texts, and (node, other) for the pairs of the others'
    texts. What a task holds is bounded by ``FEW`` texts of each of its distinct shingles, however many one of them leads."""
    unpack = zstandard.ZstdDecompressor().decompress
    held, waiting, rows = np.zeros(0, ENTRY), [], 0

    def emit(sent: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(sent), 1 << 16):
            part = sent[at:at + (1 << 16)]
            yield pa.record_batch([pa.array(part["sig"].view(np.int64)), *[pa.array(np.ascontiguousarray(part[c])) for c in ("node", "n", "place")], pa.nulls(len(part), pa.int64())],
                                  names=["sig", "node", "n", "place", "other"])

    for b in batches:
        for bucket, raw in zip(b.column("bucket").to_pylist(), b.column("entries")):
            raw = unpack(raw.as_py())
            k = len(raw) // 21
            part = np.zeros(k, ENTRY)
            part["sig"] = np.frombuffer(raw, np.uint32, k) | np.frombuffer(raw, np.uint8, k, 4 * k).astype(np.uint64) << np.uint64(32) | np.uint64(bucket << 40)
            for c, kind, at in (("node", np.int64, 5), ("n", np.int32, 13), ("place", np.int32, 17)):
                part[c] = np.frombuffer(raw, kind, k, at * k)
            waiting.append(part)
            rows += k
            if rows > max(HELD, 2 * len(held)):
                held, sent = _settle(np.concatenate([held, *waiting]), FEW)
                waiting, rows = [], 0
                yield from emit(sent)
    if waiting:
        held, sent = _settle(np.concatenate([held, *waiting]), FEW)
        yield from emit(sent)
    for p in _pairs_of_few(held[~held["out"]], similarity):
        for at in range(0, len(p), 1 << 16):
            a, b = (pa.array(np.ascontiguousarray(p[at:at + (1 << 16), i])) for i in (0, 1))
            empty = [pa.nulls(len(a), k) for k in (pa.int64(), pa.int32(), pa.int32())]
            yield pa.record_batch([empty[0], a, *empty[1:], b], names=["sig", "node", "n", "place", "other"])


def fingerprint_pairs(nodes: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """Pairs (a, b) of nodes that join nodes of equal fingerprints, and fingerprints at most ``radius`` bits apart."""
    heads = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    equal = nodes.join(heads, "fp").select(F.col("node").alias("x"), F.col("head").alias("y"))
    near = simhash.links(heads.select("fp"), radius).join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").select("x", "y")
    return equal.union(near).filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _apart(now: DataFrame) -> DataFrame:
    """(sig, largest, pairs) of the buckets with more than one class: their largest class, and the pairs between its texts and the others."""
    sizes = now.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("size"))
    found = sizes.groupBy("sig").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("texts"))
    return found.filter(F.col("top.size") < F.col("texts")).select(
        "sig", F.col("top.component").alias("largest"), ((F.col("texts") - F.col("top.size")) * F.col("texts")).alias("pairs"))


def _in_two_classes(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The pairs (a, b) of nodes that are not in one class yet."""
    if comps is None:
        return pairs
    known = pairs.join(comps.toDF("a", "x"), "a", "left").join(comps.toDF("b", "y"), "b", "left")
    return known.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


OTHER = ("node", "n", "place", "component")


def _with_hubs(now: DataFrame, apart: DataFrame, turn: int) -> DataFrame:
    """Texts of a bucket next to up to ``HUBS`` of its texts that are in another class."""
    now = now.join(apart.select("sig"), "sig")
    by = F.xxhash64("node", F.lit(turn))
    hubs = now.groupBy("sig", F.pmod(by, F.lit(HUBS)).alias("slot")).agg(F.min(F.struct(by.alias("by"), *OTHER)).alias("hub"))
    hubs = hubs.select("sig", *[F.col(f"hub.{c}").alias(f"other_{c}") for c in OTHER])
    return now.join(hubs, "sig").filter("component <> other_component")


def _rest(now: DataFrame, apart: DataFrame) -> DataFrame:
    """Texts outside the largest class of their bucket next to all its texts that are in another class than they."""
    now = checkpointed(now.join(apart.select("sig", "largest"), "sig").select("sig", *OTHER, "largest"))
    others = now.select("sig", *[F.col(c).alias(f"other_{c}") for c in OTHER], F.col("component").eqNullSafe(F.col("largest")).alias("in_largest"))
    few = now.filter("component <> largest").select("sig", *OTHER)
    return few.join(others, "sig").filter("component <> other_component AND (in_largest OR component < other_component)")


def near_copies(docs: DataFrame, key: str, text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, component_id): one row per row of ``docs``, whose keys are unique and not NULL; component_id is the
    smallest key reachable over pairs of similar texts.

    Pairs that SimHash finds are verified first. Then come the pairs of small buckets (at most ``FEW`` texts that share a leading
    shingle). A larger bucket is compared with a few of its texts, with others in the next round; only texts that are not in its
    largest class by then are compared with all of it. So a large group of near copies costs few pairs.
    """
    rows = only(docs, key, text).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    common, counts = _common(rows.select("text"), words)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            node, cols = [], []
            done: dict = {}  # copies that come together are shingled once
            for t in b.column(1):  # one by one: a batch of texts is not held twice
                t = t.as_py()
                c = text_code(t)
                if c not in done:
                    h = shingles(t, known, words)
                    fp = simhash.fingerprint(t, words)
                    done[c] = bitmap(h), len(h), prefix(h, similarity, common, counts).tobytes(), fp - (fp >> 63 << 64)
                node.append(c)
                cols.append(done[c])
            bits, n, head, fp = zip(*cols) if cols else ((), (), (), ())
            yield pa.record_batch([b.column(0), pa.array(node, pa.int64()), pa.array(bits, pa.binary()), pa.array(n, pa.int32()), pa.array(head, pa.binary()),
                                   pa.array(fp, pa.int64())], names=["key", "node", "bits", "n", "head", "fp"])

    # one pass over the texts; what is known of each is a columnar table, of which later steps read the columns they want
    coded = written(rows.mapInArrow(code, f"key {kind}, node long, bits binary, n int, head binary, fp long"))
    nodes = written(coded.groupBy("node").agg(F.min("key").alias("key"), F.first("bits").alias("bits"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    bits, texts_apart = nodes.select("node", "bits", "n"), nodes.count()
    entries = (coded.agg(F.sum(F.octet_length("head"))).first()[0] or 0) // 8
    buckets = max(1, -(-entries // BUCKET))
    met = written(coded.select("node", "n", "head").mapInArrow(partial(_spread, buckets=buckets), "bucket int, entries binary").repartition(
        buckets, "bucket").mapInArrow(partial(_members, similarity=similarity), MEMBER))
    members = met.filter("other IS NULL").drop("other")
    of_few = met.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()

    edges = comps = None
    turn, last = 0, False
    while not last:
        if turn == 0:
            pairs = fingerprint_pairs(nodes)
        else:
            now = members if comps is None else members.join(comps, "node", "left")
            now = now.withColumn("component", F.coalesce("component", "node") if comps is not None else F.col("node"))
            apart = checkpointed(_apart(now))
            # a round that found nothing will not be followed by a better one
            last = turn > 1 and (turn > ROUNDS or not news or (apart.agg(F.sum("pairs")).first()[0] or 0) <= PAIRS * texts_apart)
            pairs = (_rest(now, apart) if last else _with_hubs(now, apart, turn)).filter(
                _fit(F.col("n"), F.col("place"), F.col("other_n"), F.col("other_place"), similarity)).select(
                F.greatest("node", "other_node").alias("a"), F.least("node", "other_node").alias("b"))
            pairs = (pairs.union(_in_two_classes(of_few, comps)) if turn == 1 else pairs).distinct()
        pairs = checkpointed(bounded(pairs, bits, similarity))
        cells = needed_cells(pairs)
        if not cells.any():  # no pair: the texts need not be read
            turn, news = turn + 1, False
            continue
        texts = rows.select("text").mapInArrow(partial(_in_cells, cells=cells), "node long, packed binary").groupBy("node").agg(F.first("packed").alias("packed"))
        found = checkpointed(verified(pairs, texts, similarity, words))
        turn, news = turn + 1, not found.isEmpty()
        if news:
            edges = found if edges is None else edges.union(found)
            comps = checkpointed(connected_components(edges))
    named = nodes.select("node", "key")
    named = named.withColumn("component", F.col("node")) if comps is None else named.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("key").alias("component_id"))
    named = checkpointed(named.select("node", "component").join(least, "component").select("node", "component_id"))
    return coded.select("key", "node").join(named, "node").select(F.col("key").alias(key), "component_id")
