"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are cut into pieces no longer than a sequence. Pieces that fill one are done. The
others start from best fit in falling order over all of them at once: it needs only how many pieces have
each length, and lays down bins by pattern, so its size depends on the capacity and not on the table. Whole
bins are dealt into blocks by hash; each block is packed by several islands that start from its bins and from
best fit in other orders. Crossover puts whole well-filled bins of one packing into another,
removes the bins that hold the same pieces, and best-fits the displaced pieces. After each era every
island's best packing moves to the next island. Sequences that stay poorly filled are opened
once more and packed together across blocks. An island never gives back more bins than it began with, so the
result is never above best fit over the whole table.

Defined results: a NULL text is empty, one piece that holds the end id; repeated rows are separate
documents; an empty table gives no rows. Texts are tokenized whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import only, per_worker
from gaugeflow.operators.ranking import hash_ranked
from gaugeflow.session import checkpointed

CAPACITY, END = 2048, 0
BLOCK_ITEMS, ISLANDS, ERAS, CHILDREN, ELITE = 1024, 2, 2, 12, 4
WELL_FILLED = 0.985
_STRIDE = 1 << 20


def encoder(name: str):
    """text -> ids of a public byte-level vocabulary, by its rank file, which is several times
    faster than the same vocabulary's other form and gives the same ids."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return lambda text: e.encode(text, allowed_special="all")


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, piece, start, length, ids_crc32): all pieces; a long document's first one is the short one."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(("encoder", vocabulary), lambda: encoder(vocabulary))
        for b in batches:
            rows, out = [], []
            for i, t in enumerate(b.column(1)):
                ids = np.array([*encode(t.as_py() or ""), END], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for p, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(i)
                    out.append((p, s, e - s, zlib.crc32(ids[s:e].tobytes())))
            cols = [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int32())), *cols], names=["key", "piece", "start", "length", "ids_crc32"])

    return only(docs, key, text).toDF("key", "text").mapInArrow(
        run, f"key {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", key)


def best_fit(bins: list[list[int]], free: list[int], items, sizes, capacity: int) -> None:
    """Puts each item into the fullest bin that has room, or into a new one."""
    room = sorted((f, i) for i, f in enumerate(free))
    for item in items:
        size = sizes[item]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            f, i = room.pop(at)
        else:
            f, i = capacity, len(bins)
            bins.append([])
            free.append(capacity)
        bins[i].append(item)
        free[i] = f - size
        insort(room, (f - size, i))


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit in falling order of so many pieces of each length, as (number of bins, {length: pieces in each}).

    Bins alike are filled together; every length parts at most one group of them and opens at most two, so there
    are at most three groups a length, however many pieces there are.
    """
    groups: dict[int, list[tuple[int, dict[int, int]]]] = {}  # by free room
    rooms: list[int] = []

    def put(room: int, bins: int, pattern: dict[int, int]) -> None:
        if bins:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((bins, pattern))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins, pattern = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, bins, pattern = capacity, left, {}
            each = min(room // length, left)  # a bin stays the best fit until it has no more room
            filled = min(bins, left // each)
            put(room - each * length, filled, {**pattern, length: each})
            if pattern:
                put(room, bins - filled, pattern)
            left -= filled * each
    return [g for room in rooms for g in groups[room]]


def _first_bins(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    """Adds ``bin`` to items (uid, length): best fit over all of them. The driver sees one count per length."""
    counts = {r.length: r.n for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken, base, slots = dict.fromkeys(counts, 0), 0, []  # (length, first rank, first bin, bins)
    for bins, pattern in patterns(counts, capacity):
        for length, each in pattern.items():
            slots.append((length, taken[length], base, bins))
            taken[length] += bins * each
        base += bins
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    first = {int(v): int(i) for v, i in zip(*np.unique(table[:, 0], return_index=True))}
    last = {v: int(np.searchsorted(table[:, 0], v, "right")) for v in first}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            bins = np.empty(len(length), np.int64)
            for v in np.unique(length).tolist():
                mine, at = np.flatnonzero(length == v), table[first[v]:last[v]]
                slot = at[np.searchsorted(at[:, 1], rank[mine] - 1, "right") - 1]
                bins[mine] = slot[:, 2] + (rank[mine] - 1 - slot[:, 1]) % slot[:, 3]
            yield pa.record_batch([b.column("uid"), b.column("length"), pa.array(bins)], names=["uid", "length", "bin"])

    return hash_ranked(items, ["length"], ["uid"], seed, total=None).select("uid", "length", "rank").mapInArrow(place, "uid long, length long, bin long")


def crossover(a: list[list[int]], b: list[list[int]], sizes, capacity: int, rng) -> list[list[int]]:
    """``a`` with well-filled whole bins of ``b`` put in; pieces this displaces are best-fitted again."""
    fill_b = np.array([sum(sizes[i] for i in x) for x in b])
    good = np.flatnonzero(fill_b >= WELL_FILLED * capacity)
    if not len(good):
        good = np.array([int(fill_b.argmax())])
    chosen = [b[i] for i in rng.permutation(good)[: max(1, len(good) // 2)]]
    given = {i for x in chosen for i in x}
    kept, displaced = [], []
    for x in a:
        hit = [i for i in x if i in given]
        if hit:
            displaced += [i for i in x if i not in given]
        else:
            kept.append(x)
    # the emptiest bin and a few others are opened too, so that their pieces can find better places
    if kept:
        worst = min(range(len(kept)), key=lambda j: sum(sizes[i] for i in kept[j]))
        displaced += kept.pop(worst)
        for _ in range(min(len(kept), int(rng.integers(0, 4)))):
            displaced += kept.pop(int(rng.integers(len(kept))))
    bins = [list(x) for x in [*chosen, *kept]]
    free = [capacity - sum(sizes[i] for i in x) for x in bins]
    noise = rng.normal(1, 0.2 * rng.integers(0, 2), len(sizes))
    best_fit(bins, free, sorted(displaced, key=lambda i: -sizes[i] * noise[i]), sizes, capacity)
    return bins


def fitness(bins: list[list[int]], sizes, capacity: int) -> tuple:
    return len(bins), -sum((sum(sizes[i] for i in x) / capacity) ** 2 for x in bins)


def evolve(sizes: list[int], start: list[list[list[int]]], capacity: int, seed, children: int = CHILDREN) -> list[list[list[int]]]:
    """One island's era: the ELITE best packings, best first; ends early at the lower bound."""
    rng, bound = np.random.default_rng(seed), -(-sum(sizes) // capacity)
    people = list(start)
    down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    while len(people) < ELITE and not any(len(p) <= bound for p in people):
        noise = rng.normal(1, 0.0 if not people else 0.15, len(sizes))
        bins, free = [], []
        best_fit(bins, free, down if not people else sorted(down, key=lambda i: -sizes[i] * noise[i]), sizes, capacity)
        people.append(bins)
    people.sort(key=lambda p: fitness(p, sizes, capacity))
    for _ in range(children):
        if len(people[0]) <= bound:
            break
        i, j = rng.integers(0, len(people), 2)
        people.append(crossover(people[min(i, j)], people[max(i, j)], sizes, capacity, rng))
        people = sorted(people, key=lambda p: fitness(p, sizes, capacity))[:ELITE]
    return people


_ISLAND = "block long, island int, uids array<long>, sizes array<long>, elite array<array<array<int>>>, visitor array<array<int>>"


def _pack_blocks(items: DataFrame, blocks: int, capacity: int, seed: int, first_id: int) -> DataFrame:
    """(uid, length, sequence_id, offset, filled) for items (uid, length, bin), whose bins are dealt into so many blocks."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "bin"), F.lit(blocks)))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=False)
        uids, sizes = pdf["uid"].tolist(), pdf["length"].tolist()
        start: dict[int, list[int]] = {}
        for i, x in enumerate(pdf["bin"].tolist()):
            start.setdefault(x, []).append(i)
        bins = [start[x] for x in sorted(start)]
        return pd.DataFrame([(int(pdf["block"].iloc[0]), k, uids, sizes, [bins], None) for k in range(ISLANDS)],
                            columns=["block", "island", "uids", "sizes", "elite", "visitor"])

    def era(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.to_pylist()
                for r in rows:
                    start = r["elite"] + ([r["visitor"]] if r["visitor"] else [])
                    r["elite"] = evolve(r["sizes"], start, capacity, [seed, r["block"], r["island"], number])
                    r["visitor"] = None
                yield pa.RecordBatch.from_pylist(rows, schema=b.schema)
        return run

    state = dealt.groupBy("block").applyInPandas(settle, _ISLAND)
    for number in range(ERAS):
        if number:  # elites move to the next island
            moved = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite")[0].alias("visitor"))
            state = state.drop("visitor").join(moved, ["block", "island"]).select("block", "island", "uids", "sizes", "elite", "visitor")
        state = checkpointed(state.mapInArrow(era(number), _ISLAND))
    best = state.groupBy("block").agg(F.min_by(F.struct("uids", "sizes", F.col("elite")[0].alias("bins")), F.struct(F.size(F.col("elite")[0]), "island")).alias("s"))

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                s = r["s"]
                for n, x in enumerate(s["bins"]):
                    at, filled = 0, sum(s["sizes"][i] for i in x)
                    for i in x:
                        out.append((s["uids"][i], s["sizes"][i], first_id + r["block"] * _STRIDE + n, at, filled))
                        at += s["sizes"][i]
            cols = zip(*out) if out else [[]] * 5
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in cols], names=["uid", "length", "sequence_id", "offset", "filled"])

    return checkpointed(best.mapInArrow(lay_out, "uid long, length long, sequence_id long, offset long, filled long"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         block_items: int = BLOCK_ITEMS, seed: int = 8) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place."""
    cut = checkpointed(pieces(docs, key, text, capacity).withColumn("uid", F.monotonically_increasing_id()))
    items = cut.filter(F.col("length") < capacity).select("uid", "length")
    blocks = max(1, -(-items.count() // block_items))
    first = _pack_blocks(_first_bins(items, capacity, seed), blocks, capacity, seed, 0)
    loose = F.col("filled") < WELL_FILLED * capacity
    again = first.filter(loose).select("uid", "length", F.col("sequence_id").alias("bin"))
    more = max(1, -(-again.count() // block_items))
    second = _pack_blocks(again, more, capacity, seed + 1, blocks * _STRIDE)
    places = first.filter(~loose).union(second).select("uid", "sequence_id", "offset")
    full = cut.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    return cut.join(places, "uid").unionByName(full).drop("uid")
