"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut every ``chunk`` code points into chunks that reach ``overlap`` code points into the next one. Tasks
pre-tokenise chunks independently of each other. The pattern looks only ahead, so from the first boundary on that
two neighbouring chunks have in common they would go on alike: there they are stitched. The pieces between stitches are then
encoded in parallel, and a text's ids joined in order. Decoding concatenates the raw bytes of the ids.

A match counts only if ``MARGIN`` code points follow it in its chunk, or the text ends, because the end of a chunk can cut
a match or hide what follows it. Where two chunks share no boundary (a run of one class longer than the overlap) the whole text is
encoded as one piece. A text of one chunk, as most are, is encoded where it is read.

Defined results: NULL counts as empty; an empty text has no ids; strings of special tokens are ordinary text; repeated rows
and NULL keys get one row each; other columns go no further. Texts are read whole. The pattern has to match every character.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from gaugeflow.llm.common import only, per_worker

CHUNK = 1 << 14
OVERLAP = 256
#: Code points that must follow a match before it is final; a pattern's alternatives look no further ahead.
MARGIN = 8
#: Distinct pieces remembered by a worker, and the longest of them.
REMEMBERED, LONGEST = 1 << 19, 64


class Known(dict):
    """Ids of pieces, each merged once."""

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, piece: str) -> list[int]:
        ids = self.merge(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class Codec:
    """Splits by a pattern, merges by ranks, and gives back the bytes of ids."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.known = Known(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.array(list(chain.from_iterable(map(self.known.__getitem__, self.pattern.findall(text)))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def bounds(self, text: str, last: bool) -> list[int]:
        """Ends of final matches, with 0; ``last`` if nothing follows the text."""
        final = len(text) - (0 if last else MARGIN)
        return [0, *(e for e in (m.end() for m in self.pattern.finditer(text)) if e <= final)]


def codec(path: str, pattern: str) -> Codec:
    return per_worker(("bytepairs", path, pattern), lambda: Codec(path, pattern))


def chunks(text: str, chunk: int, overlap: int) -> list[str]:
    return [text[at:at + chunk + overlap] for at in range(0, max(len(text), 1), chunk)]


def edges(bounds: list[int], chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries that a chunk may share with the one before it and with the next one, the latter counted from that one's start."""
    return [b for b in bounds if b <= overlap], [b - chunk for b in bounds if b >= chunk]


def _digest(ids: np.ndarray, raw: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()


_OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_TYPES = (pa.int64(), pa.string(), pa.string())


def _batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 3
    return pa.record_batch([keys, *(pa.array(c, t) for c, t in zip(cols, _TYPES))], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])


def stitched(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(uid, i, key, ids) of (uid, key, text): the ids, as bytes, of every piece between two stitches."""
    kind = long.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                parts = chunks(b.column(2)[j].as_py(), chunk, overlap)
                at = pa.array([j] * len(parts), pa.int32())
                yield pa.record_batch([b.column(0).take(at), pa.array(range(len(parts)), pa.int32()), pa.array([i + 1 == len(parts) for i in range(len(parts))]),
                                       b.column(1).take(at), pa.array(parts, pa.string())], names=["uid", "i", "last", "key", "text"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            # a chunk without its whole overlap ends where the text does
            both = [edges(own.bounds(t, len(t) < chunk + overlap), chunk, overlap) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array([x[k] for x in both], pa.list_(pa.int32())) for k in (0, 1))], names=["uid", "i", "head", "tail"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            ids = pa.array([own.encode(t).tobytes() for t in b.column(3).to_pylist()], pa.binary())
            yield pa.record_batch([*b.columns[:3], ids], names=["uid", "i", "key", "ids"])

    cut_up = long.select("uid", "key", "text").mapInArrow(cut, f"uid long, i int, last boolean, key {kind}, text string").repartition("uid", "i")
    of_text = Window.partitionBy("uid").orderBy("i")  # the chunks of one text
    met = cut_up.select("uid", "i", "text").mapInArrow(split, "uid long, i int, head array<int>, tail array<int>").withColumn(
        "at", F.when(F.col("i") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(of_text)))))
    met = met.select("uid", "i", "at", F.lead("at").over(of_text).alias("next"),
                     F.max(F.col("at").isNull()).over(Window.partitionBy("uid")).alias("apart"))
    placed = cut_up.join(met, ["uid", "i"])
    start, stop = F.col("at"), F.when(F.col("last"), F.length("text")).otherwise(chunk + F.col("next"))
    pieces = placed.filter("NOT apart").select("uid", "i", "key", F.substring("text", start + 1, stop - start).alias("text"))
    body = F.struct("i", F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", 1, chunk)).alias("text"))
    whole = placed.filter("apart").groupBy("uid").agg(F.sort_array(F.collect_list(body)).alias("parts"), F.first("key").alias("key")).select(
        "uid", F.lit(0).alias("i"), "key", F.array_join("parts.text", "").alias("text"))
    return pieces.union(whole).mapInArrow(encode, f"uid long, i int, key {kind}, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row's whole text, encoded and decoded again."""
    if not MARGIN < overlap <= chunk:
        raise ValueError(f"the overlap must be over {MARGIN} and not over the chunk")
    kind = docs.schema[key].dataType.simpleString()
    rows = only(docs, key, text).toDF("key", "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    size = F.length("text")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            encoded = (own.encode(t.as_py()) for t in b.column(1))
            yield _batch(b.column(0), [_digest(ids, own.decode(ids)) for ids in encoded])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            out = []
            for parts in b.column(1).to_pylist():
                ids = [np.frombuffer(p, "<u4") for p in parts]
                out.append(_digest(np.concatenate(ids), b"".join(map(own.decode, ids))))
            yield _batch(b.column(0), out)

    short = rows.filter(size <= chunk).mapInArrow(near, f"key {kind}, {_OUT}")
    parted = stitched(rows.withColumn("uid", F.monotonically_increasing_id()).filter(size > chunk), path, pattern, chunk, overlap)
    texts = parted.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("parts"), F.first("key").alias("key"))
    return short.union(texts.select("key", "parts.ids").mapInArrow(join, f"key {kind}, {_OUT}")).withColumnRenamed("key", key)
