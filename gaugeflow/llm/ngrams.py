"""An interpolated modified Kneser-Ney model of word pairs, counted in Spark.

Counts are kept in shards of sorted 64-bit hashes with a parallel array of counts, written by tasks to the
shared folder and memory-mapped by workers, so the model may outgrow a worker's memory. A
word's and a pair's shard is the leading bits of its hash, so a batch's sorted lookups touch each shard once.

Defined results: NULL counts as an empty text, which is scored as one end token; a NULL key
counts as training text; with no training text every token has the uniform probability
1/(V+1); repeated rows count and are scored each. Texts are read whole.
"""

from __future__ import annotations

import math
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.llm.common import only, per_worker, written
from gaugeflow.session import shared_dir

#: Training text of one shard, and the least number of leading bits that shards are told apart by; the bits follow the text.
SHARD_BYTES, LEAST_BITS = 8 << 20, 4
END, BEGIN = b"\n", b"\n\n"  # no word holds a line end
#: Words whose hashes a worker keeps: two workers and Spark share an executor's memory.
REMEMBERED = 1 << 17
#: What is kept of a word: pairs it opens and how many pair types with count 1, 2, 3 or more, types it closes, its count.
WORD_FIELDS = ("opened", "n1", "n2", "n3", "closes", "raw")
#: What shards send of it: "opened" only of the begin, since elsewhere it follows from "raw".
SENT = ("begun", *WORD_FIELDS[1:])


def mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash of a pair of hashes."""
    x = v * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashes(text: bytes | None, known: dict) -> list[int]:
    """Begin, the words, end."""
    if len(known) > REMEMBERED:
        known.clear()
    out = [xxhash.xxh64_intdigest(BEGIN)]
    for w in (text or b"").lower().split():
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    out.append(xxhash.xxh64_intdigest(END))
    return out


def packed(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs ordered by context as bytes: each context once with its number of pairs, and small counts in little room."""
    ctx, runs = np.unique(v, return_counts=True)
    short = zlib.compress(runs.astype("<u4").tobytes() + n.astype("<i8").tobytes(), 1)
    return np.array([len(ctx), len(w), len(short)], "<i8").tobytes() + short + ctx.astype("<u8").tobytes() + w.astype("<u8").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    contexts, pairs, size = np.frombuffer(data, "<i8", 3)
    short, rest = zlib.decompress(data[24:24 + size]), data[24 + size:]
    v = np.repeat(np.frombuffer(rest, "<u8", contexts), np.frombuffer(short, "<u4", contexts))
    return v, np.frombuffer(rest, "<u8", pairs, 8 * contexts), np.frombuffer(short, "<i8", pairs, 4 * contexts)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Four bytes a count where all of the shard's counts fit, eight otherwise."""
    return counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64)


def _pairs(texts, known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and tokens of all texts, and the number of tokens of each."""
    seqs = [np.array(hashes(t.as_py(), known), np.uint64) for t in texts]
    if not seqs:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    return np.concatenate([s[:-1] for s in seqs]), np.concatenate([s[1:] for s in seqs]), np.array([len(s) - 1 for s in seqs])


def _summed(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted hashes of the distinct pairs, a place of each in v and w, and their counts."""
    keys = mixed(v, w)
    order = np.argsort(keys)
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[head], order[head], np.diff(head, append=len(keys))


def shard_edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard's run of the sorted keys begins, and the end."""
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


@dataclass
class Model:
    """Where the shards are, and the model's short numbers."""

    path: str
    bits: int = LEAST_BITS
    tokens: int = 0
    types: int = 0
    pair_types: int = 0
    discount: tuple = (0.0, 0.0, 0.0)
    word_discount: tuple = (0.0, 0.0, 0.0)
    word_gamma: float = 1.0
    maps: dict = field(default_factory=dict)

    def _mapped(self, name: str):
        if name not in self.maps:
            file = f"{self.path}/{name}.npy"
            self.maps[name] = np.load(file, mmap_mode="r") if os.path.exists(file) else None
        return self.maps[name]

    def find(self, kind: str, keys: np.ndarray, width: int) -> np.ndarray:
        """Rows of the sorted keys, zero where a key is not in the model."""
        out = np.zeros((len(keys), width), np.int64)
        edges = shard_edges(keys, self.bits)
        for s in np.flatnonzero(np.diff(edges)):
            lo, hi = edges[s], edges[s + 1]
            have = self._mapped(f"{kind}-{s}-keys")
            if have is None or not len(have):
                continue
            at = np.minimum(np.searchsorted(have, keys[lo:hi]), len(have) - 1)
            ok = have[at] == keys[lo:hi]
            out[lo:hi][ok] = self._mapped(f"{kind}-{s}-values")[at[ok]].reshape(-1, width)
        return out

    def log10(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 p(w | v), training count of w)."""
        words, at = np.unique(np.concatenate([v, w]), return_inverse=True)
        rows = self.find("word", words, len(WORD_FIELDS))
        ctx, own = rows[at[:len(v)]], rows[at[len(v):]]
        keys, back = np.unique(mixed(v, w), return_inverse=True)
        count = self.find("pair", keys, 1)[back, 0]
        closes = own[:, 4]
        d1, dw = np.array([0.0, *self.discount]), np.array([0.0, *self.word_discount])
        uniform = 1.0 / (self.types + 1)
        low = np.maximum(closes - dw[np.minimum(closes, 3)], 0) / max(1, self.pair_types) + self.word_gamma * uniform
        opened = np.maximum(ctx[:, 0], 1)
        gamma = np.where(ctx[:, 0] > 0, (ctx[:, 1:4] @ d1[1:]) / opened, 1.0)
        p = np.maximum(count - d1[np.minimum(count, 3)], 0) / opened + gamma * low
        return np.log10(p), own[:, 5]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; halves, where counts of counts are missing."""
    if not n1 or not n2:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))


def _save(path: str, kind: str, bits: int, keys: np.ndarray, values: np.ndarray) -> None:
    """One file pair per shard; a repeated task writes the same bytes and replaces them whole."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    edges = shard_edges(keys, bits)
    for s in np.flatnonzero(np.diff(edges)):
        for name, a in (("values", narrow(values[edges[s]:edges[s + 1]])), ("keys", keys[edges[s]:edges[s + 1]])):
            part = f"{path}/{uuid.uuid4().hex}.npy"
            np.save(part, a)
            os.replace(part, f"{path}/{kind}-{s}-{name}.npy")


def fit(docs: DataFrame, train: Column, text: str = "text") -> Model:
    """Counts the rows where ``train`` holds; everything counted covers all of them."""
    spark = docs.sparkSession
    base = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    if "://" in base:
        raise ValueError("the model is memory-mapped: spark.checkpoint.dir must be a mounted folder")
    path = f"{base}/ngrams-{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    texts = docs.filter(F.coalesce(train, F.lit(True))).select(F.col(f"`{text}`").cast("binary").alias("text"))
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, (volume // SHARD_BYTES).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker("ngram words", dict)
        for b in batches:
            v, w, _ = _pairs(b.column(0), known)
            keys, first, n = _summed(v, w)
            v, w = v[first], w[first]  # from here on the distinct pairs only
            del first
            edges = shard_edges(keys, bits)
            del keys
            met, rows = np.flatnonzero(np.diff(edges)), []
            for s in met:
                own = slice(edges[s], edges[s + 1])
                order = np.argsort(v[own])
                rows.append(packed(v[own][order], w[own][order], n[own][order]))
            del v, w, n
            yield pa.record_batch([pa.array(met.astype(np.int32)), pa.array(rows, pa.binary())], names=["shard", "pairs"])

    # the one exchange of pairs: a row holds all pairs of a batch and shard
    dealt = texts.mapInArrow(count, "shard int, pairs binary").repartition(1 << bits, "shard")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [unpacked(p.as_py()) for b in batches for p in b.column(1)]
        names = ["tok", *SENT]
        if not got:
            return
        v, w, n = (np.concatenate(c) for c in zip(*got))
        del got
        keys = mixed(v, w)
        order = np.argsort(keys)
        keys = keys[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.add.reduceat(n[order], head)
        keys, v, w = keys[head], v[order[head]], w[order[head]]
        _save(path, "pair", bits, keys, n)
        toks, at = np.unique(np.concatenate([v, w]), return_inverse=True)
        av, aw = at[:len(v)], at[len(v):]
        size = len(toks)

        def sums(where, weight):
            return np.bincount(where, weight, size).astype(np.int64)

        begun = np.where(toks == np.uint64(xxhash.xxh64_intdigest(BEGIN)), sums(av, n), 0)
        cols = [begun, sums(av, n == 1), sums(av, n == 2), sums(av, n >= 3), sums(aw, None), sums(aw, n)]
        toks = toks.view(np.int64)
        for lo in range(0, size, 1 << 16):
            yield pa.record_batch([pa.array(c[lo:lo + (1 << 16)]) for c in (toks, *cols)], names=names)
        # without a token: the shard's numbers of pairs counted three and four times
        totals = [0, int((n == 3).sum()), int((n == 4).sum()), 0, 0, 0]
        yield pa.record_batch([pa.array([None], pa.int64()), *(pa.array([t], pa.int64()) for t in totals)], names=names)

    parts = dealt.mapInArrow(store, "tok long, " + ", ".join(f"{c} long" for c in SENT))
    words = written(parts.groupBy("tok").agg(*[F.sum(c).alias(c) for c in SENT]))

    def store_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [tuple(b.column(i).to_numpy() for i in range(7)) for b in batches]
        if got:
            tok, *cols = (np.concatenate(c) for c in zip(*got))
            tok = tok.view(np.uint64)
            # every word opens as many pairs as it has occurrences; only the two ends differ
            begin, end = (tok == np.uint64(xxhash.xxh64_intdigest(x)) for x in (BEGIN, END))
            cols[0] = np.where(begin, cols[0], np.where(end, 0, cols[5]))
            _save(path, "word", bits, tok, np.stack(cols, 1))
        yield pa.record_batch([pa.array([len(got)], pa.int64())], names=["n"])

    shard = F.shiftrightunsigned("tok", 64 - bits)
    known_words = words.filter("tok IS NOT NULL")
    known_words.select("tok", *SENT).repartition(1 << bits, shard).mapInArrow(store_words, "n long").agg(F.sum("n")).first()
    s = known_words.agg(
        F.sum("raw"), F.count_if(F.col("raw") > 0), F.sum("closes"), F.sum("n1"), F.sum("n2"),
        *[F.count_if(F.col("closes") == i) for i in (1, 2, 3, 4)], F.count_if(F.col("closes") >= 3)).first()
    if not s[0]:
        return Model(path, bits)
    f3, f4 = words.filter("tok IS NULL").select("n1", "n2").first()
    dw = discounts(*s[5:9])
    gamma = (dw[0] * s[5] + dw[1] * s[6] + dw[2] * s[9]) / s[2]
    return Model(path, bits, s[0], s[1], s[2], discounts(s[3], s[4], f3, f4), dw, gamma)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker("ngram words", dict)
        m = per_worker(("ngrams", model.path), lambda: model)
        floor = math.log10(m.tokens + 0.5 * (m.types + 1))
        for b in (big.slice(at, 256) for big in batches for at in range(0, big.num_rows, 256)):  # few texts' lookups at once
            v, w, sizes = _pairs(b.column(1), known)
            logs, c = m.log10(v, w)
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)

            def per_row(x):
                return np.add.reduceat(x, at) if len(at) else x[:0]

            yield pa.record_batch([
                b.column(0), pa.array(sizes.astype(np.int64)), pa.array(per_row((c > 0).astype(np.int64))),
                pa.array(np.full(len(sizes), m.tokens, np.int64)), pa.array(per_row(np.log10(c + 0.5) - floor)), pa.array(per_row(logs))],
                names=["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return only(docs, key, text).toDF("key", "text").withColumn("text", F.col("text").cast("binary")).mapInArrow(
        run, f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from the rows that are not held out and scores all."""
    docs = only(docs, key, text)
    model = fit(docs, ~held_out(key), text)
    out = score(docs, model, key, text)
    return out.select(F.col(f"`{key}`"), held_out(key).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
