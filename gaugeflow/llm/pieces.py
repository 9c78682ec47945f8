"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. A failure link of a node leads to where matching goes on after the
longest pieces of the node's string are taken off its front, and carries how many were taken, so
a word's length comes from one pass over its bytes and no piece is built. Pieces of two kinds
exist: those that open a word and those that continue it.

Defined results: NULL and empty texts have no words and no pieces; a word that the vocabulary
cannot cover counts as one piece; repeated rows get one row each. Texts are read whole.
"""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import only, per_worker

#: Distinct words remembered by a worker.
REMEMBERED = 1 << 20


class LongestMatch:
    """Trie over bytes with failure links; nodes are numbers, 0 opens a word, 1 continues it."""

    def __init__(self, opening: Iterable[bytes], continuing: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for root, words in ((0, opening), (1, continuing)):
            for word in words:
                at = root
                for byte in word:
                    if byte not in self.next[at]:
                        self.next[at][byte] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    at = self.next[at][byte]
                ends[at] = ends[at] or at > 1
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque((0, 1))
        while queue:
            at = queue.popleft()
            for byte, child in self.next[at].items():
                queue.append(child)
                if ends[child]:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                back, taken = self.fail[at], self.popped[at]
                while back != -1 and byte not in self.next[back]:
                    taken += self.popped[back]
                    back = self.fail[back]
                if back != -1:
                    self.fail[child], self.popped[child] = self.next[back][byte], taken

    def length(self, word: bytes) -> int:
        """Number of greedy pieces; 1 if the word cannot be covered."""
        nxt, fail, popped = self.next, self.fail, self.popped
        at, n = 0, 0
        for byte in word:
            while byte not in nxt[at]:
                n += popped[at]
                at = fail[at]
                if at == -1:
                    return 1
            at = nxt[at][byte]
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at == -1:
                return 1
        return n


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Opening and continuing pieces of a byte-level vocabulary file; a leading blank opens a word."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = (b for b in range(256) if b not in set(plain))
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(spare)}
    words = [bytes(byte_of[c] for c in t) for t in tokens if all(c in byte_of for c in t)]
    opening = [w[1:] for w in words if w[:1] == b" " and len(w) > 1]
    continuing = [w for w in words if w[:1] != b" "]
    single = [w for w in continuing if len(w) == 1]
    return opening + single, continuing


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_tokens): the greedy piece count of every row's whole text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = per_worker(("pieces", path), lambda: LongestMatch(*vocabulary(path)))
        known = per_worker(("piece lengths", path), dict)
        for b in batches:
            words, tokens = [], []
            for t in b.column(1):
                counts = Counter((t.as_py() or b"").split())
                if len(known) > REMEMBERED:
                    known.clear()
                n = 0
                for w, times in counts.items():
                    size = known.get(w)
                    if size is None:
                        size = known[w] = machine.length(w)
                    n += size * times
                words.append(counts.total())
                tokens.append(n)
            yield pa.record_batch([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["key", "n_words", "n_tokens"])

    return only(docs, key, text).toDF("key", "text").withColumn("text", F.col("text").cast("binary")).mapInArrow(
        run, f"key {kind}, n_words long, n_tokens long").withColumnRenamed("key", key)
