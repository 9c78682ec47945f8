"""Merkle-tree fingerprints over sections, paragraphs and spans.

A text is a tree: root, sections, paragraphs (lines), and spans of a few words. A span ends
after a word whose checksum says so, or at its most words, and a section after a blank line or a paragraph whose
digest says so, so an edit moves only the borders next to it. Words are cut every WORD bytes, so that text
without blanks has spans, too. Equal roots mean equal texts; where roots differ, the branches that differ locate the edits.

A fingerprint is written ``root-sections``: the root digest, then the span digests, with "," between
paragraphs and ";" between sections. Defined results: NULL counts as empty; the empty text is
a tree without sections; repeated rows get one row each; rows are ordered by key, then by a hash of the text,
NULL keys first; the row after the last is the first. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gaugeflow.llm.common import only

SPAN = 7  # hex digits of a span: one for its length in steps of eight bytes, 15 at most, then its digest
_WEIGHT = {d: int(d, 16) + 0.5 for d in "0123456789abcdef"}
#: Most words of a span, and most bytes of a word and of the blanks behind it.
MOST, WORD = 8, 24
_WORD = re.compile(rb"[^ \t]{1,%d}[ \t]{0,%d}|[ \t]{1,%d}" % (WORD, WORD, WORD))


def _digest(data: bytes, size: int = 16) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def spans(paragraph: bytes) -> list[bytes]:
    """Runs of about four words; the words themselves decide where a run ends."""
    out, run = [], []
    for w in _WORD.findall(paragraph):
        run.append(w)
        if not zlib.crc32(w) & 3 or len(run) == MOST:
            out.append(b"".join(run))
            run = []
    if run or not out:
        out.append(b"".join(run))
    return out


def leaf(span: bytes) -> str:
    return f"{min(15, len(span) // 8):x}{_digest(span, SPAN // 2)}"


def fingerprint(text: bytes | None) -> str:
    if not text:
        return _digest(b"") + "-"
    sections, digests, part, inner = [], [], [], []
    for line in text.split(b"\n"):
        full = _digest(line)
        part.append("".join(leaf(s) for s in spans(line)))
        inner.append(full)
        if not line.strip() or full[0] in "01":
            sections.append(",".join(part))
            digests.append(_digest("".join(inner).encode()))
            part, inner = [], []
    if part:
        sections.append(",".join(part))
        digests.append(_digest("".join(inner).encode()))
    return _digest("".join(digests).encode()) + "-" + ";".join(sections)


def _branches(sections: Counter) -> Counter:
    """The span digests below some sections; equal branches of both trees are cut before."""
    out = Counter()
    for s, n in sections.items():
        for p in s.split(","):
            for at in range(0, len(p), SPAN):
                out[p[at:at + SPAN]] += n
    return out


def _size(section: str) -> float:
    """Lengths of a section's spans, in steps of eight bytes."""
    return sum(_WEIGHT[d] for p in section.split(",") for d in p[::SPAN])


def likeness(a: str, b: str) -> float:
    """Share of the text in spans that both trees hold, 0 to 1; 1 exactly for equal roots."""
    if a[:32] == b[:32]:
        return 1.0
    sa, sb = (Counter(x[33:].split(";")) for x in (a, b))
    total = sum(_size(s) * n for c in (sa, sb) for s, n in c.items())
    same = sa & sb
    shared = sum(_size(s) * n for s, n in same.items())
    shared += sum(_WEIGHT[s[0]] * n for s, n in (_branches(sa - same) & _branches(sb - same)).items())
    return min(2.0 * shared / total, 1.0 - 1e-9) if total else 0.0


def edits(old: bytes, new: bytes) -> list[tuple[int, int, bytes]]:
    """(section, paragraph, text) of the new text's paragraphs below branches the old one lacks."""
    have = Counter(fingerprint(old)[33:].split(";"))
    lines_of_old, out, at = Counter(old.split(b"\n")), [], 0
    lines = new.split(b"\n")
    for i, section in enumerate(fingerprint(new)[33:].split(";")):
        n = section.count(",") + 1
        if have[section] > 0:
            have[section] -= 1
        else:
            out += [(i, j, line) for j, line in enumerate(lines[at:at + n]) if not lines_of_old[line]]
        at += n
    return out


def edited(text: str, nxt: str) -> str:
    """The text with its last quarter replaced by as many first code points of the next one."""
    q = len(text) // 4
    return text[:len(text) - q] + nxt[:q]


def _compare(text: str, fp: str, nxt: str, next_fp: str) -> tuple:
    changed = edited(text, nxt).encode()
    changed_fp = fingerprint(changed)
    return hashlib.sha256(changed).hexdigest(), changed_fp, likeness(fp, changed_fp), likeness(fp, next_fp)


_OUT = "n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double"


def versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's tree, that of its edited text, and the likeness to it and to the next row's.

    Rows are range-partitioned and sorted by key once. One pass over the ranges compares rows as they stream by, another
    sends only the first and the last row of each range ahead, so that a range's last row meets the first one of the next. Both read
    the same exchange, and nothing else is written.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = only(docs, key, text).toDF("key", "text").withColumn("text", F.coalesce("text", F.lit("")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())  # ranges grow with the files
    ordered = rows.repartitionByRange(parts, "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"))
    names = ["key", "n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out, keys = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                fp = fingerprint(t.encode())
                if held:
                    keys.append(held[0])
                    out.append((len(held[1]), held[2], *_compare(held[1], held[2], t, fp)))
                held = (k, t, fp)
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.record_batch([pa.array(keys, b.column(0).type), *(pa.array(list(c), t) for c, t in zip(cols, types))], names=names)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = last = None
        for b in batches:
            if b.num_rows:
                head = b.column(1).slice(0, 1) if head is None else head
                last = b.slice(b.num_rows - 1)
        if last is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), head, last.column(0), last.column(1)], names=["pid", "head", "key", "tail"])

    # one row per range, dealt out again so that the three readers below share it
    met = ordered.mapInArrow(ends, f"pid int, head string, key {kind}, tail string").repartition("pid")
    ring = met.select("pid", F.coalesce(F.lead("pid").over(Window.orderBy("pid")), F.min("pid").over(Window.partitionBy())).alias("next_pid"))
    tails = (met.select("pid", "key", "tail").join(ring, "pid")
             .join(met.select(F.col("pid").alias("next_pid"), "head"), "next_pid").select("key", "tail", "head"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                fp = fingerprint(t.encode())
                out.append((len(t), fp, *_compare(t, fp, h, fingerprint(h.encode()))))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.record_batch([b.column(0), *[pa.array(list(c), t) for c, t in zip(cols, (
                pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]],
                names=names)

    cols = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    last = tails.mapInArrow(close, f"key {kind}, {_OUT}").select(*cols)
    return ordered.mapInArrow(run, f"key {kind}, {_OUT}").select(*cols).union(last).withColumnRenamed("key", key)
