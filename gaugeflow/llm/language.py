"""Language identification by Bayesian evidence fusion.

The text's likelihood under byte-trigram models, the declared markup language, the address suffix, and
a prior of the host are multiplied. Host priors are counted by grouped aggregation of first guesses
from text alone, and smoothed from the whole corpus over suffix and domain to the host.
One more class, ``und``, stands for text that no language explains.

Defined results: a NULL or empty text, or one without letters, is ``und`` with probability 1; rows without
an address share the corpus' prior; repeated rows are rows of their own. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html import unescape
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import only
from gaugeflow.session import checkpointed

#: Labelled rows per language that the text model is fitted on, and trigram cells of a model.
SAMPLE_ROWS, CELLS = 400, 1 << 15
UNKNOWN = "und"
#: Pseudo-counts a level of addresses lends to the level below it.
LENT = 20.0
#: A text of n trigrams weighs like this many independent ones at most.
EVIDENCE = 60.0
#: Mean log likelihood by which a text may fall below the typical text of its language, in deviations.
DEVIATIONS = 8.0
#: Country suffixes with one main language.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
_DROP = re.compile(r"(?is)<!--.*?-->|<(script|style|nav|footer|aside|header|form)\b.*?</\1\s*>|<[^>]*>")


def grams(text: str) -> np.ndarray:
    """Cells of all byte trigrams of the text's letters; other characters become one blank."""
    low = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    if not low:
        return np.zeros(0, np.uint32)
    b = np.frombuffer(f" {low} ".encode(), np.uint8).astype(np.uint32)
    x = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(17)) % np.uint32(CELLS)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> dict:
    """Trigram models from at most ``rows`` labelled rows of every language, the least by hash.

    Languages are a dictionary; each sends its bounded sample through a map-side top-k.
    """
    known = only(labelled, text, lang).toDF("text", "lang").filter("lang IS NOT NULL AND length(text) > 0")
    names = sorted(r[0] for r in known.select("lang").distinct().collect())
    if not names:
        return {"names": [], "logs": np.zeros((0, CELLS)), "typical": []}
    sample = checkpointed(reduce(DataFrame.union, (
        known.filter(F.col("lang") == name).orderBy(F.xxhash64("text")).limit(rows) for name in names)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, name in zip(b.column(0), b.column(1)):
                cells, n = np.unique(grams(t.as_py()), return_counts=True)
                yield pa.record_batch([pa.array([name.as_py()] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(n.astype(np.int64))],
                                      names=["lang", "cell", "n"])

    counts = np.full((len(names), CELLS), 0.1)
    for name, cell, n in sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n")).collect():
        counts[names.index(name), cell] += n  # at most one number per language and cell
    logs = np.log(counts / counts.sum(1, keepdims=True))

    def fit_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(name.as_py(), grams(t.as_py())) for t, name in zip(b.column(0), b.column(1))]
            means = [(name, float(logs[names.index(name)][g].mean())) for name, g in got if len(g) >= 20]
            yield pa.record_batch([pa.array([m[0] for m in means], pa.string()), pa.array([m[1] for m in means], pa.float64())], names=["lang", "mean"])

    seen = {r[0]: r[1:] for r in sample.mapInArrow(fit_of, "lang string, mean double").groupBy("lang").agg(
        F.avg("mean"), F.stddev_pop("mean")).collect()}
    typical = [(seen[n][0], max(0.15, seen[n][1])) if n in seen else (float(logs[i].mean()), 1.0) for i, n in enumerate(names)]
    return {"names": names, "logs": logs, "typical": typical}


def plain(html: str | None) -> str | None:
    """The text of a page without scripts, styles, navigation and markup."""
    return None if html is None else unescape(_DROP.sub(" ", html))


def text_evidence(rows: DataFrame, model: dict, markup: bool) -> DataFrame:
    """Adds ``evidence``, one log likelihood per language and last that of ``und``, for column ``text``."""
    names, logs, typical = model["names"], np.ascontiguousarray(model["logs"].T), model["typical"]
    others = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text"):
                t = t.as_py()
                g = grams((plain(t) if markup else t) or "")
                if not len(g) or not names:
                    out.append([-1e6] * len(names) + [0.0])
                    continue
                mean = logs[g].mean(0)
                floor = min(m - DEVIATIONS * s * max(1.0, 3.0 / math.sqrt(len(g))) for m, s in typical)
                out.append([*(mean * min(len(g), EVIDENCE)), floor * min(len(g), EVIDENCE)])
            yield pa.record_batch([*[b.column(f.name) for f in others], pa.array(out, pa.list_(pa.float64()))],
                                  names=[*[f.name for f in others], "evidence"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "evidence array<double>"])
    return rows.mapInArrow(run, schema)


def _levels(host):
    """Corpus, suffix, domain and host of an address, as names from the right."""
    parts = F.split(host, r"\.")
    tail = lambda k: F.when(host.isNotNull(), F.array_join(F.slice(parts, F.greatest(F.size(parts) - (k - 1), F.lit(1)), k), "."))
    return [F.lit(""), tail(1), tail(2), host]


def identify(rows: DataFrame, model: dict, markup: bool = False) -> DataFrame:
    """(uid, lang, probability) for rows (uid, text, host, declared)."""
    names = [*model["names"], UNKNOWN]
    guess = lambda c: F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(c, F.array_max(c)).cast("int"))
    seen = text_evidence(rows, model, markup).withColumn("guess", guess(F.col("evidence")))
    for i, c in enumerate(_levels(F.col("host"))):
        seen = seen.withColumn(f"l{i}", c)
    seen = checkpointed(seen)
    k = len(names)
    tally = [F.count_if(F.col("guess") == n).cast("double") for n in names]
    # counts per host first; the levels above are sums of short rows
    hosts = checkpointed(seen.groupBy("l0", "l1", "l2", "l3").agg(F.array(*tally).alias("n")))
    prior = None
    for i in range(4):
        keys = [f"l{j}" for j in range(i + 1)]
        level = hosts.groupBy(*keys).agg(F.array(*[F.sum(F.col("n")[j]) for j in range(k)]).alias("m"))
        if prior is not None:
            above = prior.withColumnsRenamed({x: f"p{x}" for x in keys[:-1]})
            level = level.join(above, [F.col(x).eqNullSafe(F.col(f"p{x}")) for x in keys[:-1]]).select(*keys, "m", "prior")
        else:
            level = level.withColumn("prior", F.array(*[F.lit(1.0 / k)] * k))
        total = F.aggregate("m", F.lit(0.0), lambda a, x: a + x)
        level = level.withColumn("prior", F.zip_with("m", "prior", lambda n, p: (n + LENT * p) / (total + LENT)))
        prior = checkpointed(level.select(*keys, "prior"))
    # what pages of each language declare, from the same first guesses
    said = seen.groupBy("declared", "guess").agg(F.count(F.lit(1)).alias("c"))
    table = checkpointed(said.groupBy("declared").agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("guess") == n, F.col("c"))), F.lit(0)).cast("double") for n in names]).alias("d")))
    sums = table.agg(*[F.sum(F.col("d")[j]) for j in range(k)]).first()
    table = table.withColumn("said", F.array(*[F.log((F.col("d")[j] + 1.0) / F.lit((sums[j] or 0.0) + 20.0)) for j in range(k)])).drop("d")
    # short tables of addresses and of declarations; a hot one is spread over salts
    salts = 16
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    put = seen.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    hosts = salted(prior).select(F.col("salt").alias("s"), *[F.col(f"l{i}").alias(f"h{i}") for i in (1, 2, 3)], "prior")
    put = put.join(hosts, [F.col("salt") == F.col("s"), *[F.col(f"l{i}").eqNullSafe(F.col(f"h{i}")) for i in (1, 2, 3)]]).drop("s")
    claims = salted(table).select(F.col("salt").alias("s"), F.col("declared").alias("claim"), "said")
    put = put.join(claims, [F.col("salt") == F.col("s"), F.col("declared").eqNullSafe(F.col("claim"))])
    pairs = [F.lit(x) for s, n in SUFFIX_LANGUAGE.items() for x in (s, n)]
    country = F.create_map(*pairs)[F.lower("l1")]
    suffix = F.array(*[F.when(country == n, F.lit(math.log(4.0))).otherwise(F.lit(0.0)) for n in names])
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = add(add(F.col("evidence"), F.transform("prior", lambda p: F.log(p))), add(F.col("said"), F.coalesce(suffix, F.array(*[F.lit(0.0)] * k))))
    put = put.withColumn("post", total).withColumn("top", F.array_max("post"))
    mass = F.aggregate(F.transform("post", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    return put.select("uid", guess(F.col("post")).alias("lang_id"), (F.lit(1.0) / mass).alias("probability"))


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """(page_id, url, lang_id, probability) of every page, from its text, markup language and address."""
    lang = F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)
    rows = checkpointed(only(pages, "page_id", "url", "html").withColumn("uid", F.monotonically_increasing_id()))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    facts = rows.select("uid", F.col("html").alias("text"), F.nullif(host, F.lit("")).alias("host"), F.nullif(F.lower(lang), F.lit("")).alias("declared"))
    found = identify(facts, fit(labelled), markup=True)
    return rows.select("uid", "page_id", "url").join(found, "uid").drop("uid")


def identify_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with lang_id and probability; source stands for the host, lang for the declaration."""
    rows = docs.withColumn("uid", F.monotonically_increasing_id())
    rows = checkpointed(rows)
    facts = rows.select("uid", "text", F.col("source").alias("host"), F.col("lang").alias("declared"))
    return rows.join(identify(facts, fit(rows)), "uid").drop("uid")
