"""Queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.llm import bytepairs, clustering, html, language, merkle, mixing, ngrams, packing, pieces, resampling, sharding, simhash, vectors
from gaugeflow.llm.common import as_unsigned

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_simhash_near_dedup")
def op9(spark, sf_dir):
    """SimHash classes of all documents."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", as_unsigned(F.col("fp")).alias("fingerprint"), "component_id")


@query("op2_token_counts")
def op2(spark, sf_dir):
    """Greedy word-piece counts of all documents."""
    return pieces.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_extendible_shards")
def op4(spark, sf_dir):
    """Shards of all documents, none over the byte limit unless one document is."""
    return sharding.shards(table(spark, sf_dir, "documents"))


@query("op6_source_mixing")
def op6(spark, sf_dir):
    """Words that the mix takes of every document."""
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query("op8_sequence_packing")
def op8(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op10_merkle_fingerprints")
def op10(spark, sf_dir):
    """Tree fingerprints of all documents and of their edited texts."""
    return merkle.versions(table(spark, sf_dir, "documents"))


@query("op1_html_main_text")
def op1(spark, sf_dir):
    """Main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages"))


@query("op3_embedding_near_dedup")
def op3(spark, sf_dir):
    """Links and classes of all embeddings."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_language_id")
def op5(spark, sf_dir):
    """Language of all pages, from text, markup, address and host."""
    return language.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op7_ngram_scores")
def op7(spark, sf_dir):
    """Model and base scores of all documents."""
    return ngrams.scores(table(spark, sf_dir, "documents"))


# CRC-32 of a word's bytes, from the UTF-8 bytes of its code points; 3988292384 is its fixed polynomial
_RESAMPLING = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
target AS (
  SELECT list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
doc_words AS (SELECT doc_id, unnest(words) AS w FROM docs),
target_words AS (SELECT unnest(words) AS w FROM target),
vocab AS (SELECT DISTINCT w FROM (SELECT w FROM doc_words UNION ALL SELECT w FROM target_words)),
points AS (SELECT w, i, ascii(substr(w, i, 1)) AS c FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM vocab)),
bytes AS (
  SELECT w, i * 4 AS place, CASE WHEN c < 128 THEN c WHEN c < 2048 THEN 192 + c // 64 WHEN c < 65536 THEN 224 + c // 4096 ELSE 240 + c // 262144 END AS b FROM points
  UNION ALL SELECT w, i * 4 + 1, CASE WHEN c < 2048 THEN 128 + c % 64 WHEN c < 65536 THEN 128 + c // 64 % 64 ELSE 128 + c // 4096 % 64 END FROM points WHERE c > 127
  UNION ALL SELECT w, i * 4 + 2, CASE WHEN c < 65536 THEN 128 + c % 64 ELSE 128 + c // 64 % 64 END FROM points WHERE c > 2047
  UNION ALL SELECT w, i * 4 + 3, 128 + c % 64 FROM points WHERE c > 65535),
strings AS (SELECT w, list(b ORDER BY place) AS bs FROM bytes GROUP BY w),
turns AS (
  SELECT n, list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(0, 256))::BIGINT AS n)),
steps AS (SELECT list(v ORDER BY n) AS t FROM turns),
buckets AS (
  SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], bs), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 10000 AS bucket
  FROM strings, steps),
s AS (SELECT bucket, count(*) AS n FROM doc_words JOIN buckets USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_words JOIN buckets USING (w) GROUP BY bucket),
gains AS (
  SELECT w, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (a.n + 10000)) / ((coalesce(s.n, 0) + 1)::DOUBLE * (b.n + 10000))))::BIGINT AS gain
  FROM buckets LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket),
    (SELECT count(*) AS n FROM doc_words) a, (SELECT count(*) AS n FROM target_words) b),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM doc_words JOIN gains USING (w) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM ranked) THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""


@query("op11_importance_resampling", _RESAMPLING)
def op11(spark, sf_dir):
    """A tenth of the documents, drawn towards the benchmark's words."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _clustering(rounds: int = clustering.ROUNDS) -> str:
    """Every round is an assignment and new centroids, written out one after the other."""
    steps = ["""kept AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             """c0 AS (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS cluster, v AS c
  FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT 40))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT n, vec_id, v, d[1] AS distance, d[2]::INTEGER AS cluster FROM (
    SELECT n, any_value(vec_id) AS vec_id, any_value(v) AS v,
      min([list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, cluster::BIGINT]) AS d FROM kept, c{r} GROUP BY n))""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list(((total - ((total % size) + size) % size) // size)::BIGINT ORDER BY i) AS m FROM (
      SELECT cluster, i, sum(v[i])::BIGINT AS total, count(*) AS size FROM a{r}, range(1, 65) AS g(i) GROUP BY cluster, i) GROUP BY cluster) USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


@query("op12_centroid_clustering", _clustering())
def op12(spark, sf_dir):
    """Clusters of all embeddings."""
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


@query("op13_byte_bpe_round_trip")
def op13(spark, sf_dir):
    """Ids of all documents and what they decode to."""
    return bytepairs.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
