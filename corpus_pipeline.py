"""Corpus preparation as a chain of stages, each written as Parquet and read again as the next one's input.

Language ID drops documents that no language explains. Near-dedup keeps the document with the smallest id of
each class of texts whose sets of five-word shingles have a similarity of 0.8 or more: candidates by SimHash and multi-index hashing,
verified, then an exact search for what SimHash leaves apart. Mixing repeats, keeps, cuts or leaves out documents as their source's
target asks. Packing lays the result out in sequences. SQL can express none of the models and searches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.llm import copies, language, mixing, packing
from gaugeflow.llm.common import cut_words, only, written
from gaugeflow.session import checkpointed, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language explains."""
    found = language.identify_documents(only(docs, *COLUMNS))
    return found.filter(F.col("lang_id") != language.UNKNOWN).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of every class of near copies; a repeated row counts as a copy."""
    rows = placed(docs)
    if rows is None:  # not a file table: its rows have no lasting place
        rows = placed(written(only(docs, *COLUMNS)))
    keyed = rows.select(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "file", "row").alias("at"), "text")
    classes = copies.near_copies(keyed, "at")
    # one bit a row, as a table of known size: where that is small enough Spark sends it to the texts, not the texts to it
    kept = written(classes.filter("at = component_id").select("at.*").groupBy("file", F.bitmap_bucket_number("row").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits")))
    at = F.bitmap_bit_position("row")
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("part", F.bitmap_bucket_number("row")).join(kept, ["file", "part"])
    return found.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*COLUMNS)


def placed(docs: DataFrame) -> DataFrame | None:
    """The rows with their file and their row number in it, from 1; None where ``docs`` does not read files."""
    if "_metadata" in docs.columns:
        return None
    try:
        return docs.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), (F.col("_metadata.row_index") + 1).alias("row"))
    except AnalysisException:
        return None


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and pass: the whole text where the pass takes all of it, else the words it takes."""
    rows = checkpointed(only(docs, *COLUMNS).withColumn("uid", F.monotonically_increasing_id()))
    m = mixing.mix(rows.withColumn("number", F.col("uid")), "number")
    # the mix numbers its rows itself; its documents lead back to ours
    passes = m.blocks.groupBy("uid", "epoch").agg(F.sort_array(F.collect_list("start")).alias("starts"), F.sum("words").alias("words"))
    passes = passes.join(m.documents.select("uid", "number", "size"), "uid").select(
        F.col("number").alias("uid"), F.when(F.col("words") < F.col("size"), F.col("starts")).alias("starts"))
    given = rows.join(passes, "uid").select(*COLUMNS, "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() if s.as_py() is None else cut_words(t.as_py(), s.as_py(), mixing.BLOCK) for t, s in zip(b.column("text"), b.column("starts"))]
            cols = {c: b.column(c) for c in COLUMNS} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.record_batch(list(cols.values()), names=list(cols))

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" if c != "n_chars" else "n_chars long" for c in COLUMNS)
    return given.mapInArrow(cut, schema)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
