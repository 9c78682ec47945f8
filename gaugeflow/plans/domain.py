"""Sensor and experiment tables read out of general business tables.

The benchmark data are orders, events and embeddings; each function says which sensor
concept its columns stand for. Only the columns used are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.functions.scalars import sigmoid
from gaugeflow.operators.degrade import DEGRADATIONS
from gaugeflow.operators.ranking import sequence_positions

CHANNELS, SERIES_LENGTH = 4, 16
CHANNEL_NAMES = ("c0", "c1", "c2", "c3")
CONFIG_NAMES = {"NO": "full", "AF": "w/o_spectral", "AO": "w/o_temporal", "NF": "w/o_fusion", "RF": "w/o_gating", "RO": "full_r1"}
PRIORITY_NAMES = {
    "1-URGENT": "full", "2-HIGH": "w/o_spectral", "3-MEDIUM": "w/o_temporal", "4-NOT SPECIFIED": "w/o_fusion", "5-LOW": "w/o_gating"}
CELLS = ("O", "A", "B", "C", "D")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spreads a table that has fewer partitions than the cluster has cores, ahead of work
    that is heavy per row. A table of enough files is left where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _lookup(column, names: dict[str, str]):
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), column)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in time order are the samples of one run; five classes of runs."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    placed = sequence_positions(ev, ["user_id"], ["ts", "event_id"], "ts")
    return placed.select(
        F.concat(F.lit("R"), "user_id").alias("run_id"), F.concat(F.lit("C"), F.col("user_id") % 5).alias("class"),
        "pos", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("level"))


def channel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs in long form with two channels: the event's value and its level."""
    ids = ["run_id", "class", "pos"]
    return samples(spark, sf_dir).select(*ids, "value", "level").unpivot(ids, ["value", "level"], "channel", "value")


def gappy_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types are channels: at each position only one channel has a reading, and only
    readings above the channel's floor count; everything else is a gap."""
    types = F.explode(F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")]))
    floor = F.when(F.col("channel").isin("click", "error"), 60.0).otherwise(5.0)
    reading = F.when((F.col("event_type") == F.col("channel")) & (F.col("value") > floor), F.col("value"))
    return samples(spark, sf_dir).withColumn("channel", types).select("run_id", "class", "channel", "pos", reading.alias("value"))


def multirate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's line items in order are one unit: quantity is the fast channel, tax and
    discount, kept every tenth sample, are slow ones."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_tax", "l_discount", *order)
    placed = sequence_positions(li, ["l_suppkey"], order, "l_shipdate").withColumnRenamed("l_suppkey", "unit")
    at, slow_at = F.col("pos"), F.floor(F.col("pos") / 10).cast("long")

    def reading(channel, pos, value):
        return F.struct(F.lit(channel).alias("channel"), pos.alias("pos"), F.col(value).alias("value"))

    fast = reading("vibration", at, "l_quantity")
    all_three = F.array(fast, reading("force", slow_at, "l_tax"), reading("torque", slow_at, "l_discount"))
    readings = F.when(at % 10 == 0, all_three).otherwise(F.array(fast))
    return placed.select("unit", F.explode(readings).alias("_s")).select("unit", "_s.*")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding is one window of four channels with 16 samples each."""
    parts = F.array(*[F.slice("embedding", c * SERIES_LENGTH + 1, SERIES_LENGTH).cast("array<double>") for c in range(CHANNELS)])
    emb = spread(table(spark, sf_dir, "embeddings"), "vec_id")
    return emb.select(F.col("vec_id").alias("window_id"), "label", F.posexplode(parts).alias("_c", "series")).select(
        "window_id", F.concat(F.lit("L"), "label").alias("class"), F.concat(F.lit("c"), "_c").alias("channel"), "series")


def alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing weights: a squashed copy of the windows."""
    return windows(spark, sf_dir).withColumn("series", F.transform("series", lambda x: sigmoid(5.0 * x)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("window_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))


def document_predictions(spark: SparkSession, sf_dir: str, threshold: int = 1500) -> DataFrame:
    """Truth is a document's quality label, the prediction whether it is long."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y_true"))
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("window_id"), "source", "y_true", F.when(F.col("n_chars") > threshold, 1).otherwise(0).alias("y_pred"))


def _month_seed(date):
    return (F.year(date) * 12 + F.month(date)).cast("int")


def finals(spark: SparkSession, sf_dir: str, by_cell: bool = False, seed: str = "month") -> DataFrame:
    """Line items grouped by flag pair (configuration) and month or year (seed): average
    rates stand for the scores, line numbers for the degradations."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
    number = _month_seed("l_shipdate") if seed == "month" else F.year("l_shipdate")
    d = li.select(
        F.element_at(F.array(*[F.lit(c) for c in CELLS]), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("cell"),
        _lookup(F.concat("l_returnflag", "l_linestatus"), CONFIG_NAMES).alias("config"), number.alias("seed"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    keys = ["cell", "config", "seed"] if by_cell else ["config", "seed"]
    deg = F.map_filter(F.map_from_arrays(
        F.array(*[F.lit(n) for n in DEGRADATIONS]),
        F.array(*[F.avg(F.when(F.col("l_linenumber") == i, F.col("l_discount"))) * 10 for i in range(1, 8)])),
        lambda k, v: v.isNotNull())
    out = d.groupBy(*keys).agg(
        (F.avg("l_discount") * 10).alias("accuracy"), (F.avg("l_tax") * 10).alias("macro_f1"),
        (F.avg("l_quantity") / 50).alias("H_alpha"), F.var_pop("l_discount").alias("alpha_tvar"),
        F.avg(F.when(F.col("l_quantity") > 42, 1.0).otherwise(0.0)).alias("S_tau"),
        (F.avg("l_extendedprice") / 30000).alias("rho_last"),
        F.avg(F.when(F.col("l_quantity") > 45, F.col("l_tax"))).alias("perm_null_z"),
        F.avg("l_quantity").alias("observed_var"), F.avg("l_tax").alias("null_mean"), F.var_pop("l_tax").alias("null_std"),
        deg.alias("degradation"))
    return out


def epochs(spark: SparkSession, sf_dir: str, by_cell: bool = False) -> DataFrame:
    """Orders grouped by priority (configuration), customer (seed) and month or quarter (epoch)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    months = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    epoch = F.floor(months / 3) if by_cell else months
    seed = F.floor(F.col("o_custkey") / 5) % 10 if by_cell else F.col("o_custkey") % 10
    d = o.select(
        F.element_at(F.array(*[F.lit(c) for c in CELLS]), (F.col("o_custkey") % 5 + 1).cast("int")).alias("cell"),
        _lookup(F.col("o_orderpriority"), PRIORITY_NAMES).alias("config"), seed.cast("int").alias("seed"),
        epoch.cast("int").alias("epoch"), "o_totalprice", "o_orderstatus")
    price = F.col("o_totalprice")
    keys = ["cell", "config", "seed", "epoch"] if by_cell else ["config", "seed", "epoch"]
    return d.groupBy(*keys).agg(
        (F.avg(price) / 500000).alias("val_acc"), (F.avg(price) / 150000).alias("rho"),
        F.avg(F.when(price > 400000, 1.0).otherwise(0.0)).alias("s_tau"), (F.min(price) / 500000).alias("h_alpha"),
        F.coalesce(F.avg(F.when(F.col("o_orderstatus") == "O", price)) / 500000, F.lit(0.5)).alias("acc_t_aux"),
        F.coalesce(F.avg(F.when(F.col("o_orderstatus") == "F", price)) / 500000, F.lit(0.5)).alias("acc_f_aux"))
