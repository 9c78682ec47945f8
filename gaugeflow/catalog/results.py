"""Queries on predictions, run logs, training curves and per-seed results."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.catalog.base import (
    DEGRADED, ELEMENTS, degradation_sql, epochs_sql, finals_sql, query, r,
)
from gaugeflow.functions.scalars import (
    array_mean, array_var_pop, config_slug, mean_from_text, once, percent_points, std_from_text, std_or_zero,
)
from gaugeflow.operators import cleaning, epochs as ep, evaluation, reports
from gaugeflow.plans import domain, grids
from gaugeflow.plans.domain import table
from gaugeflow.session import scratch
from gaugeflow.sources import runfiles, runlogs, tables

# ---- predictions -----------------------------------------------------------------------

_F1 = """cls AS (SELECT {g}label, sum(tp) AS tp, sum(s) AS s, sum(p) AS p FROM (
  SELECT {g}y_true AS label, count(*) FILTER (y_true = y_pred) AS tp, count(*) AS s, 0 AS p FROM pr GROUP BY ALL
  UNION ALL SELECT {g}y_pred, 0, 0, count(*) FROM pr GROUP BY ALL) GROUP BY ALL),
f1 AS (SELECT *, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS pre, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS rec,
  CASE WHEN s + p > 0 THEN 2 * tp / (s + p) ELSE 0 END AS f FROM cls)"""
_DOCS = """pr AS (SELECT doc_id AS window_id, source, quality AS y_true, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS y_pred
  FROM labels JOIN documents USING (doc_id))"""
_CENTROID = ELEMENTS + """,
cen AS (SELECT class, channel, t, avg(v) AS c FROM el GROUP BY ALL),
ds AS (SELECT e.window_id, e.class AS y_true, c.class AS y_pred, sum((v - c) ** 2) AS d FROM el e JOIN cen c USING (channel, t) GROUP BY ALL),
pr AS (SELECT window_id, y_true, y_pred FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY d, y_pred) AS rk FROM ds) WHERE rk = 1)"""


def _nearest(spark, sf):
    """Nearest-centroid class of every window."""
    d = domain.vectors(spark, sf).withColumn("y_true", F.concat(F.lit("L"), "label"))
    return evaluation.nearest_class(d, evaluation.centroids(d, "y_true", "vector"), ["window_id", "y_true"], "y_true", "vector")


@query("accuracy_and_macro_f1", f"""
WITH {_DOCS}, {_F1.format(g='source, ')} SELECT source, {r('sum(tp) / sum(s)')} AS accuracy, {r('avg(f)')} AS macro_f1, sum(s)::BIGINT AS n FROM f1 GROUP BY source
""")
def accuracy_and_macro_f1(spark, sf):
    return evaluation.accuracy_macro_f1(domain.document_predictions(spark, sf), ["source"])


@query("centroid_accuracy", f"""
WITH {_CENTROID}, {_F1.format(g='')} SELECT {r('sum(tp) / sum(s)')} AS accuracy, {r('avg(f)')} AS macro_f1, sum(s)::BIGINT AS n FROM f1
""")
def centroid_accuracy(spark, sf):
    return evaluation.accuracy_macro_f1(_nearest(spark, sf))


@query("class_scores", f"""
WITH {_CENTROID}, {_F1.format(g='')} SELECT label, s::BIGINT AS support, p::BIGINT AS predicted, tp::BIGINT AS tp, {r('pre')} AS precision, {r('rec')} AS recall, {r('f')} AS f1 FROM f1
""")
def class_scores(spark, sf):
    return evaluation.class_scores(evaluation.count_pairs(_nearest(spark, sf)))


_CONFUSION = _CENTROID + """,
names AS (SELECT DISTINCT class AS label FROM el UNION SELECT 'L99'),
cm AS (SELECT a.label AS y_true, b.label AS y_pred, count(pr.window_id) AS n FROM names a CROSS JOIN names b
  LEFT JOIN pr ON pr.y_true = a.label AND pr.y_pred = b.label GROUP BY ALL)"""


def _matrix(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.concat(F.lit("L"), "label").alias("label")).distinct()
    labels = labels.unionByName(spark.createDataFrame([("L99",)], "label string"))
    return evaluation.confusion_matrix(_nearest(spark, sf), labels)


@query("confusion_matrix", f"""
WITH {_CONFUSION} SELECT y_true, y_pred, n, {r('coalesce(n / nullif(sum(n) OVER (PARTITION BY y_true), 0), 0)')} AS share FROM cm
""")
def confusion_matrix(spark, sf):
    """Full label grid, with a label that never occurs."""
    return _matrix(spark, sf)


@query("confusion_accuracy", f"WITH {_CONFUSION} SELECT {r('sum(n) FILTER (y_true = y_pred) / sum(n)')} AS accuracy FROM cm")
def confusion_accuracy(spark, sf):
    return evaluation.implied_accuracy(_matrix(spark, sf))


@query("prediction_dump", f"""
WITH {_CENTROID} SELECT window_id, 'class ' || y_true AS class_name, y_true, y_pred, (y_true = y_pred)::BIGINT AS correct FROM pr
""")
def prediction_dump(spark, sf):
    names = table(spark, sf, "embeddings").select(F.concat(F.lit("L"), "label").alias("label")).distinct()
    return evaluation.prediction_dump(_nearest(spark, sf), names.withColumn("class", F.concat(F.lit("class "), "label")), ["window_id"])


@query("example_windows", f"""
WITH {_DOCS}, a AS (SELECT y_true, arg_min(window_id, (CASE WHEN y_true = y_pred THEN 0 ELSE 1 END) * 1000000000 + window_id) AS window_id,
  max((y_true = y_pred)::BIGINT) AS has_correct FROM pr GROUP BY y_true)
SELECT y_true, window_id, has_correct FROM a ORDER BY y_true LIMIT 5
""")
def example_windows(spark, sf):
    return evaluation.example_windows(domain.document_predictions(spark, sf))


@query("example_saturation", f"""
WITH {_CENTROID}, a AS (SELECT y_true, arg_min(window_id, (CASE WHEN y_true = y_pred THEN 0 ELSE 1 END) * 1000000000 + window_id) AS window_id,
  max((y_true = y_pred)::BIGINT) AS has_correct FROM pr GROUP BY y_true),
p AS (SELECT * FROM a ORDER BY y_true LIMIT 5)
SELECT p.y_true, p.window_id, p.has_correct, {r('avg(CASE WHEN 1 / (1 + exp(-5 * v)) > 0.6 THEN 1.0::DOUBLE ELSE 0 END)', 10)} AS saturation
FROM p JOIN el ON el.window_id = p.window_id GROUP BY ALL
""", digits=10)
def example_saturation(spark, sf):
    """First correct window of five classes and how saturated its gates are."""
    return evaluation.attach_saturation(evaluation.example_windows(_nearest(spark, sf)), domain.alphas(spark, sf), tau=0.6)


_SILHOUETTE = """
WITH e AS (SELECT vec_id, label, {v} AS v FROM embeddings),
pr AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a, e b GROUP BY ALL),
m AS (SELECT vec_id, max(CASE WHEN la = lb AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM pr GROUP BY vec_id)
SELECT {out} AS silhouette, count(*) AS n FROM m"""
_SCORE = r("avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)")
_VALUES = "list_transform(embedding, lambda x: x::DOUBLE)"
_CHANNELS = [f"({_VALUES})[{c * 16 + 1}:{c * 16 + 16}]" for c in range(4)]


@query("silhouette_raw", _SILHOUETTE.format(v=_VALUES, out=_SCORE))
def silhouette_raw(spark, sf):
    """All components of all windows as they are."""
    return evaluation.silhouette(domain.vectors(spark, sf), "window_id", "label", "vector")


@query("silhouette_features", _SILHOUETTE.format(
    v="[" + ", ".join(f"{f}({c})" for c in _CHANNELS for f in ("list_avg", "list_stddev_pop", "list_min", "list_max")) + "]", out=_SCORE))
def silhouette_features(spark, sf):
    """Features of all windows: mean, deviation and extremes of each channel, from all of its samples."""
    parts = [F.slice("vector", c * domain.SERIES_LENGTH + 1, domain.SERIES_LENGTH) for c in range(domain.CHANNELS)]
    features = F.array(*[f for p in parts for f in (array_mean(p), F.sqrt(array_var_pop(p)), F.array_min(p), F.array_max(p))])
    return evaluation.silhouette(domain.vectors(spark, sf).select("window_id", "label", features.alias("v")), "window_id", "label", "v")


# ---- run logs ---------------------------------------------------------------------------

_LOGS = """lines AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'full' WHEN '2-HIGH' THEN 'wo_spectral' WHEN '3-MEDIUM' THEN 'wo_temporal'
    WHEN '4-NOT SPECIFIED' THEN 'wo_fusion' WHEN '5-LOW' THEN 'wo_gating' END AS slug,
    o_custkey % 400 AS seed, o_orderkey AS line_no, o_orderstatus AS st, o_totalprice AS p, o_custkey AS k FROM orders)"""


def _log_lines(spark, sf, runs=400):
    """Orders as log lines, already in memory: status F is a final record, O an epoch, P a broken line."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    o = domain.spread(o, "o_orderkey")
    config = F.element_at(F.create_map(*[F.lit(x) for kv in domain.PRIORITY_NAMES.items() for x in kv]), F.col("o_orderpriority"))
    p = F.col("o_totalprice")
    final = F.to_json(F.struct(F.struct(
        (p / 500000).alias("accuracy"), (p / 600000).alias("macro_f1"), F.lit(20).alias("epochs_run"),
        F.create_map(F.lit("drift"), p / 700000, F.lit("bias"), p / 800000).alias("degradation"),
        F.struct((p / 1000).alias("observed_var"), F.when(F.col("o_custkey") % 3 != 0, p / 900).alias("z")).alias("perm_null")).alias("final")))
    epoch = F.to_json(F.struct((F.col("o_orderkey") % 50).cast("int").alias("epoch"), (p / 500000).alias("val_acc"),
                               F.when(F.col("o_custkey") % 2 == 0, p / 150000).alias("rho")))
    line = F.when(F.col("o_orderstatus") == "F", final).when(F.col("o_orderstatus") == "O", epoch).otherwise('{"epoch": ')
    name = F.concat(config_slug(config), F.lit("_seed"), (F.col("o_custkey") % runs).cast("string"), F.lit(".jsonl"))
    return once(o.select("*", name.alias("file"), F.col("o_orderkey").alias("line_at")), "line", line).select("file", "line_at", "line")


def _parsed(spark, sf):
    return runlogs.parse_lines(_log_lines(spark, sf))


@query("log_final_records", f"""
WITH {_LOGS}, f AS (SELECT slug, seed, arg_max(p, line_no) AS p, arg_max(k, line_no) AS k FROM lines WHERE st = 'F' GROUP BY ALL)
SELECT slug, seed, {r('p / 500000')} AS accuracy, {r('p / 600000')} AS macro_f1, 20 AS epochs_run, {r('p / 1000', 9)} AS observed_var,
  CASE WHEN k % 3 <> 0 THEN {r('p / 900', 9)} END AS perm_null_z, {r('p / 700000')} AS drift FROM f
""".replace(", 6) + 0.0)", ", 9) + 0.0)"), digits=9)
def log_final_records(spark, sf):
    """The last final record of each log; broken lines are skipped."""
    f = runlogs.final_records(_parsed(spark, sf))
    return f.select("slug", "seed", "accuracy", "macro_f1", "epochs_run", "observed_var", "perm_null_z", F.col("degradation")["drift"].alias("drift"))


@query("log_broken_lines", f"WITH {_LOGS} SELECT slug || '_seed' || seed || '.jsonl' AS file, count(*) AS bad_lines FROM lines WHERE st = 'P' GROUP BY ALL")
def log_broken_lines(spark, sf):
    return runlogs.malformed_lines(_parsed(spark, sf))


@query("log_broken_line_numbers", f"""
WITH {_LOGS.replace('% 400', '% 20')} SELECT file, line_no FROM (SELECT slug || '_seed' || seed || '.jsonl' AS file, st,
  row_number() OVER (PARTITION BY slug, seed ORDER BY line_no) - 1 AS line_no FROM lines) WHERE st = 'P'
""")
def log_broken_line_numbers(spark, sf):
    """Where in its log each broken line stands: log files written, read in blocks and numbered by sums over blocks."""
    folder = scratch(spark, "logs")
    runlogs.write_logs(_log_lines(spark, sf, runs=20), folder, "line_at")
    parsed = runlogs.parse_lines(runlogs.read_numbered_logs(spark, folder))
    return parsed.filter("rec._bad IS NOT NULL").select("file", "line_no")


@query("log_read_summary", f"""
WITH {_LOGS.replace('% 400', '% 20')} SELECT slug, seed, count(*) AS lines, count(*) FILTER (st = 'O') AS epochs, {r("arg_max(CASE WHEN st = 'F' THEN p END, CASE WHEN st = 'F' THEN line_no END) / 500000", 9)} AS accuracy FROM lines GROUP BY ALL
""", digits=9)
def log_read_summary(spark, sf):
    """Log files read back in blocks: lines, epochs and the accuracy of the last final record of each run."""
    folder = scratch(spark, "logs")
    runlogs.write_logs(_log_lines(spark, sf, runs=20), folder, "line_at")
    parsed = runlogs.parse_lines(runlogs.read_logs(spark, folder))
    final = F.col("rec._bad").isNull() & F.col("rec.final").isNotNull()
    return parsed.groupBy("slug", "seed").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("rec._bad").isNull() & F.col("rec.epoch").isNotNull()).alias("epochs"),
        F.max_by(F.when(final, F.col("rec.final.accuracy")), F.when(final, F.col("line_at"))).alias("accuracy"))


@query("log_unfinished_files", f"WITH {_LOGS} SELECT slug || '_seed' || seed || '.jsonl' AS file FROM lines GROUP BY ALL HAVING count(*) FILTER (st = 'F') = 0")
def log_unfinished_files(spark, sf):
    return runlogs.unfinished_files(_parsed(spark, sf))


@query("log_epoch_records", f"""
WITH {_LOGS} SELECT CASE slug WHEN 'full' THEN slug ELSE 'w/o' || substr(slug, 3) END AS config, seed, count(*) AS epochs,
  count(CASE WHEN k % 2 = 0 THEN 1 END) AS with_rho, {r('max(p / 500000)', 9)} AS best FROM lines WHERE st = 'O' GROUP BY ALL
""", digits=9)
def log_epoch_records(spark, sf):
    """Epoch lines by configuration name (looked up by slug) and seed."""
    e = runlogs.name_configs(runlogs.epoch_records(_parsed(spark, sf)), grids.config_grid(spark))
    return e.groupBy("config", "seed").agg(F.count(F.lit(1)).alias("epochs"), F.count("rho").alias("with_rho"), F.max("val_acc").alias("best"))


@query("dotted_columns", f"""
WITH {finals_sql()} SELECT config AS "run.config", seed AS "run.seed", {r('accuracy')} AS "final.accuracy", {r('observed_var')} AS "final.perm_null.observed_var",
  {r('null_mean')} AS "final.perm_null.null_mean" FROM finals
""")
def dotted_columns(spark, sf):
    """Nested records flattened to columns named by their path."""
    f = domain.finals(spark, sf).select(
        F.struct("config", "seed").alias("run"), F.struct("accuracy", F.struct("observed_var", "null_mean").alias("perm_null")).alias("final"))
    return f.select(*[c for c in runlogs.dotted_columns(f)])


@query("objects_holding_keys", f"""
WITH o AS (SELECT o_orderkey, o_totalprice AS p FROM orders)
SELECT json_path, count(*) AS objects, {r('sum(p)', 2)} AS total FROM (
  SELECT '$' AS json_path, 0 AS p FROM o WHERE false UNION ALL SELECT '$.a', p FROM o UNION ALL SELECT '$.list[0].b', p + 1 FROM o UNION ALL SELECT '$.list[1]', p + 2 FROM o) GROUP BY ALL
""", digits=2)
def objects_holding_keys(spark, sf):
    """Objects at any depth of a JSON text that hold both keys."""
    p = F.col("o_totalprice")
    doc = F.to_json(F.struct(
        F.struct(p.alias("rho"), F.lit(1).alias("epoch")).alias("a"), F.struct(p.alias("rho")).alias("c"),
        F.array(F.struct(F.struct((p + 1).alias("rho"), F.lit(2).alias("epoch")).alias("b"), F.lit(None).cast("double").alias("rho"), F.lit(None).cast("int").alias("epoch")),
                F.struct(F.lit(None).cast("struct<rho:double,epoch:int>").alias("b"), (p + 2).alias("rho"), F.lit(3).alias("epoch"))).alias("list")))
    d = table(spark, sf, "orders").select("o_orderkey", doc.alias("doc"))
    hits = runlogs.objects_holding(d, "doc", ["rho", "epoch"])
    return hits.groupBy("json_path").agg(F.count(F.lit(1)).alias("objects"), F.sum(F.get_json_object("object", "$.rho").cast("double")).alias("total"))


@query("canonical_columns", "SELECT p_partkey AS id, p_size AS size, p_retailprice AS price FROM part")
def canonical_columns(spark, sf):
    """Columns found whatever their case and spacing."""
    odd = table(spark, sf, "part").select(
        F.col("p_partkey").alias(" ID"), F.col("p_retailprice").alias("Price "), F.col("p_size").alias("SIZE"), F.col("p_name").alias("other"))
    return runfiles.canonical_frame(odd, ("size", "price"), ("id", "sample"))


@query("absent_files", """
WITH want(name) AS (VALUES ('5'), ('76'), ('page-0'), ('zzz')), have AS (
  SELECT DISTINCT string_split(regexp_extract(url, '^https?://([^?#]*)', 1), '/')[-1] AS name FROM pages)
SELECT name FROM want ANTI JOIN have USING (name)
""")
def absent_files(spark, sf):
    """Expected names a listing lacks; nothing is opened."""
    listing = table(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path"))
    return runfiles.absent_files(spark, listing, ["5", "76", "page-0", "zzz"])


@query("sensor_columns", "SELECT l_linenumber, sum(l_quantity) AS l_quantity, count(*) AS n FROM lineitem GROUP BY 1")
def sensor_columns(spark, sf):
    """Numeric columns only, index-like ones left out by name."""
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("Id"), F.col("l_shipdate").alias("Time"), "l_returnflag", "l_linenumber", "l_quantity")
    s = cleaning.select_sensors(d)
    return s.groupBy("l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"), F.count(F.lit(1)).alias("n"))


# ---- training curves --------------------------------------------------------------------

@query("early_stopping", f"""
WITH {epochs_sql()}, a AS (
  SELECT config, seed, epoch, val_acc, row_number() OVER w AS n, coalesce(val_acc > max(val_acc) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better
  FROM epochs WINDOW w AS (PARTITION BY config, seed ORDER BY epoch)),
b AS (SELECT *, max(CASE WHEN better THEN n END) OVER (PARTITION BY config, seed ORDER BY epoch) AS bn FROM a),
c AS (SELECT *, min(CASE WHEN n - bn >= 10 THEN n END) OVER (PARTITION BY config, seed) AS stop_n FROM b),
d AS (SELECT * FROM c WHERE stop_n IS NULL OR n <= stop_n),
e AS (SELECT config, seed, max(bn) AS bn, max(epoch) AS last_epoch, count(*) AS epochs_run, bool_or(stop_n IS NOT NULL) AS stopped FROM d GROUP BY ALL)
SELECT e.config, e.seed, d.epoch AS best_epoch, {r('d.val_acc', 10)} AS best_value, e.last_epoch, e.epochs_run, e.stopped
FROM e JOIN d ON d.config = e.config AND d.seed = e.seed AND d.n = e.bn
""", digits=10)
def early_stopping(spark, sf):
    return ep.early_stopping(domain.epochs(spark, sf), 10)


@query("last_rho", f"WITH {epochs_sql()} SELECT config, seed, {r('arg_max(rho, epoch)', 10)} AS rho_last FROM epochs GROUP BY ALL", digits=10)
def last_rho(spark, sf):
    return ep.last_value(domain.epochs(spark, sf))


@query("rho_curve", f"WITH {epochs_sql()} SELECT config, seed, epoch, {r('rho', 10)} AS rho FROM epochs WHERE epoch % 7 <> 0", digits=10)
def rho_curve(spark, sf):
    """Epochs with a value; every seventh has none here."""
    e = domain.epochs(spark, sf).withColumn("rho", F.when(F.col("epoch") % 7 != 0, F.col("rho")))
    return ep.curve(e)


@query("mean_curves", f"""
WITH {epochs_sql()} SELECT config, epoch, {r('avg(rho)', 10)} AS rho_mean, {r('coalesce(stddev_samp(rho), 0)', 10)} AS rho_std,
  {r('avg(s_tau)', 10)} AS s_tau_mean, {r('coalesce(stddev_samp(s_tau), 0)', 10)} AS s_tau_std, count(*) AS runs FROM epochs GROUP BY ALL
""", digits=10)
def mean_curves(spark, sf):
    return ep.mean_curve(domain.epochs(spark, sf), ("rho", "s_tau"))


@query("early_mean_curve", f"""
WITH {epochs_sql()} SELECT config, epoch, {r('avg(rho)', 10)} AS rho_mean, {r('coalesce(stddev_samp(rho), 0)', 10)} AS rho_std, count(*) AS runs
FROM epochs WHERE epoch <= 15 AND config = 'full' GROUP BY ALL
""", digits=10)
def early_mean_curve(spark, sf):
    return ep.mean_curve(ep.early_epochs(domain.epochs(spark, sf), 15, "full"))


@query("curve_summary", f"""
WITH {epochs_sql()}, c AS (SELECT config, epoch, avg(rho) AS v FROM epochs GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY epoch) AS a, row_number() OVER (PARTITION BY config ORDER BY epoch DESC) AS b FROM c)
SELECT config, {r('median(v)')} AS median, {r('100 * avg(CASE WHEN v > 1.5 THEN 1.0::DOUBLE ELSE 0 END)')} AS above_pct,
  {r('avg(v) FILTER (a <= 5)')} AS first_mean, {r('avg(v) FILTER (b <= 5)')} AS last_mean FROM k GROUP BY config
""")
def curve_summary(spark, sf):
    return ep.curve_summary(domain.epochs(spark, sf))


@query("balancing_coefficients", f"""
WITH {epochs_sql()}, k AS (SELECT config, seed, epoch, acc_t_aux AS a, acc_f_aux AS b, row_number() OVER (PARTITION BY config, seed ORDER BY epoch) AS n FROM epochs),
e AS (SELECT x.config, x.seed, x.epoch, sum(CASE WHEN y.n = 1 THEN 1 ELSE 0.1::DOUBLE END * pow(0.9::DOUBLE, x.n - y.n) * y.a) AS t,
  sum(CASE WHEN y.n = 1 THEN 1 ELSE 0.1::DOUBLE END * pow(0.9::DOUBLE, x.n - y.n) * y.b) AS f
  FROM k x JOIN k y ON x.config = y.config AND x.seed = y.seed AND y.n <= x.n GROUP BY ALL)
SELECT config, seed, epoch, {r('t')} AS ema_t, {r('f')} AS ema_f, {r('2 * f / (t + f + 1e-8)')} AS coef_t, {r('2 * t / (t + f + 1e-8)')} AS coef_f FROM e
""")
def balancing_coefficients(spark, sf):
    """Recursive smoothing here, the weighted sum it equals in the SQL."""
    return ep.balancing_coefficients(domain.epochs(spark, sf))


# ---- result tables ----------------------------------------------------------------------

_RESULTS = """res AS (SELECT config, count(*) AS n, avg(accuracy) AS am, coalesce(stddev_samp(accuracy), 0) AS ad,
  avg(macro_f1) AS fm, coalesce(stddev_samp(macro_f1), 0) AS fd FROM finals GROUP BY config)"""


@query("results_table", f"""
WITH {finals_sql()}, {_RESULTS}, s AS (SELECT config, array_to_string(list(seed ORDER BY seed), ',') AS seeds FROM finals GROUP BY config)
SELECT config, n, seeds, {r('am')} AS accuracy_mean, {r('ad')} AS accuracy_std, {r('fm')} AS macro_f1_mean, {r('fd')} AS macro_f1_std FROM res JOIN s USING (config)
""")
def results_table(spark, sf):
    return reports.results_table(domain.finals(spark, sf))


@query("formatted_results", f"""
WITH {finals_sql()}, {_RESULTS} SELECT config, printf('%.4f±%.4f', am, ad) AS accuracy, printf('%.4f±%.4f', fm, fd) AS macro_f1 FROM res
""")
def formatted_results(spark, sf):
    return reports.formatted_results(reports.results_table(domain.finals(spark, sf)))


@query("parsed_cells", f"""
WITH {finals_sql()}, {_RESULTS} SELECT config, {r('round(am, 4)')} AS mean, {r('round(ad, 4)')} AS std FROM res
""")
def parsed_cells(spark, sf):
    """Numbers read back out of "mean±std" cells."""
    f = reports.formatted_results(reports.results_table(domain.finals(spark, sf)))
    return f.select("config", mean_from_text("accuracy").alias("mean"), std_from_text("accuracy").alias("std"))


@query("percent_points", f"WITH {finals_sql()} SELECT config, seed, {r('round(100 * accuracy, 2)')} AS accuracy_pp FROM finals")
def percent_points_query(spark, sf):
    return domain.finals(spark, sf).select("config", "seed", percent_points("accuracy").alias("accuracy_pp"))


@query("finite_values", f"""
WITH {finals_sql(by_cell=True)} SELECT config, count(*) AS runs, count(perm_null_z) AS usable, {r('avg(perm_null_z)')} AS mean, {r('coalesce(stddev_samp(perm_null_z), 0)')} AS std
FROM finals GROUP BY config
""")
def finite_values(spark, sf):
    """NaN written for a missing value is left out of mean and deviation."""
    f = domain.finals(spark, sf, by_cell=True).withColumn("z", F.coalesce("perm_null_z", F.lit(float("nan"))))
    ok = cleaning.finite_only(f, "z").groupBy("config").agg(F.count(F.lit(1)).alias("usable"), F.avg("z").alias("mean"), std_or_zero(F.col("z")).alias("std"))
    return f.groupBy("config").agg(F.count(F.lit(1)).alias("runs")).join(ok, "config", "left")


@query("indicator_table", f"""
WITH {finals_sql(by_cell=True)} SELECT cell, config, count(*) AS n, {r('avg(accuracy)')} AS accuracy_mean, {r('avg(h_alpha)')} AS "H_alpha", {r('avg(alpha_tvar)')} AS alpha_tvar,
  {r('avg(s_tau)')} AS "S_tau", {r('avg(rho_last)')} AS rho_last, {r('avg(perm_null_z)')} AS perm_null_z FROM finals GROUP BY ALL
""")
def indicator_table(spark, sf):
    return reports.indicator_table(domain.finals(spark, sf, by_cell=True), keys=("cell", "config"))


@query("null_table", f"""
WITH {finals_sql()} SELECT config, {r('avg(observed_var)')} AS observed_var, {r('avg(null_mean)')} AS null_mean, {r('avg(null_std)')} AS null_std,
  {r('avg(null_mean + 2 * null_std)')} AS threshold, {r('avg(perm_null_z)')} AS z_mean FROM finals GROUP BY config
""")
def null_table(spark, sf):
    return reports.null_table(domain.finals(spark, sf).withColumnRenamed("perm_null_z", "z"))


def _degradation(spark, sf, by_cell=False):
    keys = ["cell"] if by_cell else []
    return reports.degradation_means(reports.degradation_rows(domain.finals(spark, sf, by_cell), keys=keys), keys)


_DELTA = """dl AS (SELECT m.degradation, round(100 * avg(m.mean - c.mean), 2) AS d FROM degm m JOIN degm c ON c.config = m.config AND c.degradation = 'clean' {w} GROUP BY ALL)"""


@query("degradation_table", f"""
WITH {degradation_sql()}, {_DELTA.format(w='')} SELECT degradation, config, n, {r('mean')} AS mean, {r('std')} AS std, {r('d')} AS delta_pp FROM degm JOIN dl USING (degradation)
""")
def degradation_table(spark, sf):
    return reports.degradation_table(_degradation(spark, sf))


@query("degradation_table_baseline", f"""
WITH {degradation_sql()}, {_DELTA.format(w="WHERE m.config = 'full'")} SELECT degradation, config, n, {r('mean')} AS mean, {r('std')} AS std, {r('d')} AS delta_pp FROM degm JOIN dl USING (degradation)
""")
def degradation_table_baseline(spark, sf):
    """The loss of the baseline alone instead of the average over configurations."""
    return reports.degradation_table(_degradation(spark, sf), mode="baseline")


_CONFIGS = ("full", "w/o_spectral", "w/o_temporal", "w/o_fusion", "w/o_gating", "full_r1")


@query("degradation_pivot", f"""
WITH {degradation_sql()}, {_DELTA.format(w='')} SELECT degradation, {', '.join(f"max(printf('%.4f±%.4f', mean, std)) FILTER (config = '{c}') AS \"{c}\"" for c in _CONFIGS)},
  {r('max(d)')} AS delta_vs_clean_pp FROM degm JOIN dl USING (degradation) GROUP BY degradation
""")
def degradation_pivot(spark, sf):
    return reports.degradation_pivot(reports.degradation_table(_degradation(spark, sf)), _CONFIGS)


@query("drop_and_gain", f"""
WITH {degradation_sql(by_cell=True)}, w AS (SELECT cell, degradation, max(mean) FILTER (config = 'full') AS f, max(mean) FILTER (config = 'w/o_spectral') AS o FROM degm GROUP BY ALL)
SELECT w.cell, w.degradation, {r('(c.f - w.f) * 100')} AS drop_pp, {r('(w.o - w.f) * 100')} AS gain_pp FROM w JOIN w c ON c.cell = w.cell AND c.degradation = 'clean' WHERE w.degradation <> 'clean'
""")
def drop_and_gain(spark, sf):
    return reports.drop_and_gain(_degradation(spark, sf, True), "full", "w/o_spectral")


@query("change_against_baseline", f"""
WITH {finals_sql()}, {_RESULTS} SELECT a.config, {r('round(100 * (a.am - b.am), 2)')} AS change_pp FROM res a, res b WHERE b.config = 'full' AND a.config <> 'full'
""")
def change_against_baseline(spark, sf):
    return reports.change_against(reports.results_table(domain.finals(spark, sf)), "full")


@query("regime_map", f"""
WITH {epochs_sql(by_cell=True)}, {finals_sql(by_cell=True)},
a AS (SELECT cell, avg(rho) AS r, avg(s_tau) AS s FROM epochs WHERE config = 'full' AND epoch = 3 GROUP BY cell),
b AS (SELECT cell, avg(rho_last) AS r, avg(s_tau) AS s FROM finals WHERE config = 'full' GROUP BY cell)
SELECT cell, {r('a.r')} AS rho_early, {r('a.s')} AS s_early, {r('b.r')} AS rho_final, {r('b.s')} AS s_final FROM a JOIN b USING (cell)
""")
def regime_map(spark, sf):
    return reports.regime_map(domain.epochs(spark, sf, True), domain.finals(spark, sf, True))


@query("warning_rates", f"""
WITH {finals_sql(by_cell=True)}, t AS (
  SELECT 'all_available' AS subset, * FROM finals WHERE config = 'full' UNION ALL SELECT 'balanced', * FROM finals WHERE config = 'full' AND seed BETWEEN 23950 AND 23989)
SELECT subset, count(*) AS n_runs, array_to_string(list_sort(list(DISTINCT cell)), ',') AS cells, count(*) FILTER (s_tau > 0.15) AS n_d1,
  count(*) FILTER (rho_last > 1.5) AS n_d2, count(*) FILTER (s_tau > 0.15 AND rho_last > 1.5) AS n_both,
  {r('count(*) FILTER (s_tau > 0.15) / count(*)')} AS rate_d1, {r('count(*) FILTER (rho_last > 1.5) / count(*)')} AS rate_d2,
  {r('count(*) FILTER (s_tau > 0.15 AND rho_last > 1.5) / count(*)')} AS rate_both FROM t GROUP BY subset
""")
def warning_rates(spark, sf):
    return reports.warning_rates(domain.finals(spark, sf, True), seeds=(23950, 23989))


@query("routing_advice", f"""
WITH {finals_sql()}, d(degradation) AS (VALUES {', '.join(f"('{d}')" for d in DEGRADED)}, ('none'))
SELECT degradation, CASE WHEN degradation LIKE 'gaussian_noise%' OR degradation = 'dropout' THEN 'spectral-free'
  WHEN degradation = 'bias' THEN CASE WHEN s_tau > 0.15 THEN 'spectral-only' ELSE 'full' END
  WHEN degradation = 'drift' THEN 'full with warning' WHEN s_tau > 0.15 THEN 'responsive' WHEN rho_last > 3 THEN 'temporal dominates'
  WHEN rho_last < 0.8 THEN 'spectral dominates' ELSE 'balanced' END AS advice, count(*) AS runs FROM finals, d GROUP BY ALL
""")
def routing_advice(spark, sf):
    kinds = F.array(*[F.lit(d) for d in (*DEGRADED, "none")])
    f = domain.finals(spark, sf).withColumn("kind", F.explode(kinds))
    return f.groupBy(F.col("kind").alias("degradation"), reports.routing_advice("S_tau", "rho_last", "kind").alias("advice")).agg(F.count(F.lit(1)).alias("runs"))


_YEARS = range(1995, 2002)


@query("per_seed_matrix", f"""
WITH {finals_sql(seed='year')}, l AS (SELECT config, seed, 'Acc' AS metric, accuracy * 100 AS v FROM finals UNION ALL SELECT config, seed, 'F1', macro_f1 * 100 FROM finals)
SELECT config, metric, {', '.join(f"{r(f'round(max(v) FILTER (seed = {y}), 2)')} AS \"{y}\"" for y in _YEARS)}, {r('avg(v)')} AS mean, {r('coalesce(stddev_samp(v), 0)')} AS std,
  CASE config WHEN 'full' THEN 1 WHEN 'w/o_spectral' THEN 2 WHEN 'w/o_temporal' THEN 3 WHEN 'w/o_fusion' THEN 4 WHEN 'w/o_gating' THEN 6 WHEN 'full_r1' THEN 7 END::BIGINT AS place
FROM l GROUP BY config, metric
""")
def per_seed_matrix(spark, sf):
    return reports.per_seed_matrix(domain.finals(spark, sf, seed="year"), _YEARS, (*grids.ABLATIONS, *grids.REMEDIES))


@query("seed_by_cell", f"""
WITH {finals_sql(by_cell=True, seed='year')}, f AS (SELECT * FROM finals WHERE config = 'full')
{' UNION ALL '.join(f"SELECT {s} AS seed, " + ', '.join(f"{r(f'{a} FILTER (cell = {chr(39)}{c}{chr(39)})')} AS " + chr(34) + c + chr(34) for c in domain.CELLS) + f" FROM f GROUP BY 1"
  for s, a in (("seed::VARCHAR", "avg(rho_last)"), ("'Mean'", "avg(rho_last)"), ("'SD'", "stddev_samp(rho_last)")))}
""")
def seed_by_cell(spark, sf):
    return reports.seed_by_cell(domain.finals(spark, sf, True, "year"), "rho_last", domain.CELLS)


@query("seed_coverage", f"""
WITH {finals_sql(by_cell=True)}, n AS (SELECT cell, config, count(DISTINCT seed) AS seeds FROM finals GROUP BY ALL)
SELECT cell, config, seeds, (SELECT max(seeds) FROM n) AS most FROM n WHERE seeds < (SELECT max(seeds) FROM n)
""")
def seed_coverage(spark, sf):
    return reports.seed_coverage(domain.finals(spark, sf, True), ("cell", "config"))


@query("merged_runs", f"""
WITH {finals_sql()}, a AS (SELECT config, seed, accuracy FROM finals WHERE seed < 23985), b AS (SELECT config, seed, accuracy + 1 AS accuracy FROM finals WHERE seed >= 23975)
SELECT config, seed, {r('coalesce(b.accuracy, a.accuracy)')} AS accuracy FROM a FULL JOIN b USING (config, seed)
""")
def merged_runs(spark, sf):
    """Later runs win where both tables have the pair."""
    f = domain.finals(spark, sf).select("config", "seed", "accuracy")
    return reports.merge_runs(f.filter("seed < 23985"), f.filter("seed >= 23975").withColumn("accuracy", F.col("accuracy") + 1))


@query("borrowed_baseline", f"""
WITH {finals_sql()}, a AS (SELECT config, seed, accuracy FROM finals WHERE seed < 23985)
SELECT config, seed, {r('accuracy')} AS accuracy FROM a UNION ALL SELECT config, seed, {r('accuracy')} FROM finals WHERE config = 'full' AND seed >= 23985
""")
def borrowed_baseline(spark, sf):
    f = domain.finals(spark, sf).select("config", "seed", "accuracy")
    return reports.borrow_baseline(f.filter("seed < 23985"), f, "full")


@query("missing_runs", f"""
WITH {finals_sql(by_cell=True)}, c(config) AS (VALUES ('full'), ('w/o_spectral'), ('w/o_temporal'), ('w/o_fusion'), ('w/o_gating'), ('full_r1'), ('full_r2_gumbel')),
s AS (SELECT DISTINCT seed FROM finals), done AS (SELECT config, seed FROM finals WHERE cell = 'A' AND accuracy > 0.45)
SELECT config, seed FROM c, s WHERE (config, seed) NOT IN (SELECT config, seed FROM done)
""")
def missing_runs(spark, sf):
    """Runs of the replication grid that are not finished in a cell."""
    f = domain.finals(spark, sf, True)
    return reports.missing_runs(grids.config_grid(spark, "replication"), f, f.filter("cell = 'A' AND accuracy > 0.45"))


@query("known_configs", f"""
WITH {finals_sql()} SELECT config, count(*) AS runs FROM finals WHERE config IN ('full', 'w/o_spectral', 'w/o_temporal') GROUP BY config
""")
def known_configs(spark, sf):
    """Only runs of the configurations asked for; unknown names are an error."""
    wanted = grids.config_grid(spark, only=["full", "w/o_spectral", "w/o_temporal"])
    return domain.finals(spark, sf).join(wanted, "config", "left_semi").groupBy("config").agg(F.count(F.lit(1)).alias("runs"))


@query("config_grid_results", f"""
WITH {finals_sql()}, {_RESULTS}, g(position, config, use_spectral, fusion) AS (VALUES (0, 'full', true, 'adaptive'), (1, 'w/o_spectral', false, 'adaptive'), (2, 'w/o_temporal', true, 'adaptive'),
  (3, 'w/o_fusion', true, 'none'), (4, 'w/o_gating', true, 'adaptive'), (5, 'full_r1', true, 'adaptive'), (6, 'full_r2_gumbel', true, 'adaptive'), (7, 'tsnet_vanilla', false, 'none'))
SELECT position, config, use_spectral, fusion, n, {r('am')} AS accuracy_mean FROM g LEFT JOIN res USING (config)
""")
def config_grid_results(spark, sf):
    """The replication grid as a table, with the results it has."""
    res = reports.results_table(domain.finals(spark, sf)).select("config", "n", "accuracy_mean")
    g = grids.config_grid(spark, "replication", periodic=True).select("position", "config", "use_spectral", "fusion")
    return g.join(res, "config", "left")


@query("union_of_columns", f"""
WITH {finals_sql(seed='year')}, {epochs_sql()}
SELECT config, seed, {r('accuracy', 10)} AS accuracy, NULL::BIGINT AS epoch, NULL::DOUBLE AS val_acc FROM finals
UNION ALL SELECT config, seed, NULL, epoch, {r('val_acc', 10)} FROM epochs
""", digits=10)
def union_of_columns(spark, sf):
    """Tables with different columns under the union of all columns, keys first."""
    return tables.union_columns([domain.finals(spark, sf, seed="year").select("config", "seed", "accuracy"), domain.epochs(spark, sf).select("config", "seed", "epoch", "val_acc")])


@query("tagged_cells", f"""
WITH {finals_sql(by_cell=True)} SELECT cell, config, count(*) AS n, {r('avg(accuracy)')} AS accuracy_mean FROM finals GROUP BY ALL
""")
def tagged_cells(spark, sf):
    """The same table of every cell, collected under a cell column."""
    f = domain.finals(spark, sf, True)
    parts = {c: f.filter(F.col("cell") == c).drop("cell").groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.avg("accuracy").alias("accuracy_mean")) for c in domain.CELLS}
    return tables.tag_cells(parts)


@query("sorted_results", f"WITH {finals_sql(by_cell=True)} SELECT cell, config, seed, {r('accuracy')} AS accuracy FROM finals ORDER BY cell, config, seed")
def sorted_results(spark, sf):
    return domain.finals(spark, sf, True).select("cell", "config", "seed", "accuracy").orderBy("cell", "config", "seed")


@query("written_cells", f"""
WITH {finals_sql(by_cell=True)} SELECT cell, config, count(*) AS n, {r('avg(accuracy)')} AS accuracy_mean, {r('coalesce(stddev_samp(accuracy), 0)')} AS accuracy_std
FROM finals WHERE cell IN ('A', 'O') GROUP BY ALL
""")
def written_cells(spark, sf):
    """Result tables written once with a folder per cell; a reader opens only the cells it asks for."""
    path = scratch(spark, "cells")
    res = reports.results_table(domain.finals(spark, sf, True), ("cell", "config"))
    tables.write_cells(res.select("cell", "config", "n", "accuracy_mean", "accuracy_std"), path)
    return spark.read.parquet(path).filter(F.col("cell").isin("A", "O")).select("cell", "config", "n", "accuracy_mean", "accuracy_std")


@query("csv_report", f"""
WITH {epochs_sql()} SELECT config, seed, epoch, {r('rho', 10)} AS rho FROM epochs
""", digits=10)
def csv_report(spark, sf):
    """A training curve exported as CSV and read back with its fixed schema."""
    path = scratch(spark, "curve")
    tables.write_report(ep.curve(domain.epochs(spark, sf)), path, csv=True)
    return tables.read_table(spark, path, tables.RHO_CURVE)
