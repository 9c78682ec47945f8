"""Queries on window tables: spectra, sensor faults, routing diagnostics, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.catalog.base import ALPHA, ELEMENTS, query, r, u
from gaugeflow.functions.scalars import binary_entropy, sigmoid
from gaugeflow.operators import degrade, evaluation, routing, spectral
from gaugeflow.plans import audit, domain

ROW = ["window_id"]
RUN_SEED = 42


def _points(df, *cols):
    return df.select("window_id", "channel", *cols, F.posexplode("series").alias("t", "value"))


def _seed(name, run=RUN_SEED):
    return degrade.degradation_seed(run, name)


def _h(*parts):
    return f"md5(concat_ws('|', {', '.join(parts)}))"


STATS = """st AS (SELECT channel, avg(v * v) AS power, stddev_pop(v) AS std, count(DISTINCT window_id) AS n FROM el GROUP BY channel)"""


def _noise_sql(name, db):
    h = _h("window_id", "channel", "t", str(_seed(name)))
    return f"""
WITH {ELEMENTS}, {STATS}, d AS (SELECT *, {h} AS h FROM el JOIN st USING (channel))
SELECT window_id, channel, t, {r(f"v + sqrt(-2 * ln(1 - {u('h', 1)})) * cos(6.283185307179586::DOUBLE * {u('h', 9)}) * sqrt(power / pow(10.0::DOUBLE, {db} / 10.0::DOUBLE))")} AS value FROM d"""


def _fault(name):
    def run(spark, sf):
        return _points(degrade.degrade(domain.windows(spark, sf), name, ROW, RUN_SEED, domain.CHANNEL_NAMES))

    run.__doc__ = f"Windows with the fault {name}."
    return run


query("fault_gaussian_noise_snr20", _noise_sql("gaussian_noise_snr20", 20))(_fault("gaussian_noise_snr20"))
query("fault_gaussian_noise_snr10", _noise_sql("gaussian_noise_snr10", 10))(_fault("gaussian_noise_snr10"))
query("fault_drift", f"""
WITH {ELEMENTS}, {STATS}, s AS (SELECT *, CASE WHEN {u(_h('channel', str(_seed('drift'))))} < 0.5 THEN -1 ELSE 1 END AS sg FROM st)
SELECT window_id, channel, t, {r('v + t / 15.0::DOUBLE * 0.5 * std * sg')} AS value FROM el JOIN s USING (channel)
""")(_fault("drift"))
_PICK = ELEMENTS + ", " + STATS + """,
pk AS (SELECT window_id, channel, row_number() OVER (PARTITION BY window_id ORDER BY {h}, channel) AS rk FROM (SELECT DISTINCT window_id, channel FROM el))"""
query("fault_bias", f"""
WITH {_PICK.format(h=_h('window_id', 'channel', str(_seed('bias'))))}
SELECT window_id, channel, t, {r('v + CASE WHEN rk <= 1 THEN 0.5 * std ELSE 0 END')} AS value FROM el JOIN st USING (channel) JOIN pk USING (window_id, channel)
""")(_fault("bias"))
query("fault_stuck", f"""
WITH {_PICK.format(h=_h('window_id', 'channel', str(_seed('stuck'))))}
SELECT el.window_id, el.channel, el.t, {r('CASE WHEN rk <= 1 THEN f.v ELSE el.v END')} AS value
FROM el JOIN pk USING (window_id, channel) JOIN (SELECT * FROM el WHERE t = 0) f ON f.window_id = el.window_id AND f.channel = el.channel
""")(_fault("stuck"))
query("fault_dropout", f"""
WITH {ELEMENTS}, {STATS}, ps AS (SELECT DISTINCT window_id, t FROM el),
lost AS (SELECT window_id, t, row_number() OVER (PARTITION BY window_id ORDER BY {_h('window_id', 't', str(_seed('dropout')))}, t) <= 2 AS gone FROM ps)
SELECT window_id, channel, t, {r('CASE WHEN gone THEN 0 ELSE v END')} AS value FROM el JOIN lost USING (window_id, t)
""")(_fault("dropout"))
query("fault_downsample", f"""
WITH {ELEMENTS}, a AS (SELECT window_id, channel, list(v ORDER BY t) AS s FROM el GROUP BY ALL)
SELECT window_id, channel, t, {r('CASE WHEN t % 2 = 0 THEN s[t + 1] WHEN t + 2 <= 15 THEN (s[t] + s[t + 2]) / 2 ELSE s[t] END')} AS value
FROM a, range(0, 16) AS g(t)
""")(_fault("downsample"))


@query("channel_power_and_spread", f"WITH {ELEMENTS}, {STATS} SELECT channel, {r('power')} AS power, {r('std')} AS std FROM st")
def channel_power_and_spread(spark, sf):
    return degrade.channel_moments(domain.windows(spark, sf))


@query("random_channel_subset", f"""
WITH p AS (SELECT vec_id AS window_id, 'c' || c AS channel FROM embeddings, range(0, 4) AS g(c))
SELECT window_id, channel, row_number() OVER (PARTITION BY window_id ORDER BY {_h('window_id', 'channel', '5')}, channel) <= 2 AS picked FROM p
""")
def random_channel_subset(spark, sf):
    w = domain.windows(spark, sf).select("window_id", "channel")
    return degrade.random_subset(w, ROW, "channel", domain.CHANNEL_NAMES, degrade.subset_size(4, 0.6), 5)


def _faults_sql(run):
    return f"""{ELEMENTS}, {STATS},
base AS (SELECT window_id, class, channel, t, v, power, std FROM el JOIN st USING (channel)),
pkb AS (SELECT window_id, channel, row_number() OVER (PARTITION BY window_id ORDER BY {_h('window_id', 'channel', str(_seed('bias', run)))}, channel) AS rb,
  row_number() OVER (PARTITION BY window_id ORDER BY {_h('window_id', 'channel', str(_seed('stuck', run)))}, channel) AS rs FROM (SELECT DISTINCT window_id, channel FROM el)),
lost AS (SELECT window_id, t, row_number() OVER (PARTITION BY window_id ORDER BY {_h('window_id', 't', str(_seed('dropout', run)))}, t) <= 2 AS gone FROM (SELECT DISTINCT window_id, t FROM el)),
full_ AS (SELECT b.*, rb, rs, gone, first_value(v) OVER w AS v0, lag(v) OVER w AS vp, lead(v) OVER w AS vn,
    {_h('b.window_id', 'b.channel', 'b.t', str(_seed('gaussian_noise_snr20', run)))} AS h20, {_h('b.window_id', 'b.channel', 'b.t', str(_seed('gaussian_noise_snr10', run)))} AS h10,
    CASE WHEN {u(_h('b.channel', str(_seed('drift', run))))} < 0.5 THEN -1 ELSE 1 END AS sg
  FROM base b JOIN pkb USING (window_id, channel) JOIN lost USING (window_id, t) WINDOW w AS (PARTITION BY b.window_id, b.channel ORDER BY b.t)),
faults AS (
  SELECT 'clean' AS degradation, window_id, class, channel, t, v AS x FROM full_
  UNION ALL SELECT 'gaussian_noise_snr20', window_id, class, channel, t, v + sqrt(-2 * ln(1 - {u('h20', 1)})) * cos(6.283185307179586::DOUBLE * {u('h20', 9)}) * sqrt(power / 100) FROM full_
  UNION ALL SELECT 'gaussian_noise_snr10', window_id, class, channel, t, v + sqrt(-2 * ln(1 - {u('h10', 1)})) * cos(6.283185307179586::DOUBLE * {u('h10', 9)}) * sqrt(power / 10) FROM full_
  UNION ALL SELECT 'drift', window_id, class, channel, t, v + t / 15.0::DOUBLE * 0.5 * std * sg FROM full_
  UNION ALL SELECT 'bias', window_id, class, channel, t, v + CASE WHEN rb <= 1 THEN 0.5 * std ELSE 0 END FROM full_
  UNION ALL SELECT 'stuck', window_id, class, channel, t, CASE WHEN rs <= 1 THEN v0 ELSE v END FROM full_
  UNION ALL SELECT 'dropout', window_id, class, channel, t, CASE WHEN gone THEN 0 ELSE v END FROM full_
  UNION ALL SELECT 'downsample', window_id, class, channel, t, CASE WHEN t % 2 = 0 THEN v WHEN t = 15 THEN vp ELSE (vp + vn) / 2 END FROM full_)"""


_ALL_FAULTS = _faults_sql(RUN_SEED)


@query("all_faults", f"""
WITH {_ALL_FAULTS} SELECT degradation, class, channel, count(*) AS samples, {r('avg(x)')} AS mean, {r('stddev_pop(x)')} AS std FROM faults GROUP BY ALL
""")
def all_faults(spark, sf):
    """All seven faults by name, with the clean windows, in one table."""
    d = degrade.all_degradations(domain.windows(spark, sf), ROW, RUN_SEED, channels=domain.CHANNEL_NAMES)
    e = d.select("degradation", "class", "channel", F.explode("series").alias("x"))
    return e.groupBy("degradation", "class", "channel").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


_CENTRES = """cen AS (SELECT class, channel, t, avg(v) AS c FROM el GROUP BY ALL)"""


@query("fault_accuracy", f"""
WITH {_ALL_FAULTS}, {_CENTRES},
d AS (SELECT f.degradation, f.window_id, f.class AS truth, c.class AS guess, sum((f.x - c.c) ** 2) AS dist
      FROM faults f JOIN cen c USING (channel, t) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY degradation, window_id ORDER BY dist, guess) AS rk FROM d)
SELECT degradation, count(*) AS n, {r('avg(CASE WHEN truth = guess THEN 1.0::DOUBLE ELSE 0 END)')} AS accuracy FROM best WHERE rk = 1 GROUP BY degradation
""")
def fault_accuracy(spark, sf):
    """A nearest-centroid scorer fitted on clean windows, on clean and degraded ones, in one pass."""
    w = domain.windows(spark, sf)
    d = degrade.all_degradations(w, ROW, RUN_SEED, channels=domain.CHANNEL_NAMES)
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("channel", "series"))), lambda s: s["series"]))
    vec = d.groupBy("degradation", "window_id", "class").agg(whole.alias("vector"))
    clean = w.groupBy("window_id", "class").agg(whole.alias("vector"))
    preds = evaluation.nearest_class(vec.withColumnRenamed("class", "y_true"), evaluation.centroids(clean, "class", "vector"),
                                     ["degradation", "window_id", "y_true"], "class", "vector")
    return evaluation.accuracy_macro_f1(preds, ["degradation"]).select("degradation", "n", "accuracy")


_SPECTRUM = ELEMENTS + """,
sp AS (SELECT window_id, class, channel, k AS bin,
  sqrt(sum(v * cos(2 * pi() * k * t / 16)) ** 2 + sum(v * sin(2 * pi() * k * t / 16)) ** 2) AS amp FROM el, range(1, 9) AS g(k) GROUP BY ALL)"""


@query("magnitude_spectra", f"WITH {_SPECTRUM} SELECT window_id, channel, bin, {r('amp')} AS amp FROM sp")
def magnitude_spectra(spark, sf):
    d = domain.windows(spark, sf).select("window_id", "channel", F.posexplode(spectral.magnitude_spectrum("series")).alias("p", "amp"))
    return d.select("window_id", "channel", (F.col("p") + 1).alias("bin"), "amp")


@query("dominant_periods", f"""
WITH {_SPECTRUM}, m AS (SELECT class, bin, avg(amp) AS amplitude FROM sp GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY amplitude DESC, bin) AS rank FROM m),
top AS (SELECT *, exp(amplitude - max(amplitude) OVER (PARTITION BY class)) AS e FROM rk WHERE rank <= 3)
SELECT class, rank, bin, {r('amplitude')} AS amplitude, greatest(2, ceil(16.0 / bin))::BIGINT AS period, {r('e / sum(e) OVER (PARTITION BY class)')} AS weight FROM top
""")
def dominant_periods(spark, sf):
    return spectral.dominant_periods(domain.windows(spark, sf), domain.SERIES_LENGTH, 3, ["class"])


@query("folded_windows", f"""
WITH {ELEMENTS}, a AS (SELECT window_id, channel, list(v ORDER BY t) AS s FROM el GROUP BY ALL)
SELECT window_id, channel, cycle, phase, {r('coalesce(s[cycle * 5 + phase + 1], 0)')} AS value FROM a, range(0, 4) AS g(cycle), range(0, 5) AS h(phase)
""")
def folded_windows(spark, sf):
    d = spectral.fold_by_period(domain.windows(spark, sf), F.lit(5))
    return d.select("window_id", "channel", "cycle", F.posexplode("phases").alias("phase", "value"))


@query("pooled_series", f"""
WITH a AS (SELECT vec_id AS window_id, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings)
SELECT window_id, i AS part, {r('list_avg(s[(i * 64) // 24 + 1 : ((i + 1) * 64 + 23) // 24])')} AS value FROM a, range(0, 24) AS g(i)
""")
def pooled_series(spark, sf):
    """Whole vectors brought to 24 values by overlapping averages."""
    d = domain.vectors(spark, sf)
    return d.select("window_id", F.posexplode(spectral.adaptive_pool("vector", 24)).alias("part", "value"))


_REFLECTED = """sig AS (SELECT vec_id AS window_id, i - 1 AS t, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS g(i)),
fr AS (SELECT f, k, f * 16 + k - 32 AS raw FROM range(0, 5) AS a(f), range(0, 64) AS b(k)),
ix AS (SELECT f, k, CASE WHEN raw < 0 THEN -raw WHEN raw > 63 THEN 126 - raw ELSE raw END AS t FROM fr),
tap AS (SELECT window_id, f, k, v * (0.5 - 0.5 * cos(2 * pi() * k / 64)) AS x FROM ix JOIN sig USING (t)),
ft AS (SELECT window_id, f, b, ln(sum(x * cos(2 * pi() * b * k / 64)) ** 2 + sum(x * sin(2 * pi() * b * k / 64)) ** 2 + 1e-8) AS lp
  FROM tap, range(0, 33) AS g(b) GROUP BY ALL),
bands AS (SELECT q, (q * 33) // 8 AS lo, ((q + 1) * 33 + 7) // 8 AS hi FROM range(0, 8) AS g(q))"""


@query("band_log_powers", f"""
WITH {_REFLECTED} SELECT window_id, q * 5 + f AS part, {r('avg(lp)')} AS value FROM bands JOIN ft ON b >= lo AND b < hi GROUP BY window_id, q, f
""")
def band_log_powers(spark, sf):
    """Log power of five frames in eight bands, over whole vectors."""
    d = domain.vectors(spark, sf)
    return d.select("window_id", F.posexplode(spectral.band_log_power("vector")).alias("part", "value"))


_ENT = "-(a * ln(a) + (1 - a) * ln(1 - a)) / ln(2)"


@query("routing_entropy", f"WITH {ALPHA} SELECT class, {r(f'avg({_ENT})')} AS entropy FROM al GROUP BY class")
def routing_entropy(spark, sf):
    return routing.routing_entropy(domain.alphas(spark, sf), ["class"])


@query("element_entropy", f"""
WITH {ALPHA}, s AS (SELECT window_id, channel, t, CASE WHEN a > 0.7 THEN 1.0::DOUBLE WHEN a < 0.3 THEN 0 ELSE a END AS a FROM al),
c AS (SELECT *, least(greatest(a, 1e-12), 1 - 1e-12) AS x FROM s)
SELECT window_id, channel, t, {r('-(x * ln(x) + (1 - x) * ln(1 - x)) / ln(2)')} AS entropy FROM c
""")
def element_entropy(spark, sf):
    """Entropy of each element, also where a weight is exactly 0 or 1."""
    d = domain.alphas(spark, sf).select("window_id", "channel", F.posexplode("series").alias("t", "a"))
    a = F.when(F.col("a") > 0.7, 1.0).when(F.col("a") < 0.3, 0.0).otherwise(F.col("a"))
    return d.select("window_id", "channel", "t", binary_entropy(a).alias("entropy"))


@query("temporal_variance", f"""
WITH {ALPHA}, v AS (SELECT window_id, class, channel, var_pop(a) AS x FROM al GROUP BY ALL)
SELECT class, {r('avg(x)', 9)} AS temporal_variance FROM v GROUP BY class
""", digits=9)
def temporal_variance(spark, sf):
    return routing.temporal_variance(domain.alphas(spark, sf), ["class"])


_MEANS = ALPHA + """, wm AS (SELECT window_id, class, avg(a) AS alpha FROM al GROUP BY ALL)"""


def _means(spark, sf):
    return routing.window_means(domain.alphas(spark, sf), "window_id")


@query("class_routing_means", f"WITH {_MEANS} SELECT class, {r('avg(alpha)')} AS alpha_mean, count(*) AS windows FROM wm GROUP BY class")
def class_routing_means(spark, sf):
    return routing.class_means(_means(spark, sf))


@query("global_and_class_means", f"""
WITH {_MEANS} SELECT CASE WHEN grouping(class) = 1 THEN 'global' ELSE 'class' END AS scope, class, {r('avg(alpha)')} AS alpha_mean, count(*) AS windows
FROM wm GROUP BY ROLLUP (class)
""")
def global_and_class_means(spark, sf):
    return routing.global_and_class_means(_means(spark, sf))


@query("class_routing_profile", f"""
WITH {_MEANS}, p AS (SELECT class, avg(alpha) AS m, coalesce(stddev_samp(alpha), 0) AS s, count(*) AS windows FROM wm GROUP BY class)
SELECT class, {r('m')} AS alpha_mean, {r('s')} AS alpha_std, windows, {r('min(m) OVER ()')} AS band_min, {r('max(m) OVER ()')} AS band_max,
  {r('max(m) OVER () - min(m) OVER ()')} AS band_spread FROM p
""")
def class_routing_profile(spark, sf):
    return routing.class_profile(_means(spark, sf))


@query("gate_saturation", f"""
WITH {ALPHA} SELECT tau, class, {r('avg(CASE WHEN a > tau THEN 1.0::DOUBLE ELSE 0 END)', 10)} AS saturation
FROM al, (SELECT unnest([0.6::DOUBLE, 0.9::DOUBLE]) AS tau) GROUP BY ALL
""", digits=10)
def gate_saturation(spark, sf):
    a = domain.alphas(spark, sf)
    parts = [routing.gate_saturation(a, ["class"], tau).withColumn("tau", F.lit(tau)) for tau in (0.6, 0.9)]
    return parts[0].unionByName(parts[1])


@query("routing_histogram", f"WITH {ALPHA} SELECT least(59, floor(a * 60))::BIGINT AS bin, count(*) AS elements FROM al GROUP BY 1")
def routing_histogram(spark, sf):
    return routing.histogram(domain.alphas(spark, sf))


@query("routing_quantiles", f"""
WITH {ALPHA} SELECT 0.05::DOUBLE AS prob, {r('quantile_cont(a, 0.05)')} AS quantile FROM al
UNION ALL SELECT 0.5, {r('quantile_cont(a, 0.5)')} FROM al UNION ALL SELECT 0.95, {r('quantile_cont(a, 0.95)')} FROM al
""")
def routing_quantiles(spark, sf):
    a = domain.alphas(spark, sf).select(F.explode("series").alias("a"))
    return routing.exact_quantiles(a, "a", [0.05, 0.5, 0.95], 0.0, 1.0)


@query("permutation_null", f"""
WITH {ELEMENTS}, sm AS (
  SELECT window_id, channel, t, (v + lead(v, 1) OVER w + lead(v, 2) OVER w) / 3 AS x FROM el WINDOW w AS (PARTITION BY window_id, channel ORDER BY t)),
ob AS (SELECT avg(vv) AS observed FROM (SELECT var_pop(x) AS vv FROM sm WHERE x IS NOT NULL GROUP BY window_id, channel)),
pm AS (SELECT rep, window_id, channel, v, row_number() OVER (PARTITION BY rep, window_id, channel ORDER BY {_h('window_id', 'rep', 't', '11')}, t) AS t
  FROM el, range(1, 9) AS g(rep)),
ps AS (SELECT rep, window_id, channel, (v + lead(v, 1) OVER w + lead(v, 2) OVER w) / 3 AS x FROM pm WINDOW w AS (PARTITION BY rep, window_id, channel ORDER BY t)),
nul AS (SELECT rep, avg(vv) AS stat FROM (SELECT rep, var_pop(x) AS vv FROM ps WHERE x IS NOT NULL GROUP BY rep, window_id, channel) GROUP BY rep),
f AS (SELECT avg(stat) AS m, stddev_samp(stat) AS s FROM nul)
SELECT {r('observed', 9)} AS observed, {r('m', 9)} AS null_mean, {r('s', 9)} AS null_std, {r('(observed - m) / (s + 1e-12)', 5)} AS z FROM ob, f
""", digits=9)
def permutation_null(spark, sf):
    """Is the smoothed variance over time more than shuffled time would give?"""
    d = routing.permutation_null(domain.windows(spark, sf), ROW, 8, 11)
    return d.withColumn("z", F.round("z", 5))


@query("load_balance", f"""
WITH {ALPHA}, p AS (SELECT class, avg(a) AS p, avg(CASE WHEN a >= 1 - a THEN 1.0::DOUBLE ELSE 0 END) AS u FROM al GROUP BY class)
SELECT class, {r('2 * (p * u + (1 - p) * (1 - u))')} AS balance FROM p
""")
def load_balance(spark, sf):
    return routing.load_balance(domain.alphas(spark, sf), ["class"])


_SCORES = """sc AS (SELECT vec_id AS window_id, 'k' || (i - 1) AS class, 4 * embedding[i]::DOUBLE AS score
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def _scores(spark, sf):
    d = domain.vectors(spark, sf).select("window_id", F.posexplode("vector").alias("k", "x"))
    return d.select("window_id", F.concat(F.lit("k"), "k").alias("class"), (4.0 * F.col("x")).alias("score"))


@query("softmax_scores", f"""
WITH {_SCORES}, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY window_id)) AS e FROM sc)
SELECT window_id, class, {r('e / sum(e) OVER (PARTITION BY window_id)')} AS p FROM e
""")
def softmax_scores(spark, sf):
    return routing.softmax_over(_scores(spark, sf), ROW, "score").drop("score")


@query("sparsemax_scores", f"""
WITH {_SCORES}, k AS (SELECT *, row_number() OVER w AS k, sum(score) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM sc WINDOW w AS (PARTITION BY window_id ORDER BY score DESC, class)),
t AS (SELECT window_id, arg_max((c - 1) / k, k) AS tau FROM k WHERE 1 + k * score > c GROUP BY window_id)
SELECT window_id, class, {r('greatest(score - tau, 0)')} AS p FROM sc JOIN t USING (window_id)
""")
def sparsemax_scores(spark, sf):
    return routing.sparsemax_over(_scores(spark, sf), ROW, "score", ["class"]).drop("score")


@query("entmax_scores", f"""
WITH RECURSIVE {_SCORES}, x AS (SELECT window_id, list(score / 2 ORDER BY class) AS xs FROM sc GROUP BY window_id),
bis AS (
  SELECT window_id, xs, list_min(xs) - 1 AS lo, list_max(xs) AS hi, 0 AS it FROM x
  UNION ALL
  SELECT window_id, xs, CASE WHEN s > 1 THEN mid ELSE lo END, CASE WHEN s > 1 THEN hi ELSE mid END, it + 1 FROM (
    SELECT window_id, xs, lo, hi, it, (lo + hi) / 2 AS mid, list_sum(list_transform(xs, lambda v: greatest(v - (lo + hi) / 2, 0) ** 2)) AS s FROM bis WHERE it < 50)),
tau AS (SELECT window_id, (lo + hi) / 2 AS tau FROM bis WHERE it = 50)
SELECT window_id, class, {r('greatest(score / 2 - tau, 0) ** 2')} AS p FROM sc JOIN tau USING (window_id)
""")
def entmax_scores(spark, sf):
    """Closed form here, fifty steps of bisection in the SQL."""
    return routing.entmax15_over(_scores(spark, sf), ROW, "score", ["class"]).drop("score")


@query("sigmoid_scores", f"WITH {_SCORES} SELECT window_id, class, {r('1 / (1 + exp(-score))')} AS p FROM sc")
def sigmoid_scores(spark, sf):
    return _scores(spark, sf).select("window_id", "class", sigmoid("score").alias("p"))


@query("norm_ratio", f"""
WITH {ELEMENTS} SELECT class, {r("sqrt(sum(v * v) FILTER (channel = 'c0'))")} AS norm_a, {r("sqrt(sum(v * v) FILTER (channel = 'c3'))")} AS norm_b,
  {r("sqrt(sum(v * v) FILTER (channel = 'c0')) / (sqrt(sum(v * v) FILTER (channel = 'c3')) + 1e-12)")} AS ratio FROM el GROUP BY class
""")
def norm_ratio(spark, sf):
    d = domain.windows(spark, sf).select("class", "channel", F.explode("series").alias("v"))
    return routing.norm_ratio(d, "channel", "v", "c0", "c3", ["class"])


_BRANCHES = """cen AS (SELECT class, channel, t, avg(v) AS c FROM el GROUP BY ALL),
br AS (SELECT e.window_id, e.class AS truth, c.class AS class,
    -sqrt(sum((v - c) ** 2) FILTER (channel IN ('c0', 'c1'))) AS s_t, -sqrt(sum((v - c) ** 2) FILTER (channel IN ('c2', 'c3'))) AS s_f
  FROM el e JOIN cen c USING (channel, t) GROUP BY ALL)"""


def _branches(spark, sf):
    """Scores of two half-vector centroid models, joined per window and class."""
    d = domain.vectors(spark, sf).withColumn("truth", F.concat(F.lit("L"), "label"))
    halves = []
    for lo in (1, 33):
        half = d.select("window_id", "truth", F.slice("vector", lo, 32).alias("v"))
        halves.append(evaluation.centroid_scores(half, evaluation.centroids(half, "truth", "v"), ["window_id", "truth"], "truth", "v"))
    return routing.join_branches(halves[0], halves[1], ["window_id", "truth", "class"])


_PICKED = """rk AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY score DESC, class) AS rk FROM fz)
SELECT window_id, truth, class AS y_pred FROM rk WHERE rk = 1"""


def _pick(scores):
    return routing.argmax_class(scores, ["window_id", "truth"])


@query("fused_mean", f"WITH {ELEMENTS}, {_BRANCHES}, fz AS (SELECT *, 0.5 * s_t + 0.5 * s_f AS score FROM br), {_PICKED}")
def fused_mean(spark, sf):
    return _pick(routing.fuse(_branches(spark, sf), F.lit(0.5)))


@query("fused_global_weight", f"""
WITH {ALPHA}, {_BRANCHES}, g AS (SELECT avg(a) AS w FROM al),
fz AS (SELECT br.*, w * s_t + (1 - w) * s_f AS score FROM br, g), {_PICKED}
""")
def fused_global_weight(spark, sf):
    """One weight for all windows: the mean routing weight."""
    a = domain.alphas(spark, sf)
    g = a.agg((F.sum(F.aggregate("series", F.lit(0.0), lambda x, y: x + y)) / F.sum(F.size("series"))).alias("w"))
    return _pick(routing.fuse(_branches(spark, sf).withColumn("w", g.scalar()), F.col("w")))


@query("fused_class_weight", f"""
WITH {_MEANS}, {_BRANCHES}, g AS (SELECT class AS truth, avg(alpha) AS w FROM wm GROUP BY class),
fz AS (SELECT br.*, w * s_t + (1 - w) * s_f AS score FROM br JOIN g USING (truth)), {_PICKED}
""")
def fused_class_weight(spark, sf):
    """The mean routing weight of the true class (an oracle bound)."""
    g = routing.class_means(_means(spark, sf)).select(F.col("class").alias("truth"), F.col("alpha_mean").alias("alpha"))
    return _pick(routing.fuse(routing.class_weights(_branches(spark, sf), g, "truth"), F.col("alpha")))


@query("fused_row_weight", f"""
WITH {_MEANS}, {_BRANCHES}, fz AS (SELECT br.*, alpha * s_t + (1 - alpha) * s_f AS score FROM br JOIN (SELECT window_id, alpha FROM wm) USING (window_id)), {_PICKED}
""")
def fused_row_weight(spark, sf):
    """Each window's own mean routing weight."""
    w = _means(spark, sf).select("window_id", "alpha")
    return _pick(routing.fuse(_branches(spark, sf).join(w, "window_id"), F.col("alpha")))


@query("fixed_class_weights", f"""
WITH {_MEANS} SELECT window_id, wm.class, {r('g.m')} AS alpha FROM wm JOIN (SELECT class, avg(alpha) AS m FROM wm GROUP BY class) g USING (class)
""")
def fixed_class_weights(spark, sf):
    """Class weights folded into the windows; a class without a weight would fail."""
    m = _means(spark, sf)
    g = routing.class_means(m).select("class", F.col("alpha_mean").alias("alpha"))
    return routing.class_weights(m.select("window_id", "class"), g)


@query("two_expert_routing", f"""
WITH {ELEMENTS}, {_BRANCHES}, x AS (SELECT window_id, class, s_t, s_f, s_t - s_f AS lg FROM br)
SELECT window_id, class, {r('1 / (1 + exp(-lg / 0.5))')} AS soft, {r('1 / (1 + exp(-2 * lg / 0.5))')} AS paired, {r('CASE WHEN 1 / (1 + exp(-2 * lg / 0.5)) >= 0.5 THEN s_t ELSE s_f END')} AS hard FROM x
""")
def two_expert_routing(spark, sf):
    """Soft and hard choice between the branches with a temperature."""
    d = _branches(spark, sf).withColumn("lg", F.col("s_t") - F.col("s_f"))
    paired = routing.two_expert_weight("lg", 0.5, paired=True)
    return d.select("window_id", "class", routing.two_expert_weight("lg", 0.5).alias("soft"), paired.alias("paired"),
                    routing.route_hard(paired, F.col("s_t"), F.col("s_f")).alias("hard"))


def _audit_sql(seed):
    return f"""
SELECT config, seed, accuracy, macro_f1, degradation, degraded_accuracy FROM (
WITH {_faults_sql(seed)},
whole AS (SELECT *, lead(x) OVER (PARTITION BY degradation, window_id, channel ORDER BY t) AS nx, {u(f"md5(concat_ws('|', window_id // 8, '{seed}'))")} < 0.3 AS test FROM faults),
used AS (SELECT * FROM whole WHERE test OR degradation = 'clean'),
tf AS (SELECT degradation, test, window_id, class, channel,
    [avg(x), stddev_pop(x), min(x), max(x), sum(x * (t - 7.5)) / 16, avg(x * nx)] AS vs FROM used GROUP BY ALL),
sf AS (SELECT degradation, test, window_id, class, channel, k,
    sqrt(sum(x * cos(2 * pi() * k * t / 16)) ** 2 + sum(x * sin(2 * pi() * k * t / 16)) ** 2) AS v FROM used, range(1, 9) AS g(k) GROUP BY ALL),
feats AS (SELECT degradation, test, window_id, class, channel, 'temporal' AS family, i, vs[i] AS v FROM tf, range(1, 7) AS g(i) UNION ALL SELECT degradation, test, window_id, class, channel, 'spectral', k, v FROM sf),
fit AS (SELECT class AS guess, channel, family, i, avg(v) AS mu, var_pop(v) + 1e-6 AS va FROM feats WHERE NOT test GROUP BY ALL),
prior AS (SELECT class AS guess, ln(count(DISTINCT window_id) / (sum(count(DISTINCT window_id)) OVER ())) AS lp FROM used WHERE NOT test GROUP BY class),
ll AS (SELECT degradation, window_id, class, guess, family, sum(-0.5 * (ln(va) + (v - mu) ** 2 / va)) AS s
  FROM feats JOIN fit USING (channel, family, i) WHERE test GROUP BY ALL),
sc AS (SELECT config, degradation, window_id, class, guess, any_value(lp) + sum(s) AS score FROM ll JOIN prior USING (guess),
  (VALUES ('full', 'temporal'), ('full', 'spectral'), ('w/o_spectral', 'temporal'), ('w/o_temporal', 'spectral')) AS f(config, fam) WHERE fam = family GROUP BY ALL),
pr AS (SELECT config, degradation, class AS yt, guess AS yp FROM sc QUALIFY row_number() OVER (PARTITION BY config, degradation, window_id ORDER BY score DESC, guess) = 1),
sides AS (SELECT config, degradation, yt AS label, 1 AS sup, 0 AS pre, (yt = yp)::INT AS tp FROM pr UNION ALL SELECT config, degradation, yp, 0, 1, 0 FROM pr),
cls AS (SELECT config, degradation, label, sum(sup) AS sup, sum(tp) AS tp, sum(pre) AS pre FROM sides GROUP BY ALL),
fin AS (SELECT config, degradation, sum(tp) / sum(sup) AS acc, avg(2.0::DOUBLE * tp / (sup + pre)) AS f1 FROM cls GROUP BY ALL)
SELECT c.config, {seed}::BIGINT AS seed, {r('c.acc')} AS accuracy, {r('c.f1')} AS macro_f1, d.degradation, {r('d.acc')} AS degraded_accuracy
FROM fin c JOIN fin d ON c.config = d.config AND c.degradation = 'clean' AND d.degradation <> 'clean')"""


@query("ablation_audit", " UNION ALL ".join(_audit_sql(seed) for seed in (1, 2)))
def ablation_audit(spark, sf):
    """Feature-family ablation fitted and scored per seed, clean and under every fault; eight windows in a row are one run."""
    w = domain.windows(spark, sf).withColumn("run", F.floor(F.col("window_id") / 8).cast("long"))
    finals = audit.audit(w, "class", "window_id", seeds=(1, 2), run="run", channels=domain.CHANNEL_NAMES)
    return finals.select("config", "seed", "accuracy", "macro_f1", F.explode("degradation").alias("degradation", "degraded_accuracy"))
