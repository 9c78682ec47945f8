"""Queries on recordings: ingest, cleaning, selection, splitting, normalization, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.catalog.base import GAPPY, MULTIRATE, RUNS, query, r
from gaugeflow.functions.hashing import uniform
from gaugeflow.functions.scalars import config_slug, normalized_name
from gaugeflow.operators import cleaning, selection, splitting, windows as win
from gaugeflow.plans import domain, preparation
from gaugeflow.plans.domain import table
from gaugeflow.session import scratch
from gaugeflow.sources import runfiles

SEED, W, STRIDE = 7, 16, 8


def _lengths(spark, sf):
    ev = table(spark, sf, "events")
    return ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("length")).select(
        F.concat(F.lit("R"), "user_id").alias("run_id"), F.concat(F.lit("C"), F.col("user_id") % 5).alias("class"), "length")


LENGTHS = """lens AS (
  SELECT 'R' || user_id AS run_id, 'C' || (user_id % 5) AS class, count(*) AS length FROM events GROUP BY user_id)"""
# rank and counts of the proportional split
SPLIT = LENGTHS + f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws('|', run_id, {SEED})), run_id) AS rk,
         count(*) OVER (PARTITION BY class) AS n FROM lens),
counted AS (
  SELECT *, CASE WHEN n = 2 THEN 1 WHEN 2 * greatest(1, floor(n * 0.15::DOUBLE + 0.5::DOUBLE)) >= n THEN 1
                 ELSE greatest(1, floor(n * 0.15::DOUBLE + 0.5::DOUBLE)) END AS n_test FROM ranked),
split AS (
  SELECT run_id, class, length, n, CASE WHEN n = 1 THEN NULL WHEN rk <= n_test THEN 'test'
     WHEN n >= 3 AND rk <= 2 * n_test THEN 'val' ELSE 'train' END AS split FROM counted)"""
ZSCORED = RUNS + ", " + SPLIT + """,
chan AS (SELECT run_id, class, pos, 'value' AS channel, value FROM runs UNION ALL SELECT run_id, class, pos, 'level', level FROM runs),
long AS (SELECT r.run_id, r.class, s.split, r.channel, r.pos, r.value FROM chan r JOIN split s USING (run_id)),
stats AS (SELECT channel, avg(value) AS mean, stddev_pop(value) AS std FROM long WHERE split = 'train' GROUP BY channel),
z AS (SELECT run_id, class, split, channel, pos, (value - mean) / CASE WHEN std < 1e-8 THEN 1 ELSE std END AS value FROM long JOIN stats USING (channel))"""


def _split(spark, sf):
    return splitting.split_runs(_lengths(spark, sf), SEED)


def _zscored(spark, sf):
    assigned = _split(spark, sf).select("run_id", "split")
    return win.zscore_by_train(domain.channel_samples(spark, sf).join(assigned, "run_id"))


def _windows(spark, sf):
    return win.sliding_windows(_zscored(spark, sf), W, STRIDE, ["run_id", "class", "split", "channel"])


@query("split_window_summary", f"""
WITH {RUNS}, {SPLIT},
w AS (SELECT run_id, class, split, CASE WHEN length >= {W} THEN (length - {W}) // {STRIDE} + 1 ELSE 0 END AS nw FROM split)
SELECT class, count(CASE WHEN split = 'train' THEN 1 END) AS train_runs, count(CASE WHEN split = 'val' THEN 1 END) AS val_runs,
  count(CASE WHEN split = 'test' THEN 1 END) AS test_runs,
  coalesce(sum(nw) FILTER (split = 'train'), 0)::BIGINT AS train_windows,
  coalesce(sum(nw) FILTER (split = 'val'), 0)::BIGINT AS val_windows,
  coalesce(sum(nw) FILTER (split = 'test'), 0)::BIGINT AS test_windows
FROM w GROUP BY class UNION ALL SELECT 'C9', 0, 0, 0, 0, 0, 0
""")
def split_window_summary(spark, sf):
    """Runs and windows of each class in each split of a stratified split."""
    classes = spark.createDataFrame([(f"C{i}",) for i in (0, 1, 2, 3, 4, 9)], "class string")
    segments = preparation.assign_segments(_lengths(spark, sf), W, STRIDE, SEED)
    return splitting.split_summary(segments, classes, W)


@query("run_split", f"WITH {SPLIT} SELECT run_id, class, length, n, split FROM split")
def run_split(spark, sf):
    return _split(spark, sf).drop("fell_back")


EXACT = {"C0": (20, 5, 5), "C1": (200, 50, 50), "C2": (1, 1, 1), "C3": (10, 4, 4)}


@query("run_split_exact_counts", f"""
WITH {SPLIT}, asked(class, tr, va, te) AS (VALUES ('C0', 20, 5, 5), ('C1', 200, 50, 50), ('C2', 1, 1, 1), ('C3', 10, 4, 4))
SELECT run_id, class, CASE WHEN n = tr + va + te AND n >= 3
    THEN CASE WHEN rk <= te THEN 'test' WHEN rk <= te + va THEN 'val' ELSE 'train' END
    ELSE CASE WHEN n = 1 THEN NULL WHEN rk <= n_test THEN 'test' WHEN n >= 3 AND rk <= 2 * n_test THEN 'val' ELSE 'train' END END AS split,
  coalesce(n >= 3 AND n <> tr + va + te, false) AS fell_back
FROM counted LEFT JOIN asked USING (class)
""")
def run_split_exact_counts(spark, sf):
    return splitting.split_runs(_lengths(spark, sf), SEED, EXACT).select("run_id", "class", "split", "fell_back")


_SEGMENTS = LENGTHS + """,
cut AS (SELECT run_id, length AS l, w, floor(length * 0.7::DOUBLE)::BIGINT AS b1, floor(length * 0.85::DOUBLE)::BIGINT AS b2
        FROM lens, (SELECT unnest([12, 24]) AS w)),
kind AS (SELECT *, CASE WHEN b1 >= w AND b2 - b1 >= w AND l - b2 >= w THEN 'proportional' WHEN l >= 3 * w THEN 'fixed tails'
    WHEN l >= 2 * w THEN 'test tail' ELSE 'test only' END AS way FROM cut),
seg AS (
  SELECT run_id, w, way, 'train' AS split, 0 AS a, CASE way WHEN 'proportional' THEN b1 WHEN 'fixed tails' THEN l - 2 * w ELSE l - w END AS b
    FROM kind WHERE way <> 'test only'
  UNION ALL SELECT run_id, w, way, 'val', CASE way WHEN 'proportional' THEN b1 ELSE l - 2 * w END,
    CASE way WHEN 'proportional' THEN b2 ELSE l - w END FROM kind WHERE way IN ('proportional', 'fixed tails')
  UNION ALL SELECT run_id, w, way, 'test', CASE way WHEN 'proportional' THEN b2 WHEN 'test only' THEN 0 ELSE l - w END, l FROM kind)"""


def _segments(spark, sf):
    runs = _lengths(spark, sf)
    parts = [splitting.split_within_run(runs, w).withColumn("w", F.lit(w)) for w in (12, 24)]
    return parts[0].unionByName(parts[1])


@query("within_run_segments", f"WITH {_SEGMENTS} SELECT run_id, w, way, split, a AS from_pos, b AS to_pos FROM seg")
def within_run_segments(spark, sf):
    """Every run taken as the only one of its class, for two window lengths."""
    return _segments(spark, sf).select("run_id", "w", "way", "split", "from_pos", "to_pos")


@query("within_run_windows", f"""
WITH {RUNS}, {_SEGMENTS},
st AS (SELECT s.run_id, s.split, s.a + g.i * 6 AS lo FROM seg s, range(0, 40) AS g(i) WHERE s.w = 12 AND s.a + g.i * 6 + 12 <= s.b)
SELECT st.run_id, st.split, lo AS start_pos, {r('sum(value)')} AS total, count(*) AS n
FROM st JOIN runs r ON r.run_id = st.run_id AND r.pos >= lo AND r.pos < lo + 12 GROUP BY ALL
""")
def within_run_windows(spark, sf):
    """Windows inside the segments; no window crosses a segment border."""
    seg = _segments(spark, sf).filter("w = 12").select("run_id", "split", "from_pos", "to_pos")
    s = domain.samples(spark, sf).join(seg, "run_id").filter("pos >= from_pos AND pos < to_pos")
    s = s.withColumn("pos", F.col("pos") - F.col("from_pos"))
    w = win.sliding_windows(s, 12, 6, ["run_id", "split", "from_pos"])
    return w.select("run_id", "split", (F.col("from_pos") + F.col("start")).alias("start_pos"),
                    F.aggregate("series", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("series").alias("n"))


@query("train_only_zscore", f"WITH {ZSCORED} SELECT run_id, split, channel, pos, {r('value')} AS value FROM z")
def train_only_zscore(spark, sf):
    return _zscored(spark, sf).select("run_id", "split", "channel", "pos", "value")


@query("channel_statistics", f"""
WITH {RUNS} SELECT event_type AS channel, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std FROM runs GROUP BY ALL
""")
def channel_statistics(spark, sf):
    return win.channel_stats(table(spark, sf, "events").select(F.col("event_type").alias("channel"), "value"))


@query("sliding_windows", f"""
WITH {ZSCORED}, w AS (
  SELECT run_id, class, split, channel, list(value ORDER BY pos) AS s FROM z GROUP BY ALL),
ix AS (SELECT run_id, class, split, channel, s, unnest(range(0, (len(s) - {W}) // {STRIDE} + 1)) AS j FROM w WHERE len(s) >= {W})
SELECT run_id, class, split, channel, j AS win_idx, j * {STRIDE} AS start, t - 1 AS t, {r(f's[j * {STRIDE} + t]')} AS value
FROM ix, range(1, {W + 1}) AS g(t)
""")
def sliding_windows(spark, sf):
    """Every value of every window of the scaled runs."""
    return _windows(spark, sf).select("run_id", "class", "split", "channel", "win_idx", "start", F.posexplode("series").alias("t", "value"))


@query("window_counts", f"""
WITH {LENGTHS} SELECT run_id, length, CASE WHEN length >= 50 THEN (length - 50) // 7 + 1 ELSE 0 END AS windows FROM lens
""")
def window_counts(spark, sf):
    return _lengths(spark, sf).select("run_id", "length", win.window_count("length", 50, 7).alias("windows"))


_NEAREST = "{f}_value({v} IGNORE NULLS) OVER (PARTITION BY run_id, channel ORDER BY pos ROWS BETWEEN {frame})"
_BACK, _ON = "UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"


@query("interpolated_gaps", f"""
WITH {GAPPY}, nb AS (
  SELECT run_id, channel, pos, count(value) OVER (PARTITION BY run_id, channel) AS filled,
    {_NEAREST.format(f='last', v='CASE WHEN value IS NOT NULL THEN pos END', frame=_BACK)} AS p0, {_NEAREST.format(f='last', v='value', frame=_BACK)} AS v0,
    {_NEAREST.format(f='first', v='CASE WHEN value IS NOT NULL THEN pos END', frame=_ON)} AS p1, {_NEAREST.format(f='first', v='value', frame=_ON)} AS v1 FROM gappy)
SELECT run_id, channel, pos, {r('CASE WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL OR p0 = p1 THEN v0 ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END', 9)} AS value FROM nb WHERE filled > 0
""", digits=9)
def interpolated_gaps(spark, sf):
    """Empty channels leave their run, the other gaps are filled by position."""
    return cleaning.interpolate(domain.gappy_samples(spark, sf)).select("run_id", "channel", "pos", "value")


@query("channel_coverage", f"""
WITH {GAPPY}, p AS (SELECT run_id, channel FROM gappy GROUP BY ALL HAVING count(value) > 0)
SELECT channel, count(*) AS in_runs, count(*) = (SELECT count(DISTINCT run_id) FROM p) AS kept FROM p GROUP BY channel
""")
def channel_coverage(spark, sf):
    """Channels that survive in every run, after channels empty in a run are dropped."""
    return cleaning.channel_coverage(cleaning.drop_empty_channels(domain.gappy_samples(spark, sf)))


@query("shared_channel_samples", f"""
WITH {GAPPY}, p AS (SELECT run_id, channel FROM gappy GROUP BY ALL HAVING count(value) > 0),
k AS (SELECT channel FROM p GROUP BY channel HAVING count(*) = (SELECT count(DISTINCT run_id) FROM p))
SELECT g.channel, count(*) AS samples, count(value) AS filled FROM gappy g SEMI JOIN k USING (channel) GROUP BY ALL
""")
def shared_channel_samples(spark, sf):
    d = cleaning.shared_channels(cleaning.drop_empty_channels(domain.gappy_samples(spark, sf)))
    return d.groupBy("channel").agg(F.count(F.lit(1)).alias("samples"), F.count("value").alias("filled"))


@query("dropped_channels", f"""
WITH {GAPPY} SELECT run_id, channel, count(*) AS samples, count(value) AS filled FROM gappy GROUP BY ALL HAVING count(value) < 8
""")
def dropped_channels(spark, sf):
    """Channels of a run with hardly any reading."""
    return cleaning.channel_fill(domain.gappy_samples(spark, sf)).filter("filled < 8")


@query("complete_channels", f"""
WITH {RUNS}, c AS (SELECT run_id, event_type AS channel, count(*) AS n, count(CASE WHEN value > 2 THEN 1 END) AS f FROM runs GROUP BY ALL)
SELECT run_id, channel, n AS samples FROM c WHERE f = n
""")
def complete_channels(spark, sf):
    """Channels left after those with remaining gaps are dropped."""
    d = domain.samples(spark, sf).select("run_id", F.col("event_type").alias("channel"), F.when(F.col("value") > 2, F.col("value")).alias("value"))
    return cleaning.drop_gappy_channels(d).groupBy("run_id", "channel").agg(F.count(F.lit(1)).alias("samples"))


@query("rejected_runs", f"""
WITH {LENGTHS} SELECT coalesce(CASE WHEN class = 'C4' THEN 'unknown label' WHEN length < 64 THEN 'short' END, 'usable') AS reason,
  count(*) AS runs, sum(length)::BIGINT AS samples FROM lens GROUP BY 1
""")
def rejected_runs(spark, sf):
    """Reasons why runs are left out: one class counts as unknown, 64 samples are needed."""
    known = _lengths(spark, sf).withColumn("class", F.when(F.col("class") != "C4", F.col("class")))
    c = cleaning.run_checks(known, 64).groupBy(F.coalesce("reason", F.lit("usable")).alias("reason"))
    return c.agg(F.count(F.lit(1)).alias("runs"), F.sum("length").alias("samples"))


@query("quarantined_units", """
WITH ch AS (SELECT user_id AS unit, event_type AS channel, count(*) AS length, count(CASE WHEN value < 0.5 THEN 1 END) AS gaps FROM events GROUP BY ALL),
h AS (SELECT unit, max(channel = 'click') AS a, max(channel = 'error') AS b, max(channel = 'view' AND length > 8) AS c,
  sum(gaps) FILTER (channel IN ('click', 'error') OR (channel = 'view' AND length > 8)) AS g FROM ch GROUP BY unit)
SELECT unit, 'C' || (unit % 5) AS class, CASE WHEN NOT (a AND b AND c)
  THEN 'missing ' || concat_ws(',', CASE WHEN NOT a THEN 'click' END, CASE WHEN NOT b THEN 'error' END, CASE WHEN NOT c THEN 'view' END)
  ELSE 'not finite' END AS reason
FROM h WHERE NOT (a AND b AND c) OR g > 0
""")
def quarantined_units(spark, sf):
    """Units set aside before any split: a required channel is missing or not finite."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("channel"), "value")
    ch = ev.groupBy("unit", "channel").agg(F.count(F.lit(1)).alias("length"), F.count(F.when(F.col("value") < 0.5, 1)).alias("gaps"))
    ch = ch.filter("channel <> 'view' OR length > 8")
    units = ev.select("unit").distinct().withColumn("class", F.concat(F.lit("C"), F.col("unit") % 5))
    return cleaning.quarantine(units, ch, ("click", "error", "view"))[1].select("unit", "class", "reason")


@query("classes_lost_to_quarantine", """
WITH ch AS (SELECT user_id AS unit, count(*) AS length, count(CASE WHEN value < 20 THEN 1 END) AS gaps FROM events GROUP BY 1),
cls AS (SELECT DISTINCT 'C' || (user_id % 5) AS class FROM events UNION SELECT 'C9')
SELECT class FROM cls ANTI JOIN (SELECT 'C' || (unit % 5) AS class FROM ch WHERE gaps <= 10) USING (class)
""")
def classes_lost_to_quarantine(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("unit"), F.lit("value").alias("channel"), "value")
    ch = ev.groupBy("unit", "channel").agg(F.count(F.lit(1)).alias("length"), F.count(F.when(F.col("value") < 20, 1)).alias("gaps"))
    ch = ch.withColumn("gaps", F.when(F.col("gaps") > 10, F.col("gaps")).otherwise(0))
    units = ev.select("unit").distinct().withColumn("class", F.concat(F.lit("C"), F.col("unit") % 5))
    good, _ = cleaning.quarantine(units, ch, ("value",))
    classes = units.select("class").distinct().unionByName(spark.createDataFrame([("C9",)], "class string"))
    return splitting.classes_without_runs(classes, good)


@query("normalized_names", """
SELECT p_name AS name, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS plain, count(*) AS n FROM part GROUP BY ALL
""")
def normalized_names(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("name"), normalized_name("p_name").alias("plain")).agg(F.count(F.lit(1)).alias("n"))


_NAMES = """parts_ AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)', 1) AS p FROM pages)"""


def _page_paths(spark, sf):
    d = table(spark, sf, "pages").select("page_id", "url")
    return d.select("page_id", F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path"))


_ALIASES = (("EN", "english"), ("FR", "french"), ("DE", "german"), ("ES", "spanish"), ("THTHRE", "first"), ("TH", "second"),
            ("THER", "third"), ("BLOG", "blog"), ("MTH", "mobile"), ("MTHE", "mobile the"))


@query("inferred_labels", """
WITH al(alias, class) AS (VALUES """ + ", ".join(f"('{a}', '{c}')" for a, c in _ALIASES) + """),
p AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages),
pp AS (SELECT page_id, string_split(path, '/') AS parts FROM p),
st AS (SELECT page_id, CASE WHEN len(parts) > 1 THEN parts[-2] END AS folder, regexp_replace(parts[-1], '\\.[^.]*$', '') AS stem FROM pp),
cand AS (
  SELECT page_id, 0 AS trust, regexp_replace(upper(folder), '[^A-Z0-9]', '', 'g') AS c FROM st
  UNION ALL SELECT page_id, 1, regexp_replace(upper(stem), '[^A-Z0-9]', '', 'g') FROM st
  UNION ALL SELECT page_id, 2, regexp_replace(upper(regexp_extract(stem, '^[A-Za-z_\\-]+')), '[^A-Z0-9]', '', 'g') FROM st),
hit AS (SELECT page_id, class, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN c = alias THEN 0 ELSE 1 END, trust, len(alias) DESC) AS rk
  FROM cand JOIN al ON c <> '' AND starts_with(c, alias))
SELECT p.page_id, p.path, h.class FROM p LEFT JOIN (SELECT * FROM hit WHERE rk = 1) h USING (page_id)
""")
def inferred_labels(spark, sf):
    """Class of a page from the parts of its path."""
    aliases = spark.createDataFrame(_ALIASES, "alias string, class string")
    return selection.infer_labels(_page_paths(spark, sf), aliases)


_STEMS = """names AS (SELECT l_orderkey, 'N' || l_quantity::BIGINT || '_M0' || l_linenumber || '_F' || l_suppkey || '_' ||
  CASE l_returnflag WHEN 'A' THEN 'KA' WHEN 'R' THEN 'KI' ELSE CASE WHEN l_linestatus = 'O' THEN 'K0' ELSE 'KX' END END ||
  lpad((l_partkey % 50)::VARCHAR, 2, '0') || '_' || l_linenumber AS stem, l_shipdate FROM lineitem)"""


def _stems(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
    code = F.when(F.col("l_returnflag") == "A", "KA").when(F.col("l_returnflag") == "R", "KI").when(F.col("l_linestatus") == "O", "K0").otherwise("KX")
    stem = F.concat(F.lit("N"), F.col("l_quantity").cast("long"), F.lit("_M0"), "l_linenumber", F.lit("_F"), "l_suppkey", F.lit("_"), code,
                    F.lpad((F.col("l_partkey") % 50).cast("string"), 2, "0"), F.lit("_"), "l_linenumber")
    return li.select("l_orderkey", stem.alias("stem"))


@query("parsed_run_names", f"""
WITH {_STEMS}, b AS (SELECT stem, regexp_extract(stem, '^(N[0-9]+_M[0-9]+_F[0-9]+)_([A-Za-z]+[0-9]+)_([0-9]+)$', ['s', 'b', 'r']) AS m FROM names)
SELECT code, bad_name, run, count(*) AS files, count(DISTINCT setting) AS settings, count(DISTINCT bearing) AS bearings FROM (
  SELECT m.s AS setting, m.b AS bearing, regexp_extract(m.b, '^(K[ABI]?)([0-9]{{2,3}})$', 1) AS code, m.r::BIGINT AS run,
    CASE WHEN regexp_extract(m.b, '^(K[ABI]?)([0-9]{{2,3}})$', 1) = '' THEN 'unknown bearing code' END AS bad_name FROM b) GROUP BY ALL
""")
def parsed_run_names(spark, sf):
    d = selection.parse_run_names(_stems(spark, sf))
    return d.groupBy("code", "bad_name", "run").agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct("setting").alias("settings"), F.count_distinct("bearing").alias("bearings"))


@query("first_file_of_unit", f"""
WITH {_STEMS} SELECT stem, min(l_orderkey) AS path, count(*) - 1 AS duplicates FROM names GROUP BY stem
""")
def first_file_of_unit(spark, sf):
    return selection.first_file_wins(_stems(spark, sf).withColumnRenamed("l_orderkey", "path"), ["stem"])


@query("kept_classes", """
SELECT l_returnflag || l_linestatus AS class, CASE l_returnflag || l_linestatus WHEN 'RF' THEN 0 WHEN 'AO' THEN 1 ELSE 2 END::BIGINT AS label,
  count(*) AS n FROM lineitem WHERE l_returnflag || l_linestatus IN ('RF', 'AO', 'NF') GROUP BY ALL
""")
def kept_classes(spark, sf):
    li = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("class"))
    return selection.keep_classes(li, ("RF", "AO", "NF")).groupBy("class", "label").agg(F.count(F.lit(1)).alias("n"))


@query("usable_faults", """
SELECT p_size % 21 AS fault, count(*) AS runs FROM part WHERE p_size % 21 NOT IN (3, 9, 15) GROUP BY 1
""")
def usable_faults(spark, sf):
    d = table(spark, sf, "part").select((F.col("p_size") % 21).alias("fault"))
    return selection.without_faults(d, "fault").groupBy("fault").agg(F.count(F.lit(1)).alias("runs"))


@query("onset_trimmed_samples", f"""
WITH {RUNS} SELECT run_id, class, pos - CASE WHEN class = 'C0' THEN 0 ELSE 21 END AS pos, value FROM runs
WHERE pos >= CASE WHEN class = 'C0' THEN 0 ELSE 21 END
""")
def onset_trimmed_samples(spark, sf):
    return selection.trim_onset(domain.samples(spark, sf), normal="C0").select("run_id", "class", "pos", "value")


@query("ordered_samples", f"WITH {RUNS} SELECT run_id, pos, event_type, value FROM runs")
def ordered_samples(spark, sf):
    """Position of each sample in its run."""
    return domain.samples(spark, sf).select("run_id", "pos", "event_type", "value")


@query("evenly_spaced_runs", """
WITH ids AS (SELECT DISTINCT 'C' || (user_id % 5) AS class, user_id AS run_no FROM events),
rk AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY run_no) - 1 AS rank, count(*) OVER (PARTITION BY class) AS n FROM ids),
want AS (SELECT DISTINCT class, i AS pick, round_even(i * ((n - 1)::DOUBLE / 2), 0)::BIGINT AS rank FROM rk, range(0, 3) AS g(i))
SELECT class, pick, rank, run_no FROM rk JOIN want USING (class, rank)
""")
def evenly_spaced_runs(spark, sf):
    ids = table(spark, sf, "events").select(F.concat(F.lit("C"), F.col("user_id") % 5).alias("class"), F.col("user_id").alias("run_no"))
    return selection.evenly_spaced_runs(ids, 3)


@query("first_windows", """
SELECT vec_id AS window_id, label FROM embeddings ORDER BY vec_id LIMIT 256
""")
def first_windows(spark, sf):
    d = table(spark, sf, "embeddings").select(F.col("vec_id").alias("window_id"), "label")
    return selection.first_windows(d, ["window_id"])


@query("stratified_subsample", """
WITH c AS (SELECT count(*) AS n, count(DISTINCT label) AS k, 205 // count(DISTINCT label) AS share FROM embeddings),
rk AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', vec_id, 3)), vec_id) AS rk FROM embeddings),
a AS (SELECT vec_id, label FROM rk, c WHERE rk <= share),
b AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5(concat_ws('|', vec_id, 4)), vec_id) AS rk FROM rk, c WHERE rk.rk > share)
SELECT vec_id, label FROM a UNION ALL SELECT vec_id, label FROM b WHERE rk <= 205 - (SELECT count(*) FROM a)
""")
def stratified_subsample(spark, sf):
    return selection.stratified_subsample(table(spark, sf, "embeddings").select("vec_id", "label"), "label", ["vec_id"], 205, 3)


@query("sixty_twenty_counts", """
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT n, count(*) AS units, greatest(1, round_even(n * 0.2::DOUBLE, 0))::BIGINT AS v FROM n GROUP BY n)
SELECT n, units, CASE WHEN n - 2 * v >= 1 THEN n - 2 * v END AS n_train, CASE WHEN n - 2 * v >= 1 THEN v END AS n_val,
  CASE WHEN n - 2 * v >= 1 THEN v END AS n_test FROM s
""")
def sixty_twenty_counts(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("units"))
    return n.withColumn("s", splitting.sixty_twenty_counts(F.col("n"))).select("n", "units", "s.n_train", "s.n_val", "s.n_test")


def _units(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("class"), (F.col("o_custkey") % 4).alias("bearing"),
        F.col("o_orderstatus").alias("setting"))


_DEALT = f"""un AS (SELECT o_orderkey AS unit, o_orderpriority AS class, o_custkey % 4 AS bearing, o_orderstatus AS setting FROM orders),
sz AS (SELECT class, bearing, setting, count(*) AS size FROM un GROUP BY ALL),
asked AS (SELECT class, n - 2 * v AS tr, v AS va, v AS te, k FROM (
  SELECT class, sum(size)::BIGINT AS n, count(*) AS k, greatest(1, round_even(sum(size) * 0.2::DOUBLE, 0))::BIGINT AS v FROM sz GROUP BY class) WHERE n - 2 * v >= 1),
tn AS (SELECT sz.*, asked.* EXCLUDE class, row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws('|', bearing, setting, {SEED})), bearing, setting) - 1 AS turn
  FROM sz JOIN asked USING (class)),
p1 AS (SELECT *, CASE WHEN tr >= k AND size > 0 THEN 1 ELSE 0 END AS a FROM tn),
p2 AS (SELECT *, CASE WHEN va >= k AND size > a THEN 1 ELSE 0 END AS b FROM p1),
p3 AS (SELECT *, CASE WHEN te >= k AND size > a + b THEN 1 ELSE 0 END AS c FROM p2),
r0 AS (SELECT *, size - a - b - c AS room, tr - sum(a) OVER (PARTITION BY class) AS rem FROM p3),
l1 AS (SELECT class, max(lv) AS lv, arg_max(used, lv) AS used FROM (
  SELECT class, lv, sum(least(room, lv)) AS used, max(rem) AS rem FROM r0, range(0, 100000) AS g(lv) WHERE lv <= (SELECT max(size) FROM sz) GROUP BY ALL) WHERE used <= rem GROUP BY class),
g1 AS (SELECT r0.*, least(room, lv) + CASE WHEN room > lv AND sum(CASE WHEN room > lv THEN 1 ELSE 0 END) OVER (PARTITION BY r0.class ORDER BY turn) <= rem - used THEN 1 ELSE 0 END AS g
  FROM r0 JOIN l1 ON l1.class = r0.class),
r1 AS (SELECT * EXCLUDE (room, rem, g), a + g AS q_train, room - g AS room, va - sum(b) OVER (PARTITION BY class) AS rem, (turn + k - 1) % k AS place FROM g1),
l2 AS (SELECT class, max(lv) AS lv, arg_max(used, lv) AS used FROM (
  SELECT class, lv, sum(least(room, lv)) AS used, max(rem) AS rem FROM r1, range(0, 100000) AS g(lv) WHERE lv <= (SELECT max(size) FROM sz) GROUP BY ALL) WHERE used <= rem GROUP BY class),
q AS (SELECT r1.class, bearing, setting, q_train, b + least(room, lv) + CASE WHEN room > lv AND sum(CASE WHEN room > lv THEN 1 ELSE 0 END) OVER (PARTITION BY r1.class ORDER BY place) <= rem - used THEN 1 ELSE 0 END AS q_val
  FROM r1 JOIN l2 ON l2.class = r1.class),
rk AS (SELECT *, row_number() OVER (PARTITION BY class, bearing, setting ORDER BY md5(concat_ws('|', unit, {SEED})), unit) AS rk FROM un)"""


@query("stratified_cell_split", f"""
WITH {_DEALT} SELECT unit, class, CASE WHEN rk <= q_train THEN 'train' WHEN rk <= q_train + q_val THEN 'val' ELSE 'test' END AS split
FROM rk JOIN q USING (class, bearing, setting)
""")
def stratified_cell_split(spark, sf):
    """Orders as units in cells of (bearing, setting), dealt to 60/20/20; the SQL finds the
    level to which dealing fills the cells."""
    return splitting.split_stratified(_units(spark, sf), SEED, ["bearing", "setting"]).select("unit", "class", "split")


_TINY = _DEALT.replace("""un AS (SELECT o_orderkey AS unit, o_orderpriority AS class, o_custkey % 4 AS bearing, o_orderstatus AS setting FROM orders)""", """
un AS (SELECT o_orderkey AS unit, o_custkey * 3 + o_orderkey % 3 AS class, CASE WHEN o_totalprice < 400000 THEN year(o_orderdate) % 2 END AS bearing, o_orderstatus AS setting FROM orders)""").replace(
    "rk AS (SELECT", "rk0 AS (SELECT").replace("row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws", "row_number() OVER (PARTITION BY sz.class ORDER BY md5(concat_ws").replace(
    "range(0, 100000) AS g(lv) WHERE lv <= (SELECT max(size) FROM sz)", "range(0, 1000) AS g(lv) WHERE lv <= (SELECT max(size) FROM sz)")


@query("tiny_class_split", f"""
WITH {_TINY},
cn AS (SELECT *, count(*) OVER (PARTITION BY class) AS n, row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws('|', unit, {SEED})), unit) AS ck FROM rk0)
SELECT unit, cn.class, CASE WHEN n = 1 THEN 'test' WHEN n = 2 THEN CASE WHEN ck = 1 THEN 'test' ELSE 'train' END
  WHEN rk <= q_train THEN 'train' WHEN rk <= q_train + q_val THEN 'val' ELSE 'test' END AS split
FROM cn LEFT JOIN q ON q.class = cn.class AND q.bearing IS NOT DISTINCT FROM cn.bearing AND q.setting = cn.setting
""")
def tiny_class_split(spark, sf):
    """Orders in classes of one unit, two units and a few, with cells that lack a bearing."""
    units = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("unit"), (F.col("o_custkey") * 3 + F.col("o_orderkey") % 3).alias("class"),
        F.when(F.col("o_totalprice") < 400000, F.year("o_orderdate") % 2).alias("bearing"), F.col("o_orderstatus").alias("setting"))
    return splitting.split_stratified(units, SEED, ["bearing", "setting"]).select("unit", "class", "split")


@query("stratified_split_totals", """
WITH n AS (SELECT o_orderpriority AS class, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT class, n, round_even(n * 0.2::DOUBLE, 0)::BIGINT AS v FROM n)
SELECT class, 'train' AS split, n - 2 * v AS units FROM s UNION ALL SELECT class, 'val', v FROM s UNION ALL SELECT class, 'test', v FROM s
""")
def stratified_split_totals(spark, sf):
    """Dealing over cells must keep the exact class totals."""
    d = splitting.split_stratified(_units(spark, sf), SEED, ["bearing", "setting"])
    return d.groupBy("class", "split").agg(F.count(F.lit(1)).alias("units"))


_BEARINGS = {"A": (4, 1, 1), "N": (7, 3, 2), "R": (1, 1, 1)}


@query("held_out_groups", f"""
WITH g AS (SELECT l_returnflag AS code, CASE l_returnflag WHEN 'A' THEN l_suppkey % 6 WHEN 'N' THEN l_suppkey % 12 ELSE l_suppkey % 3 END AS bearing,
  count(*) AS items FROM (SELECT l_returnflag, l_partkey AS l_suppkey FROM lineitem) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY md5(concat_ws('|', bearing, {SEED})), bearing) AS rk FROM g),
q(code, va, te) AS (VALUES ('A', 1, 1), ('N', 3, 2), ('R', 1, 1))
SELECT code, bearing, items, CASE WHEN rk <= te THEN 'test' WHEN rk <= te + va THEN 'val' ELSE 'train' END AS split FROM rk JOIN q USING (code)
""")
def held_out_groups(spark, sf):
    """Whole groups of parts per class go to one split."""
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("code"), "l_partkey")
    b = F.when(F.col("code") == "A", F.col("l_partkey") % 6).when(F.col("code") == "N", F.col("l_partkey") % 12).otherwise(F.col("l_partkey") % 3)
    units = li.select("code", b.alias("bearing"))
    return splitting.split_groups(units, SEED, _BEARINGS).groupBy("code", "bearing", "split").agg(F.count(F.lit(1)).alias("items"))


@query("leaking_groups", """
WITH s AS (SELECT o_custkey, CASE WHEN (('0x' || substr(md5(concat_ws('|', o_orderkey, 7)), 1, 8))::BIGINT / 4294967296.0::DOUBLE) < 0.8
  THEN 'train' ELSE 'test' END AS split FROM orders)
SELECT o_custkey, count(DISTINCT split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1
""")
def leaking_groups(spark, sf):
    """A split by order leaks customers: the audit finds them."""
    d = table(spark, sf, "orders").select("o_custkey", F.when(uniform("o_orderkey", SEED) < 0.8, "train").otherwise("test").alias("split"))
    return splitting.leakage(d, "o_custkey")


@query("uncovered_cells", f"""
WITH {SPLIT}, seen AS (SELECT DISTINCT class, length % 13 AS cell, split FROM split),
want AS (SELECT DISTINCT class, cell, sp AS split FROM seen, (SELECT unnest(['train', 'val', 'test']) AS sp))
SELECT class, cell, split FROM want ANTI JOIN seen USING (class, cell, split)
""")
def uncovered_cells(spark, sf):
    d = _split(spark, sf).withColumn("cell", F.col("length") % 13)
    return splitting.uncovered_cells(d, ["class", "cell"])


@query("classes_without_runs", """
SELECT 'C' || i AS class FROM range(0, 9) AS g(i) WHERE 'C' || i NOT IN (SELECT 'C' || (user_id % 5) FROM events)
""")
def classes_without_runs(spark, sf):
    classes = spark.createDataFrame([(f"C{i}",) for i in range(9)], "class string")
    return splitting.classes_without_runs(classes, _lengths(spark, sf))


@query("pooled_fast_channel", f"""
WITH {MULTIRATE} SELECT unit, channel, pos // 16 AS pos, {r('avg(value)')} AS value FROM fast GROUP BY unit, channel, pos // 16 HAVING count(*) = 16
""")
def pooled_fast_channel(spark, sf):
    return win.mean_pool(domain.multirate(spark, sf).filter("channel = 'vibration'"), ["unit", "channel"])


@query("aligned_rates", f"""
WITH {MULTIRATE} SELECT unit, pos, {r('avg(v)')} AS vibration, {r('max(f)')} AS force, {r('max(t)')} AS torque FROM (
  SELECT unit, pos // 16 AS pos, value AS v, NULL::DOUBLE AS f, NULL::DOUBLE AS t FROM fast
  UNION ALL SELECT unit, pos, NULL, CASE channel WHEN 'force' THEN value END, CASE channel WHEN 'torque' THEN value END FROM slow)
GROUP BY unit, pos HAVING count(v) = 16 AND count(f) > 0 AND count(t) > 0
""")
def aligned_rates(spark, sf):
    """Fast and slow channels on one grid, trimmed to the shortest; every unit has one record."""
    return win.align_rates(domain.multirate(spark, sf).withColumn("record", F.lit(1)), "unit", ["vibration"], ["force", "torque"])


@query("first_channel_record", f"""
WITH {MULTIRATE} SELECT unit, pos, {r('avg(v)')} AS vibration, {r('max(f)')} AS force FROM (
  SELECT unit, pos // 16 AS pos, value AS v, NULL::DOUBLE AS f FROM fast UNION ALL SELECT unit, pos, NULL, value FROM slow WHERE channel = 'force')
GROUP BY unit, pos HAVING count(v) = 16 AND count(f) > 0
""")
def first_channel_record(spark, sf):
    """Units that repeat their records: the fast channel a second and third time with other values, the slow one a second time and cut short. Only the first record counts."""
    d = domain.multirate(spark, sf).filter("channel <> 'torque'")
    times = F.when(F.col("channel") == "vibration", F.sequence(F.lit(0), F.lit(2))).when(F.col("pos") < 5, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    again = d.withColumn("record", F.explode(times)).withColumn("value", F.col("value") + F.col("record"))
    return win.align_rates(again, "unit", ["vibration"], ["force"])


@query("rate_warnings", f"""
WITH {MULTIRATE}, l AS (SELECT unit, count(*) AS fast_len, count(*) FILTER (pos % 10 = 0) AS slow_len FROM placed GROUP BY unit)
SELECT unit, fast_len, slow_len, {r('fast_len / slow_len')} AS ratio, abs(fast_len / slow_len - 9.5) > 0.45 AS rate_off FROM l
""")
def rate_warnings(spark, sf):
    lengths = domain.multirate(spark, sf).groupBy("unit").agg(
        F.count(F.when(F.col("channel") == "vibration", 1)).alias("fast_len"), F.count(F.when(F.col("channel") == "force", 1)).alias("slow_len"))
    return win.rate_warnings(lengths, factor=9.5, tolerance=0.45)


@query("missing_channels", """
WITH s AS (SELECT DISTINCT o_custkey AS unit, o_orderpriority AS channel FROM orders)
SELECT unit, c AS channel FROM (SELECT DISTINCT unit FROM s), (SELECT unnest(['1-URGENT', '3-MEDIUM', '5-LOW']) AS c)
WHERE (unit, c) NOT IN (SELECT unit, channel FROM s)
""")
def missing_channels(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("channel"))
    return win.missing_channels(d, "unit", ["1-URGENT", "3-MEDIUM", "5-LOW"])


@query("config_slugs", """
SELECT o_orderpriority AS config, trim(regexp_replace(replace('w/o ' || o_orderpriority, 'w/o', 'wo'), '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS slug, count(*) AS n
FROM orders GROUP BY ALL
""")
def config_slugs(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("config"))
    return d.groupBy("config", config_slug(F.concat(F.lit("w/o "), "config")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


_OWN = "CASE WHEN user_id % 50 = 7 THEN 'S' || user_id ELSE 'C' || (user_id % 5) END"
_MIXED = RUNS.replace("'C' || (user_id % 5) AS class", f"{_OWN} AS class") + ", " + SPLIT.replace("'C' || (user_id % 5) AS class", f"{_OWN} AS class") + """,
cuts AS (SELECT *, floor(length * 0.7::DOUBLE)::BIGINT AS b1, floor(length * 0.85::DOUBLE)::BIGINT AS b2 FROM split),
kind AS (SELECT *, CASE WHEN b1 >= 16 AND b2 - b1 >= 16 AND length - b2 >= 16 THEN 'p' WHEN length >= 48 THEN 'f' WHEN length >= 32 THEN 't' ELSE 'o' END AS way FROM cuts),
seg AS (
  SELECT run_id, class, split, 0 AS a, length AS b, 8 AS st FROM kind WHERE n > 1
  UNION ALL SELECT run_id, class, 'train', 0, CASE way WHEN 'p' THEN b1 WHEN 'f' THEN length - 32 ELSE length - 16 END, 4 FROM kind WHERE n = 1 AND way <> 'o'
  UNION ALL SELECT run_id, class, 'val', CASE way WHEN 'p' THEN b1 ELSE length - 32 END, CASE way WHEN 'p' THEN b2 ELSE length - 16 END, 4 FROM kind WHERE n = 1 AND way IN ('p', 'f')
  UNION ALL SELECT run_id, class, 'test', CASE way WHEN 'p' THEN b2 WHEN 'o' THEN 0 ELSE length - 16 END, length, CASE way WHEN 'o' THEN 8 ELSE 4 END FROM kind WHERE n = 1),
chan AS (SELECT run_id, pos, 'value' AS channel, value FROM runs UNION ALL SELECT run_id, pos, 'level', level FROM runs),
long AS (SELECT c.run_id, s.class, s.split, s.a, s.st, channel, pos - a AS pos, value FROM chan c JOIN seg s ON c.run_id = s.run_id AND pos >= a AND pos < b),
stats AS (SELECT channel, avg(value) AS mean, stddev_pop(value) AS std FROM long WHERE split = 'train' GROUP BY channel),
z AS (SELECT * REPLACE ((value - mean) / CASE WHEN std < 1e-8 THEN 1 ELSE std END AS value) FROM long JOIN stats USING (channel)),
w AS (SELECT run_id, class, split, a, st, channel, list(value ORDER BY pos) AS s FROM z GROUP BY ALL),
ix AS (SELECT *, unnest(range(0, (len(s) - 16) // st + 1)) AS j FROM w WHERE len(s) >= 16)"""


def _mixed_samples(spark, sf):
    """Some runs are the only one of their class."""
    user = F.substring("run_id", 2, 20).cast("long")
    own = F.when(user % 50 == 7, F.concat(F.lit("S"), user)).otherwise(F.col("class"))
    return domain.channel_samples(spark, sf).withColumn("class", own)


@query("prepared_windows", f"""
WITH {_MIXED} SELECT run_id, class, split, channel, a + j * st AS start_pos, {r('list_avg(s[j * st + 1 : j * st + 16])')} AS mean, {r('s[j * st + 16]')} AS last_value FROM ix
""")
def prepared_windows(spark, sf):
    """The whole preparation, with single-run classes split in time."""
    w = preparation.prepare(_mixed_samples(spark, sf), W, STRIDE, SEED, within_stride=4)
    mean = F.aggregate("series", F.lit(0.0), lambda a, x: a + x) / F.size("series")
    return w.select("run_id", "class", "split", "channel", (F.col("from_pos") + F.col("start")).alias("start_pos"),
                    mean.alias("mean"), F.element_at("series", -1).alias("last_value"))


@query("prepared_class_summary", f"""
WITH {_MIXED}, v AS (SELECT class, split, channel, list_avg(s[j * st + 1 : j * st + 16]) AS m FROM ix)
SELECT class, split, channel, count(*) AS windows, {r('avg(m)')} AS mean, {r('coalesce(stddev_samp(m), 0)')} AS spread FROM v GROUP BY ALL
""")
def prepared_class_summary(spark, sf):
    """Runs to splits, train-only scaling and windows, then window means per class and split."""
    w = preparation.prepare(_mixed_samples(spark, sf), W, STRIDE, SEED, within_stride=4)
    m = w.select("class", "split", "channel", (F.aggregate("series", F.lit(0.0), lambda a, x: a + x) / F.size("series")).alias("m"))
    return m.groupBy("class", "split", "channel").agg(
        F.count(F.lit(1)).alias("windows"), F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("spread"))


@query("split_warnings", f"""
WITH {SPLIT.replace("'C' || (user_id % 5) AS class", f"{_OWN} AS class")}, c AS (SELECT class, count(*) AS n, max(length) AS l FROM lens GROUP BY class)
SELECT class, CASE WHEN n = 1 AND l >= 64 THEN 'one run, split in time' WHEN n = 1 THEN 'one run, too short to split, test only' WHEN n = 2 THEN 'two runs, no val'
  ELSE 'asked counts do not add up, split in proportion' END AS warning FROM c WHERE n <= 2 OR (class = 'C1' AND n <> 300) UNION ALL SELECT 'C9', 'no runs at all'
""")
def split_warnings(spark, sf):
    user = F.col("user_id")
    own = F.when(user % 50 == 7, F.concat(F.lit("S"), user)).otherwise(F.concat(F.lit("C"), user % 5))
    lengths = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("length")).select(
        F.concat(F.lit("R"), user).alias("run_id"), own.alias("class"), "length")
    assigned = splitting.split_runs(lengths, SEED, {"C1": (200, 50, 50)})
    classes = lengths.select("class").distinct().unionByName(spark.createDataFrame([("C9",)], "class string"))
    return splitting.split_warnings(assigned, classes, 32)


@query("scanned_run_files", f"""
WITH {RUNS} SELECT class, run_id, channel, pos AS file_row, {r('value')} AS value FROM (
  SELECT class, run_id, pos, 'reading' AS channel, value FROM runs UNION ALL SELECT class, run_id, pos, 'level', level FROM runs)
""")
def scanned_run_files(spark, sf):
    """Runs written as CSV files below class folders, scanned back with the class from the path."""
    folder = scratch(spark, "runs")
    s = domain.samples(spark, sf).select("class", "run_id", F.col("pos").alias("sample"), F.col("value").alias("reading"), "level")
    s.write.partitionBy("class").option("header", True).csv(folder)
    d = runfiles.scan_runs(spark, folder, "run_id STRING, sample LONG, reading DOUBLE, level DOUBLE", pos_column="sample", keep=["run_id"])
    return d.select(F.regexp_extract("path", "class=([^/]+)/", 1).alias("class"), "run_id", "channel", "file_row", "value")


@query("ordered_run_files", f"""
WITH {RUNS} SELECT class, run_id, channel, pos AS file_row, {r('value')} AS value FROM (
  SELECT class, run_id, pos, 'reading' AS channel, value FROM runs UNION ALL SELECT class, run_id, pos, 'level', level FROM runs)
""")
def ordered_run_files(spark, sf):
    """Runs written as CSV files without a position column: the order of rows is the order of samples."""
    folder = scratch(spark, "runs")
    s = domain.samples(spark, sf).select("class", F.col("run_id").alias("run"), "pos", F.col("value").alias("reading"), "level")
    # sorted by the folders first, as the writer wants them: it would sort once more, and where that sort spills, rows of a run change places
    in_order = s.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "run", "pos").sortWithinPartitions("class", "run", "pos").drop("pos")
    in_order.write.partitionBy("class", "run").option("header", True).csv(folder)
    d = runfiles.scan_runs(spark, folder, "reading DOUBLE, level DOUBLE", run="run=([^/]+)/")
    at = lambda name: F.regexp_extract("path", f"{name}=([^/]+)/", 1)
    return d.select(at("class").alias("class"), at("run").alias("run_id"), "channel", "file_row", "value")
