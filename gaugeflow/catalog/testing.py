"""Queries on paired tests and their corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.catalog.base import epochs_sql, finals_sql, query, r
from gaugeflow.functions import distributions as dist
from gaugeflow.functions.scalars import config_slug
from gaugeflow.operators import reports, significance as sig
from gaugeflow.plans import domain, grids, reporting
from gaugeflow.session import scratch
from gaugeflow.sources import runlogs

KEYS = ["metric", "config"]


def t_p_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom, as its finite series."""
    s, c = f"(abs({t}) / sqrt({df} + ({t}) * ({t})))", f"({df} / ({df} + ({t}) * ({t})))"
    even = f"{s} * coalesce(list_sum(list_transform(range(0, ({df}) // 2), lambda k: exp(lgamma(k + 0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE)) / sqrt(pi()) * pow({c}, k))), 0)"
    odd = (f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {s} * sqrt({c}) * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), "
           f"lambda k: exp(lgamma(k + 1.0::DOUBLE) - lgamma(k + 1.5::DOUBLE)) * sqrt(pi()) / 2 * pow({c}, k))), 0))")
    return f"(1 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"


def phi_upper_sql(z: str) -> str:
    """P(Z > z) by the power series of the error function."""
    return (f"(0.5 - list_sum(list_transform(range(0, 120), lambda k: pow(-1, k) * exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300) / sqrt(2)) - lgamma(k + 1.0::DOUBLE)) / (2 * k + 1))) "
            f"/ sqrt(pi()) * sign({z}))")


ROWS = """rws AS (SELECT config, seed, 'accuracy' AS metric, accuracy AS value FROM finals UNION ALL SELECT config, seed, 'macro_f1', macro_f1 FROM finals)"""
PAIRS = ROWS + """,
prs AS (SELECT a.metric, a.config, a.seed, a.value AS a, b.value AS b, a.value - b.value AS d FROM rws a JOIN rws b
  ON a.metric = b.metric AND a.seed = b.seed AND b.config = 'full' WHERE a.config <> 'full')"""
MOMENTS = PAIRS + """,
mom AS (SELECT metric, config, count(*) AS n, avg(a) AS am, avg(b) AS bm, avg(d) AS md, stddev_samp(d) AS sd FROM prs GROUP BY ALL)"""
TESTED = MOMENTS + f""",
tp AS (SELECT *, {t_p_sql('(md / (sd / sqrt(n)))', '(n - 1)')} AS t_p FROM mom)"""


def _pairs(spark, sf, seed="month"):
    return sig.pair_by_seed(sig.metric_rows(domain.finals(spark, sf, seed=seed)), "full")


@query("paired_moments", f"""
WITH {finals_sql()}, {MOMENTS} SELECT metric, config, n, {r('am')} AS a_mean, {r('bm')} AS b_mean, {r('md')} AS mean_diff, {r('sd')} AS sd_diff FROM mom
""")
def paired_moments(spark, sf):
    return sig.paired_moments(_pairs(spark, sf), KEYS)


def _quantile_cte(name: str, two_sided: str) -> str:
    return f""", {name} AS (
  SELECT metric, config, n, 0.0::DOUBLE AS lo, 1000.0::DOUBLE AS hi, 0 AS it FROM mom UNION ALL
  SELECT metric, config, n, CASE WHEN {t_p_sql('((lo + hi) / 2)', '(n - 1)')} > {two_sided} THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN {t_p_sql('((lo + hi) / 2)', '(n - 1)')} > {two_sided} THEN hi ELSE (lo + hi) / 2 END, it + 1 FROM {name} WHERE it < 60)"""


@query("paired_t_tests", f"""
WITH RECURSIVE {finals_sql()}, {TESTED}{_quantile_cte('q95', '0.05')}{_quantile_cte('q90', '0.10')}
SELECT metric, config, tp.n, {r('am')} AS a_mean, {r('bm')} AS b_mean, {r('md')} AS mean_diff, {r('sd')} AS sd_diff,
  {r('md - q95.lo * sd / sqrt(tp.n)')} AS ci95_lo, {r('md + q95.lo * sd / sqrt(tp.n)')} AS ci95_hi,
  {r('md - q90.lo * sd / sqrt(tp.n)')} AS ci90_lo, {r('md + q90.lo * sd / sqrt(tp.n)')} AS ci90_hi, {r('md / sd')} AS cohens_dz, {r('t_p')} AS t_p
FROM tp JOIN q95 USING (metric, config) JOIN q90 USING (metric, config) WHERE q95.it = 60 AND q90.it = 60
""")
def paired_t_tests(spark, sf):
    """Intervals, effect size and p; the SQL finds the t quantile by bisection."""
    return sig.paired_t(_pairs(spark, sf), KEYS)


RANKS = """rk AS (SELECT metric, config, seed, d, rank() OVER (PARTITION BY metric, config ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, config, abs(d)) - 1) / 2.0::DOUBLE AS r,
  count(*) OVER (PARTITION BY metric, config, abs(d)) AS ties, count(*) OVER (PARTITION BY metric, config) AS n FROM prs WHERE d <> 0)"""


@query("exact_signed_rank_tests", f"""
WITH {finals_sql(seed='year')}, {PAIRS}, {RANKS},
ob AS (SELECT metric, config, max(n) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS pos, sum(r) AS tot FROM rk GROUP BY ALL),
ix AS (SELECT metric, config, r, row_number() OVER (PARTITION BY metric, config ORDER BY seed) - 1 AS i, n FROM rk),
flips AS (SELECT metric, config, g.m, sum(CASE WHEN (g.m >> i) & 1 = 1 THEN r ELSE 0 END) AS s FROM ix, range(0, 128) AS g(m) WHERE g.m < (1 << n) GROUP BY ALL),
pv AS (SELECT metric, config, ob.n, least(pos, tot - pos) AS stat, avg(CASE WHEN s <= pos THEN 1.0::DOUBLE ELSE 0 END) AS lo, avg(CASE WHEN s >= pos THEN 1.0::DOUBLE ELSE 0 END) AS hi
  FROM flips JOIN ob USING (metric, config) GROUP BY ALL)
SELECT metric, config, n AS n_nonzero, {r('stat')} AS statistic, {r('least(1, 2 * least(lo, hi))')} AS wilcoxon_p FROM pv
""")
def exact_signed_rank_tests(spark, sf):
    """Yearly seeds; the SQL tries all sign patterns."""
    return sig.wilcoxon(_pairs(spark, sf, "year"), KEYS)


WILCOXON = RANKS + f""",
wz AS (SELECT metric, config, max(n) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS pos, sum(r) AS tot, sum(ties * ties - 1) AS tie FROM rk GROUP BY ALL),
ws AS (SELECT metric, config, n, least(pos, tot - pos) AS stat, (tot / 2 - least(pos, tot - pos)) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tie / 48.0::DOUBLE) AS z FROM wz),
wp AS (SELECT metric, config, n, stat, least(1, 2 * {phi_upper_sql('z')}) AS w_p FROM ws)"""


@query("signed_rank_tests", f"""
WITH {finals_sql()}, {PAIRS}, {WILCOXON} SELECT metric, config, n AS n_nonzero, {r('stat')} AS statistic, {r('w_p')} AS wilcoxon_p FROM wp
""")
def signed_rank_tests(spark, sf):
    """Monthly seeds: more than 50 pairs, so the normal approximation."""
    return sig.wilcoxon(_pairs(spark, sf), KEYS)


@query("signed_rank_normal", f"""
WITH {finals_sql()}, {PAIRS}, {WILCOXON} SELECT metric, config, n AS n_nonzero, {r('stat')} AS statistic, {r('w_p')} AS wilcoxon_p FROM wp
""")
def signed_rank_normal(spark, sf):
    """Monthly seeds by the normal approximation, whatever their number."""
    return sig.wilcoxon(_pairs(spark, sf), KEYS, method="normal")


@query("signed_rank_exact", f"""
WITH {finals_sql()}, {PAIRS}, {RANKS},
ob AS (SELECT metric, config, max(n) AS n, sum(CASE WHEN d > 0 THEN 2 * r ELSE 0 END)::BIGINT AS pos, sum(2 * r)::BIGINT AS tot, list([2 * r]) AS rs FROM rk GROUP BY ALL),
law AS (SELECT *, list_reduce(list_concat([list_transform(range(0, tot + 1), lambda s: CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE 0 END)], rs),
  lambda a, x: list_transform(range(1, len(a) + 1), lambda s: (a[s] + CASE WHEN s > x[1] THEN a[(s - x[1])::BIGINT] ELSE 0 END) / 2)) AS p FROM ob)
SELECT metric, config, n AS n_nonzero, {r('least(pos, tot - pos) / 2')} AS statistic,
  {r('least(1, 2 * least(list_sum(p[1:pos + 1]), list_sum(p[pos + 1:])))', 9)} AS wilcoxon_p FROM law
""", digits=9)
def signed_rank_exact(spark, sf):
    """The same pairs by the exact law: one convolution per rank on both sides."""
    return sig.wilcoxon(_pairs(spark, sf), KEYS, method="exact")


def _horner(coefs, x):
    out = f"{coefs[-1]!r}::DOUBLE"
    for c in reversed(coefs[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _ppf_sql(p: str) -> str:
    q, rr = f"({p} - 0.5)", f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))"
    tail = f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)"
    return (f"CASE WHEN abs{q} <= 0.425 THEN {q} * {_horner(dist._CENTRE_P, rr)} / {_horner(dist._CENTRE_Q, rr)} "
            f"ELSE sign({q}) * {_horner(dist._NEAR_P, tail)} / {_horner(dist._NEAR_Q, tail)} END")


@query("normality_tests", f"""
WITH {finals_sql()}, {PAIRS},
o AS (SELECT metric, config, d, row_number() OVER (PARTITION BY metric, config ORDER BY d, seed) AS i, count(*) OVER (PARTITION BY metric, config) AS n FROM prs),
m AS (SELECT *, ((i - 0.375::DOUBLE) / (n + 0.25::DOUBLE)) AS pp FROM o), mm AS (SELECT *, {_ppf_sql('pp')} AS q FROM m),
tot AS (SELECT metric, config, sum(q * q) AS ss FROM mm GROUP BY ALL),
tail_ AS (SELECT metric, config, max(n) AS n, max(ss) AS ss, max(q) AS q1, max(CASE WHEN i = n - 1 THEN q END) AS q2 FROM mm JOIN tot USING (metric, config) GROUP BY ALL),
ab AS (SELECT *, {_horner(sig._SW_TOP, '(1 / sqrt(n))')} + q1 / sqrt(ss) AS a1, {_horner(sig._SW_SECOND, '(1 / sqrt(n))')} + q2 / sqrt(ss) AS a2 FROM tail_),
ph AS (SELECT *, (ss - 2 * q1 * q1 - 2 * q2 * q2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi FROM ab),
wt AS (SELECT mm.metric, mm.config, mm.d, CASE WHEN i = 1 THEN -a1 WHEN i = 2 THEN -a2 WHEN i = mm.n - 1 THEN a2 WHEN i = mm.n THEN a1 ELSE q / sqrt(phi) END AS a, mm.n
  FROM mm JOIN ph USING (metric, config)),
w AS (SELECT metric, config, max(n) AS n, pow(sum(a * d), 2) / (var_pop(d) * count(*)) AS w FROM wt GROUP BY ALL),
z AS (SELECT *, (ln(1 - w) - {_horner(sig._SW_LARGE_MEAN, 'ln(n)')}) / exp({_horner(sig._SW_LARGE_SD, 'ln(n)')}) AS z FROM w)
SELECT metric, config, n, {r('w')} AS w, {r(phi_upper_sql('z'))} AS shapiro_p FROM z
""")
def normality_tests(spark, sf):
    return sig.shapiro(_pairs(spark, sf), KEYS)


CORRECTED = """cp AS (SELECT *, least(1, max((m - rh + 1) * p) OVER (PARTITION BY kind, metric ORDER BY p, config)) AS holm,
    least(1, min(p * m / rh) OVER (PARTITION BY kind, metric ORDER BY p DESC, config DESC)) AS bh
  FROM (SELECT *, row_number() OVER (PARTITION BY kind, metric ORDER BY p, config) AS rh, count(*) OVER (PARTITION BY kind, metric) AS m FROM pall))"""


@query("corrected_p_values", f"""
WITH {finals_sql()}, {TESTED}, {WILCOXON}, pall AS (SELECT 't' AS kind, metric, config, t_p AS p FROM tp UNION ALL SELECT 'w', metric, config, w_p FROM wp), {CORRECTED}
SELECT kind, metric, config, {r('p')} AS p, {r('holm')} AS holm_p, {r('bh')} AS bh_p FROM cp
""")
def corrected_p_values(spark, sf):
    """Step-down and false-discovery corrections of both tests within a metric."""
    pairs = _pairs(spark, sf)
    t = sig.paired_t(pairs, KEYS).select(F.lit("t").alias("kind"), *KEYS, F.col("t_p").alias("p"))
    w = sig.wilcoxon(pairs, KEYS).select(F.lit("w").alias("kind"), *KEYS, F.col("wilcoxon_p").alias("p"))
    fam = ["kind", "metric"]
    return sig.benjamini_hochberg(sig.holm(t.unionByName(w), "p", "holm_p", fam, ["config"]), "p", "bh_p", fam, ["config"])


_TIER = "CASE WHEN th < 0.05 THEN 'robust' WHEN t_p < 0.05 THEN 'suggestive' WHEN t_p < 0.1 THEN 'marginal' ELSE 'n.s.' END"
SIGNIFICANCE = f"""{TESTED}, {WILCOXON}, pall AS (SELECT 't' AS kind, metric, config, t_p AS p FROM tp UNION ALL SELECT 'w', metric, config, w_p FROM wp), {CORRECTED},
sg AS (SELECT tp.*, w.p AS w_p, t.holm AS th, t.bh AS tb, w.holm AS wh, w.bh AS wb FROM tp JOIN cp t ON t.kind = 't' AND t.metric = tp.metric AND t.config = tp.config
  JOIN cp w ON w.kind = 'w' AND w.metric = tp.metric AND w.config = tp.config)"""


@query("significance_table", f"""
WITH {finals_sql()}, {SIGNIFICANCE}
SELECT metric, config, n, {r('md')} AS mean_diff, {r('md / sd')} AS cohens_dz, {r('t_p')} AS t_p, {r('w_p')} AS wilcoxon_p, {r('th')} AS t_holm_p, {r('tb')} AS t_bh_p,
  {r('wh')} AS wilcoxon_holm_p, {r('wb')} AS wilcoxon_bh_p, {_TIER} AS tier FROM sg
""")
def significance_table(spark, sf):
    """Every configuration against the baseline on both metrics."""
    return sig.significance_table(domain.finals(spark, sf), "full").select(
        *KEYS, "n", "mean_diff", "cohens_dz", "t_p", "wilcoxon_p", "t_holm_p", "t_bh_p", "wilcoxon_holm_p", "wilcoxon_bh_p", "tier")


def _measures(report: str, source: str, keys: str, measures: dict[str, str], digits: int = 10) -> str:
    """Measures of a table as rows."""
    return " UNION ALL ".join(f"SELECT '{report}' AS report, {keys}, '{m}' AS measure, {r(e, digits)} AS value FROM {source}" for m, e in measures.items())


_BY_CONFIG = "config, NULL::VARCHAR AS metric, NULL::VARCHAR AS epoch"


@query("logs_to_significance", f"""
WITH {finals_sql()}, {epochs_sql()}, {SIGNIFICANCE},
rs AS (SELECT config, count(*) AS n, avg(accuracy) AS am, coalesce(stddev_samp(accuracy), 0) AS ad, avg(macro_f1) AS fm, coalesce(stddev_samp(macro_f1), 0) AS fd,
  avg(h_alpha) AS h, avg(alpha_tvar) AS tv, avg(s_tau) AS st, avg(rho_last) AS rl, avg(perm_null_z) AS z, avg(observed_var) AS ov, avg(null_mean) AS nm, avg(null_std) AS ns,
  avg(null_mean + 2 * null_std) AS th FROM finals GROUP BY config),
cv AS (SELECT config, epoch, avg(rho) AS m, coalesce(stddev_samp(rho), 0) AS s, count(*) AS n FROM epochs GROUP BY ALL),
lg AS (SELECT count(*) AS n, sum(CASE WHEN f AND seed % 7 = 0 THEN 1 ELSE 0 END) AS bad, sum(CASE WHEN f THEN 0 ELSE 1 END) AS open FROM (
  SELECT config, seed, bool_or(f) AS f FROM (SELECT config, seed, true AS f FROM finals UNION ALL SELECT config, seed, false FROM epochs) GROUP BY ALL))
{_measures('results', 'rs', _BY_CONFIG, {'n': 'n', 'accuracy_mean': 'am', 'accuracy_std': 'ad', 'macro_f1_mean': 'fm', 'macro_f1_std': 'fd'})}
UNION ALL {_measures('indicators', 'rs', _BY_CONFIG, {'n': 'n', 'accuracy_mean': 'am', 'H_alpha': 'h', 'alpha_tvar': 'tv', 'S_tau': 'st', 'rho_last': 'rl', 'perm_null_z': 'z'})}
UNION ALL {_measures('null', 'rs', _BY_CONFIG, {'observed_var': 'ov', 'null_mean': 'nm', 'null_std': 'ns', 'threshold': 'th', 'z_mean': 'z'})}
UNION ALL {_measures('curves', 'cv', 'config, NULL, epoch::VARCHAR', {'rho_mean': 'm', 'rho_std': 's', 'runs': 'n'})}
UNION ALL {_measures('significance', 'sg', 'config, metric, NULL', {'n': 'n', 'mean_diff': 'md', 'cohens_dz': 'md / sd', 't_p': 't_p', 'wilcoxon_p': 'w_p', 't_holm_p': 'th', 't_bh_p': 'tb', 'wilcoxon_holm_p': 'wh', 'wilcoxon_bh_p': 'wb'}, digits=6)}
UNION ALL {_measures('logs', 'lg', 'NULL, NULL, NULL', {'logs': 'n', 'broken_lines': 'bad', 'unfinished': 'open'})}
""", digits=10)
def logs_to_significance(spark, sf):
    """Epochs and finals written as log files with broken lines, and read back into six report tables."""
    name = F.concat(config_slug("config"), F.lit("_seed"), F.col("seed").cast("string"), F.lit(".jsonl")).alias("file")
    epochs = domain.epochs(spark, sf).select(name, F.col("epoch").alias("line_no"), F.to_json(F.struct("epoch", "val_acc", "rho", "s_tau", "h_alpha", "acc_t_aux", "acc_f_aux")).alias("line"))
    null = F.struct("observed_var", "null_mean", "null_std", F.col("perm_null_z").alias("z")).alias("perm_null")
    record = F.to_json(F.struct(F.struct("accuracy", "macro_f1", "rho_last", "H_alpha", "alpha_tvar", "S_tau", null, "degradation").alias("final")))
    ends = F.array(F.struct(F.when(F.col("seed") % 7 == 0, '{"final": {').alias("line"), F.lit(1_000_000).alias("line_no")), F.struct(record.alias("line"), F.lit(1_000_001).alias("line_no")))
    finals = domain.finals(spark, sf).select(name, F.explode(ends).alias("e")).filter("e.line IS NOT NULL").select("file", "e.line_no", "e.line")
    folder = scratch(spark, "logs")
    runlogs.write_logs(epochs.unionByName(finals), folder)
    tables = reporting.log_reports(spark, folder)
    tests = ("mean_diff", "cohens_dz", "t_p", "wilcoxon_p", "t_holm_p", "t_bh_p", "wilcoxon_holm_p", "wilcoxon_bh_p")
    tables["significance"] = tables["significance"].select(*KEYS, "n", *[F.round(c, 6).alias(c) for c in tests])
    return reporting.as_measures(tables)


_EXTENDED = ("full", "w/o_spectral")


def _mixed(spark, sf):
    return sig.significance_table(sig.restrict_seeds(domain.finals(spark, sf), _EXTENDED, 23941, 23999), "full")


_MIXED = finals_sql().replace("finals AS (", "finals0 AS (") + """,
finals AS (SELECT * FROM finals0 WHERE config IN ('full', 'w/o_spectral') OR seed BETWEEN 23941 AND 23999)"""


@query("mixed_size_family", f"""
WITH {_MIXED}, {SIGNIFICANCE} SELECT metric, config, n, {r('md')} AS mean_diff, {r('t_p')} AS t_p, {r('th')} AS t_holm_p, {_TIER} AS tier FROM sg
""")
def mixed_size_family(spark, sf):
    """Two configurations with all seeds, the others with a range of them, in one family."""
    return _mixed(spark, sf).select(*KEYS, "n", "mean_diff", "t_p", "t_holm_p", "tier")


def _tier_side(finals_cte: str, suffix: str) -> str:
    names = ("items", "finals0", "finals", "rws", "prs", "mom", "tp", "rk", "wz", "ws", "wp", "pall", "cp", "sg")
    import re

    text = f"{finals_cte}, {SIGNIFICANCE}"
    for n in names:
        text = re.sub(rf"(?<![.\w']){n}(?![\w'])", f"{n}_{suffix}", text)
    return text


@query("tier_changes", f"""
WITH {_tier_side(_MIXED, 'x')}, {_tier_side(finals_sql(), 'y')},
b AS (SELECT metric, config, n AS n_before, th AS holm_before, {_TIER} AS tier_before FROM sg_x),
a AS (SELECT metric, config, n AS n_after, th AS holm_after, {_TIER} AS tier_after FROM sg_y)
SELECT metric, config, n_before, tier_before, {r('holm_before')} AS holm_before, n_after, tier_after, {r('holm_after')} AS holm_after,
  tier_before <> tier_after AS changed FROM a JOIN b USING (metric, config)
""")
def tier_changes(spark, sf):
    """Tiers before and after more seeds, next to the list of those that changed."""
    before, after = _mixed(spark, sf), sig.significance_table(domain.finals(spark, sf), "full")
    changed = sig.tier_changes(before, after).select(*KEYS, F.lit(True).alias("changed"))

    def side(df, s):
        return df.select(*KEYS, F.col("n").alias(f"n_{s}"), F.col("tier").alias(f"tier_{s}"), F.col("t_holm_p").alias(f"holm_{s}"))

    both = side(before, "before").join(side(after, "after"), KEYS)
    return both.join(changed, KEYS, "left").withColumn("changed", F.coalesce("changed", F.lit(False)))


_T1, _T2 = "((md + eps) / (sd / sqrt(n)))", "((eps - md) / (sd / sqrt(n)))"


def _upper_sql(t):
    return f"CASE WHEN {t} >= 0 THEN {t_p_sql(t, '(n - 1)')} / 2 ELSE 1 - {t_p_sql(t, '(n - 1)')} / 2 END"


@query("equivalence_tests", f"""
WITH RECURSIVE {finals_sql()}, {MOMENTS}{_quantile_cte('q90', '0.10')}, e AS (SELECT *, unnest([0.005::DOUBLE, 0.01::DOUBLE]) AS eps FROM mom),
p AS (SELECT e.*, q90.lo * sd / sqrt(e.n) AS half, greatest({_upper_sql(_T1)}, {_upper_sql(_T2)}) AS tp FROM (SELECT * FROM e) e JOIN (SELECT metric, config, lo FROM q90 WHERE it = 60) q90 USING (metric, config))
SELECT metric, config, eps, n, {r('md')} AS mean_diff, {r('tp')} AS tost_p, tp < 0.05 AS equivalent, md - half >= -eps AND md + half <= eps AS ci90_inside FROM p
""")
def equivalence_tests(spark, sf):
    return sig.tost(_pairs(spark, sf), KEYS)


_CONTRASTS = (
    ("A1", "w/o_spectral", "full_r1", ("accuracy", "macro_f1")), ("A2", "w/o_spectral", "w/o_temporal", ("accuracy",)),
    ("B1", "w/o_fusion", "full", ("accuracy", "macro_f1")), ("B4", "w/o_gating", "w/o_fusion", ("accuracy",)))


@query("planned_contrasts", f"""
WITH {finals_sql()}, {ROWS}, cs(contrast, cfg_a, cfg_b, metric) AS (VALUES {', '.join(f"('{t}', '{a}', '{b}', '{m}')" for t, a, b, ms in _CONTRASTS for m in ms)}),
prs AS (SELECT cs.metric, cs.contrast AS config, cs.cfg_a, cs.cfg_b, a.seed, a.value AS a, b.value AS b, a.value - b.value AS d FROM cs
  JOIN rws a ON a.config = cfg_a AND a.metric = cs.metric JOIN rws b ON b.config = cfg_b AND b.metric = cs.metric AND b.seed = a.seed),
mom AS (SELECT metric, config, cfg_a, cfg_b, count(*) AS n, avg(a) AS am, avg(b) AS bm, avg(d) AS md, stddev_samp(d) AS sd FROM prs GROUP BY ALL),
tp AS (SELECT *, {t_p_sql('(md / (sd / sqrt(n)))', '(n - 1)')} AS t_p FROM mom), {WILCOXON},
pall AS (SELECT 't' AS kind, metric, config, t_p AS p FROM tp UNION ALL SELECT 'w', metric, config, w_p FROM wp), {CORRECTED}
SELECT tp.metric, tp.config AS contrast, cfg_a, cfg_b, n, {r('md')} AS mean_diff, {r('t_p')} AS t_p, {r('w.p')} AS wilcoxon_p, {r('t.holm')} AS holm_p_t, {r('w.holm')} AS holm_p_w
FROM tp JOIN cp t ON t.kind = 't' AND t.metric = tp.metric AND t.config = tp.config JOIN cp w ON w.kind = 'w' AND w.metric = tp.metric AND w.config = tp.config
""")
def planned_contrasts(spark, sf):
    return sig.contrast_table(domain.finals(spark, sf), _CONTRASTS).select(
        "metric", "contrast", "cfg_a", "cfg_b", "n", "mean_diff", "t_p", "wilcoxon_p", "holm_p_t", "holm_p_w")


@query("unmatched_seeds", f"""
WITH {finals_sql(by_cell=True)}, s AS (SELECT DISTINCT config, seed FROM finals WHERE cell = 'B' AND accuracy > 0.4), b AS (SELECT seed FROM s WHERE config = 'full')
SELECT config, count(b.seed) AS common, count(*) AS own, (SELECT count(*) FROM b) AS baseline_seeds, count(b.seed) < least(count(*), (SELECT count(*) FROM b)) AS differs
FROM s LEFT JOIN b USING (seed) WHERE config <> 'full' GROUP BY config
""")
def unmatched_seeds(spark, sf):
    """Where the seeds of a configuration and the baseline differ."""
    return sig.unmatched_seeds(domain.finals(spark, sf, True).filter("cell = 'B' AND accuracy > 0.4"), "full")


@query("paired_by_position", f"""
WITH {finals_sql(by_cell=True)}, o AS (SELECT config, accuracy, row_number() OVER (PARTITION BY config ORDER BY cell, seed) AS i FROM finals)
SELECT a.config, count(*) AS n, {r('avg(a.accuracy - b.accuracy)')} AS mean_diff FROM o a JOIN o b ON a.i = b.i AND b.config = 'full' WHERE a.config <> 'full' GROUP BY ALL
""")
def paired_by_position(spark, sf):
    """Runs without a seed are paired in order, up to the shorter list."""
    f = domain.finals(spark, sf, True).select("config", F.struct("cell", "seed").alias("position"), F.col("accuracy").alias("value"), F.lit("accuracy").alias("metric"))
    return sig.paired_moments(sig.pair_by_position(f, "full"), ["config"]).select("config", "n", "mean_diff")


@query("joined_by_seed", f"""
WITH {finals_sql()} SELECT e.seed, {r('e.accuracy')} AS accuracy_e, {r('f.accuracy')} AS accuracy_f FROM finals e JOIN finals f ON e.seed = f.seed WHERE e.config = 'w/o_fusion' AND f.config = 'full'
""")
def joined_by_seed(spark, sf):
    rows = sig.metric_rows(domain.finals(spark, sf), ["accuracy"])
    p = sig.pair_by_seed(rows.filter(F.col("config").isin("full", "w/o_fusion")), "full")
    return p.select("seed", F.col("a").alias("accuracy_e"), F.col("b").alias("accuracy_f"))


@query("forest_table", f"""
WITH RECURSIVE {finals_sql()}, {MOMENTS}{_quantile_cte('q95', '0.05')}, o(config, position) AS (VALUES ('w/o_spectral', 0), ('w/o_temporal', 1), ('w/o_fusion', 2), ('w/o_gating', 4)),
c AS (SELECT metric, mom.config, position, md, q.lo * sd / sqrt(mom.n) AS half FROM mom JOIN (SELECT * FROM q95 WHERE it = 60) q USING (metric, config) JOIN o ON o.config = mom.config)
SELECT metric, config, position, {r('100 * md')} AS diff_pp, {r('100 * (md - half)')} AS lo_pp, {r('100 * (md + half)')} AS hi_pp, md - half > 0 OR md + half < 0 AS excludes_zero FROM c
""")
def forest_table(spark, sf):
    t = sig.paired_t(_pairs(spark, sf), KEYS)
    return reports.forest_table(t, ("w/o_spectral", "w/o_temporal", "w/o_fusion", "w/o_dynamic_gating", "w/o_gating", "tsnet_vanilla"), ["metric"])


@query("results_with_tests", f"""
WITH {finals_sql()}, {TESTED}, o(config, position) AS (VALUES ('full', 0), ('w/o_spectral', 1), ('w/o_temporal', 2), ('w/o_fusion', 3), ('w/o_gating', 5)),
res AS (SELECT config, avg(accuracy) AS am FROM finals GROUP BY config)
SELECT o.position, config, {r('res.am')} AS accuracy_mean, tp.n AS n_paired, {r('md')} AS mean_diff, {r('t_p')} AS t_p
FROM o JOIN res USING (config) LEFT JOIN (SELECT * FROM tp WHERE metric = 'accuracy') tp USING (config)
""")
def results_with_tests(spark, sf):
    """Results in report order, each with its test; the baseline has none."""
    f = domain.finals(spark, sf)
    t = sig.paired_t(_pairs(spark, sf), KEYS).filter("metric = 'accuracy'").select("config", F.col("n").alias("n_paired"), "mean_diff", "t_p")
    res = reports.results_table(f).select("config", "accuracy_mean")
    return reports.results_with_tests(res, t, grids.ABLATIONS, "full").select("position", "config", "accuracy_mean", "n_paired", "mean_diff", "t_p")


_INDICATORS = ("rho", "s_tau", "h_alpha", "val_acc")


@query("indicator_correlations", f"""
WITH {epochs_sql(by_cell=True)}, late AS (SELECT cell, seed, (avg(val_acc) - avg(h_alpha)) * 100 AS loss FROM epochs WHERE config = 'full' GROUP BY ALL),
l AS (SELECT e.cell, i.indicator, CASE i.indicator WHEN 'rho' THEN rho WHEN 's_tau' THEN s_tau WHEN 'h_alpha' THEN h_alpha ELSE val_acc END AS x, loss
  FROM epochs e JOIN late USING (cell, seed), (VALUES ('rho'), ('s_tau'), ('h_alpha'), ('val_acc')) AS i(indicator) WHERE config = 'full' AND epoch = 3),
k AS (SELECT cell, indicator, rank() OVER (PARTITION BY cell, indicator ORDER BY x) + (count(*) OVER (PARTITION BY cell, indicator, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY cell, indicator ORDER BY loss) + (count(*) OVER (PARTITION BY cell, indicator, loss) - 1) / 2.0::DOUBLE AS ry FROM l),
c AS (SELECT cell, indicator, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM k GROUP BY ALL)
SELECT cell, indicator, n, {r('rho')} AS rho, {r('round(rho, 2)')} AS rho_2, {r(t_p_sql('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)'))} AS p FROM c
""")
def indicator_correlations(spark, sf):
    """Early indicators against the later loss in accuracy, by rank, per cell."""
    e = domain.epochs(spark, sf, True)
    late = e.groupBy("cell", "config", "seed").agg(F.avg("val_acc").alias("accuracy"), F.avg("h_alpha").alias("degraded"))
    return sig.indicator_correlations(e, late, _INDICATORS, (F.col("accuracy") - F.col("degraded")) * 100)


@query("protocol_comparison", f"""
WITH {finals_sql().replace('finals AS (', 'finals0 AS (')}, finals AS (SELECT *, CASE WHEN seed % 2 = 0 THEN 'run' ELSE 'group' END AS protocol FROM finals0),
rws AS (SELECT protocol, config, seed, 'accuracy' AS metric, accuracy AS value FROM finals UNION ALL SELECT protocol, config, seed, 'macro_f1', macro_f1 FROM finals),
m AS (SELECT a.protocol, a.metric, count(*) AS n, avg(a.value - b.value) AS md, stddev_samp(a.value - b.value) AS sd FROM rws a JOIN rws b
  ON a.protocol = b.protocol AND a.metric = b.metric AND a.seed = b.seed WHERE a.config = 'w/o_spectral' AND b.config = 'full' GROUP BY ALL)
SELECT protocol, metric, n, {r('md')} AS mean_diff, {r('round(100 * md, 2)')} AS diff_pp, {r('md / sd')} AS cohens_dz, {r(t_p_sql('(md / (sd / sqrt(n)))', '(n - 1)'))} AS t_p,
  md < 0 AS reversal, min(sign(md)) OVER (PARTITION BY metric) * max(sign(md)) OVER (PARTITION BY metric) < 0 AS sign_differs FROM m
""")
def protocol_comparison(spark, sf):
    f = domain.finals(spark, sf).withColumn("protocol", F.when(F.col("seed") % 2 == 0, "run").otherwise("group"))
    return sig.protocol_comparison(f, "w/o_spectral", "full").drop("wilcoxon_p")


@query("rerun_comparison", f"""
WITH {finals_sql()}, res AS (SELECT seed < 23985 AS first_, config, avg(accuracy) AS accuracy, avg(rho_last) AS rho_last FROM finals GROUP BY ALL),
l AS (SELECT first_, config, 'accuracy' AS metric, accuracy AS v FROM res UNION ALL SELECT first_, config, 'rho_last', rho_last FROM res WHERE config <> 'w/o_fusion' OR first_),
b AS (SELECT config, metric, max(v) FILTER (first_) AS o, max(v) FILTER (NOT first_) AS n FROM l WHERE config IN ('full', 'w/o_spectral', 'w/o_temporal', 'w/o_fusion', 'w/o_gating') GROUP BY ALL)
SELECT config, metric, {r('o')} AS original, {r('n')} AS rerun, {r("CASE WHEN metric = 'accuracy' THEN (n - o) * 100 ELSE n - o END")} AS deviation,
  CASE WHEN metric = 'accuracy' THEN printf('%+.2fpp', (n - o) * 100) END AS text FROM b
""")
def rerun_comparison(spark, sf):
    """Two halves of the seeds as original and rerun."""
    f = domain.finals(spark, sf)

    def long(d):
        res = d.groupBy("config").agg(F.avg("accuracy").alias("accuracy"), F.avg("rho_last").alias("rho_last"))
        return res.unpivot(["config"], ["accuracy", "rho_last"], "metric", "value")

    rerun = long(f.filter("seed >= 23985")).filter("config <> 'w/o_fusion' OR metric = 'accuracy'")
    return reports.rerun_comparison(long(f.filter("seed < 23985")), rerun, grids.ABLATIONS)
