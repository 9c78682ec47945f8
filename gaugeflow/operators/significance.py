"""Paired tests between configurations, corrections for many tests, equivalence.

Input is a table of pairs: group columns, seed, a (treatment) and b (baseline). Moments,
ranks and sums are Spark aggregates; only distribution functions are numpy, on one row
per comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeflow.functions.distributions import (
    exact_signed_rank_p, normal_quantile, normal_upper_p, polynomial, t_critical, t_two_sided_p, t_upper_p,
)
from gaugeflow.functions.scalars import finite, percent_points, tier
from gaugeflow.operators.ranking import average_rank, counted_ranks

#: With method "auto" the signed-rank test is exact up to this many pairs and normal beyond, as in the recorded results.
EXACT_PAIRS = 50
SIGNED_RANK_METHODS = ("auto", "exact", "normal")

# Royston's polynomials for the W test (AS R94).
_SW_TOP = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_SW_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SW_SMALL_GAMMA = (-2.273, 0.459)
_SW_SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
_SW_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_SW_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_SW_LARGE_SD = (-0.4803, -0.082676, 0.0030302)

# Planned contrasts (tag, treatment, baseline, metrics), equivalence pairs and margins.
CONTRASTS = (
    ("A1", "r1_w/o_spectral", "full_r1", ("accuracy", "macro_f1")),
    ("A2", "r1_w/o_spectral", "w/o_spectral", ("accuracy",)),
    ("B1", "full_fixed_global", "full", ("accuracy", "macro_f1")),
    ("B2", "full_fixed_class", "full", ("accuracy", "macro_f1")),
    ("B3", "full_fixed_class", "full_fixed_global", ("accuracy",)),
    ("B4", "full_fixed_global", "w/o_fusion", ("accuracy",)),
)
EQUIVALENCE_PAIRS = (("full_fixed_global", "full"), ("w/o_fusion", "full"), ("full_r1", "full"))
EQUIVALENCE_MARGINS = (0.005, 0.010)


def metric_rows(finals: DataFrame, metrics: Sequence[str] = ("accuracy", "macro_f1"), keys: Sequence[str] = ()) -> DataFrame:
    """Finals as (keys, config, seed, metric, value)."""
    ids = [*keys, "config", "seed"]
    return finals.select(*ids, *metrics).unpivot(ids, list(metrics), "metric", "value")


def pair_by_seed(rows: DataFrame, baseline: str, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Pairs every configuration with the baseline run of the same seed.

    A seed has one row per configuration, so the baseline value is handed to the other rows
    of its seed by a window; the results are read once, not once per side of a join.
    """
    base = F.max(F.when(F.col("config") == baseline, F.col("value"))).over(Window.partitionBy(*keys, "seed"))
    paired = rows.select(*keys, "seed", "config", F.col("value").alias("a"), base.alias("b"))
    return paired.filter((F.col("config") != baseline) & F.col("b").isNotNull())


def pair_by_position(rows: DataFrame, baseline: str, keys: Sequence[str] = ("metric",), order: str = "position") -> DataFrame:
    """Pairs by order of appearance where no seed was recorded, up to the shorter side."""
    w = Window.partitionBy(*keys, "config").orderBy(order)
    placed = rows.withColumn("seed", F.row_number().over(w) - 1)
    return pair_by_seed(placed, baseline, keys)


def pair_contrasts(rows: DataFrame, contrasts=CONTRASTS) -> DataFrame:
    """Pairs of planned contrasts; seeds without both configurations drop out."""
    flat = [(tag, a, b, m) for tag, a, b, metrics in contrasts for m in metrics]
    dim = F.broadcast(rows.sparkSession.createDataFrame(flat, "contrast string, cfg_a string, cfg_b string, metric string"))
    # one entry per configuration of the grid
    by_seed = rows.groupBy("metric", "seed").agg(F.map_from_entries(F.collect_list(F.struct("config", "value"))).alias("_v"))
    return by_seed.join(dim, "metric").select(
        "metric", "seed", "contrast", "cfg_a", "cfg_b", F.col("_v")[F.col("cfg_a")].alias("a"), F.col("_v")[F.col("cfg_b")].alias("b"),
    ).filter("a IS NOT NULL AND b IS NOT NULL")


def unmatched_seeds(rows: DataFrame, baseline: str) -> DataFrame:
    """Per configuration: runs without a baseline run, and baseline runs without it."""
    seeds = rows.select("config", "seed").distinct()
    base = seeds.filter(F.col("config") == baseline).select("seed", F.lit(1).alias("_b"))
    base_n = base.agg(F.count(F.lit(1)).alias("n")).select("n")
    return (
        seeds.filter(F.col("config") != baseline).join(base, "seed", "left").groupBy("config")
        .agg(F.count("_b").alias("common"), F.count(F.lit(1)).alias("own"))
        .withColumn("baseline_seeds", base_n.scalar())
        .withColumn("differs", F.col("common") < F.least("own", "baseline_seeds"))
    )


def _differences(pairs: DataFrame) -> DataFrame:
    return pairs.filter(finite("a").isNotNull() & finite("b").isNotNull()).withColumn("d", F.col("a") - F.col("b"))



def _moment_aggs() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.avg("a").alias("a_mean"), F.avg("b").alias("b_mean"),
            F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff")]


def paired_moments(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _differences(pairs).groupBy(*keys).agg(*_moment_aggs())


def _add_t(m: DataFrame) -> DataFrame:
    """Intervals, effect size and p from the moments; NULL without spread."""
    usable = (F.col("n") > 1) & (F.col("sd_diff") > 0)
    m = m.withColumn("_se", F.when(usable, F.col("sd_diff") / F.sqrt("n"))).withColumn("_df", F.when(usable, F.col("n") - 1))
    m = m.select(
        "*", t_critical(0.975, F.col("_df")).alias("_t95"), t_critical(0.95, F.col("_df")).alias("_t90"),
        t_two_sided_p(F.col("mean_diff") / F.col("_se"), F.col("_df")).alias("t_p"))
    md, out = F.col("mean_diff"), {}
    for name, t in (("ci95", "_t95"), ("ci90", "_t90")):
        out[f"{name}_lo"], out[f"{name}_hi"] = md - F.col(t) * F.col("_se"), md + F.col(t) * F.col("_se")
    out["cohens_dz"] = F.when(F.col("sd_diff") > 0, md / F.col("sd_diff"))
    return m.withColumns(out).drop("_se", "_df", "_t95", "_t90")


def paired_t(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean difference, 95 % and 90 % intervals, effect size and p."""
    return _add_t(paired_moments(pairs, keys))


def _ranked(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank of each non-zero difference by size (doubled, ties averaged), and its place and
    normal score in value order. A comparison has one row per seed."""
    whole = Window.partitionBy(*keys)
    size = F.col("size")
    d = d.withColumn("size", F.when(F.col("d") != 0, F.abs("d")))
    d = d.select(
        "*", F.count(F.when(size.isNull(), 1)).over(whole).alias("_zeros"), F.count(F.lit(1)).over(whole).alias("_n"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys, "size")).alias("_same"),
        F.rank().over(whole.orderBy("size")).alias("_rank"),  # zero differences are NULL and come first
        F.row_number().over(whole.orderBy("d", "seed")).alias("i"))
    doubled = 2 * (F.col("_rank") - F.col("_zeros")) + F.col("_same") - 1
    return d.select(
        *keys, "a", "b", "d", "size", "i", "_n", F.when(size.isNotNull(), F.col("_same")).alias("ties"),
        F.when(size.isNotNull(), doubled).cast("long").alias("doubled"),
        normal_quantile((F.col("i") - 0.375) / (F.col("_n") + 0.25)).alias("m"))


def _rank_aggs(method: str = "auto") -> list[Column]:
    if method not in SIGNED_RANK_METHODS:
        raise ValueError(f"unknown method {method!r}")
    exact = F.lit(method == "exact") if method != "auto" else F.col("_n") <= EXACT_PAIRS
    tied = F.when(exact & (F.col("ties") > 1), F.struct("doubled", "ties"))
    return [
        F.count("size").alias("n_nonzero"),
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("doubled"))), F.lit(0)).cast("long").alias("_pos"),
        F.coalesce(F.sum("doubled"), F.lit(0)).cast("long").alias("_all"),
        F.coalesce(F.sum(F.col("ties") * F.col("ties") - 1), F.lit(0)).cast("double").alias("_ties"),
        F.collect_set(tied).alias("_tied"),  # groups of equal sizes; the other ranks follow from their number
        F.max("_n").alias("_pairs"), F.max(exact).alias("_by_law"),
    ]


def _add_wilcoxon(s: DataFrame) -> DataFrame:
    n = F.col("n_nonzero").cast("double")
    low = F.least(F.col("_pos"), F.col("_all") - F.col("_pos")) / 2.0
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.when(~F.col("_by_law") & (var > 0), (n * (n + 1) / 4 - low) / F.sqrt(var))
    exact = F.when(F.col("_by_law"), F.col("n_nonzero"))
    s = s.select("*", normal_upper_p(z).alias("_upper"), exact_signed_rank_p(exact, F.col("_tied"), F.col("_pos")).alias("_exact"))
    p = F.when(F.col("_by_law"), F.col("_exact")).otherwise(F.least(F.lit(1.0), 2.0 * F.col("_upper")))
    return s.withColumns({"statistic": low, "wilcoxon_p": p}).drop("_pos", "_all", "_ties", "_tied", "_pairs", "_by_law", "_upper", "_exact")


def wilcoxon(pairs: DataFrame, keys: Sequence[str], method: str = "auto") -> DataFrame:
    """Two-sided signed-rank test, zeros dropped: by the exact law of the rank sum, by its normal
    approximation, or ("auto") exact up to 50 pairs. The exact law costs the cube of the number of pairs.

    A comparison may hold any number of pairs: differences are counted by size and ranked in ranges.
    """
    if method not in SIGNED_RANK_METHODS:
        raise ValueError(f"unknown method {method!r}")
    size = F.when(F.col("d") != 0, F.abs("d"))
    counts = _differences(pairs).select(*keys, "d", size.alias("size")).groupBy(*keys, "size").agg(
        F.count(F.lit(1)).alias("ties"), F.count(F.when(F.col("d") > 0, 1)).alias("up"))
    ranked = counted_ranks(counts, keys, "size", "ties")
    doubled, ties = 2 * F.col("before") + F.col("ties") + 1, F.col("ties")
    short = F.lit(method == "exact") if method != "auto" else F.col("rows") <= EXACT_PAIRS  # with zeros at most this many more
    some = F.col("size").isNotNull()
    s = ranked.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(some, ties)), F.lit(0)).alias("n_nonzero"),
        F.coalesce(F.sum(F.when(some, F.col("up") * doubled)), F.lit(0)).cast("long").alias("_pos"),
        F.coalesce(F.sum(F.when(some, ties * doubled)), F.lit(0)).cast("long").alias("_all"),
        F.coalesce(F.sum(F.when(some, ties.cast("double") * (ties * ties - 1))), F.lit(0.0)).alias("_ties"),
        F.collect_list(F.when(some & short & (ties > 1), F.struct(doubled.alias("doubled"), "ties"))).alias("_tied"),
        F.sum(ties).alias("_pairs"))
    law = F.lit(method == "exact") if method != "auto" else F.col("_pairs") <= EXACT_PAIRS
    return _add_wilcoxon(s.withColumn("_by_law", law)).filter("n_nonzero > 0")


def _score_aggs() -> list[Column]:
    def at(col, rank):
        return F.max(F.when(F.col("i") == rank, F.col(col)))

    return [
        F.var_pop("d").alias("_var"), F.sum(F.col("m") * F.col("m")).alias("_mm"), F.sum(F.col("m") * F.col("d")).alias("_md"),
        at("m", 1).alias("_m1"), at("m", 2).alias("_m2"), at("d", 1).alias("_x1"), at("d", 2).alias("_x2"),
        at("d", F.col("_n") - 1).alias("_y2"), at("d", F.col("_n")).alias("_y1"), F.max("_n").cast("double").alias("_sw_n"),
    ]


def _add_shapiro(agg: DataFrame) -> DataFrame:
    """W and p from sums over ranked rows; NULL below three pairs or without spread.

    The weights of the W statistic depend on the rank alone, so no sorted sample has to be
    in one place.
    """
    n = F.col("_sw_n")
    rs, norm = 1.0 / F.sqrt(n), F.sqrt("_mm")
    a1 = F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(polynomial(_SW_TOP, rs) - F.col("_m1") / norm)
    a2 = F.when(n > 5, polynomial(_SW_SECOND, rs) - F.col("_m2") / norm).otherwise(0.0)
    agg = agg.withColumns({"_a1": a1, "_a2": a2})
    m1, m2 = F.col("_m1"), F.when(n > 5, F.col("_m2")).otherwise(0.0)
    rest = 1 - 2 * F.col("_a1") * F.col("_a1") - 2 * F.col("_a2") * F.col("_a2")
    scale = F.when(n > 3, F.sqrt((F.col("_mm") - 2 * m1 * m1 - 2 * m2 * m2) / rest))
    outer, second = F.col("_y1") - F.col("_x1"), F.col("_y2") - F.col("_x2")
    inner = (F.col("_md") + m1 * outer + F.when(n > 5, m2 * second).otherwise(0.0)) / scale
    ends = F.col("_a1") * outer + F.when(n > 5, F.col("_a2") * second).otherwise(0.0)
    top = F.when(n == 3, ends).otherwise(inner + ends)
    agg = agg.withColumn("w", F.when((n >= 3) & (F.col("_var") > 0), F.least(F.lit(1.0), top * top / (n * F.col("_var")))))
    ln_n, y = F.ln(n), F.when(F.col("w") < 1, F.ln(1.0 - F.col("w")))
    gamma = polynomial(_SW_SMALL_GAMMA, n)
    small = F.when(y < gamma, (-F.ln(gamma - y) - polynomial(_SW_SMALL_MEAN, n)) / F.exp(polynomial(_SW_SMALL_SD, n)))
    large = (y - polynomial(_SW_LARGE_MEAN, ln_n)) / F.exp(polynomial(_SW_LARGE_SD, ln_n))
    agg = agg.select("*", normal_upper_p(F.when(n > 3, F.when(n <= 11, small).otherwise(large))).alias("_p"))
    three = F.greatest(F.lit(0.0), 6.0 / F.lit(3.141592653589793) * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75)))))
    p = (F.when(F.col("w").isNull(), F.lit(None)).when(n == 3, three).when(F.col("w") >= 1, 1.0)
         .when((n <= 11) & (y >= gamma), 0.0).otherwise(F.col("_p")))
    helpers = [c for c in agg.columns if c.startswith("_")]
    return agg.withColumn("shapiro_p", p).drop(*helpers)


def shapiro(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """W test of normality of the differences (three pairs or more)."""
    ranked = _ranked(_differences(pairs), keys).filter("_n >= 3")
    return _add_shapiro(ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_score_aggs()))


def paired_tests(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All paired tests out of one grouping: the pairs are built and read once."""
    one = _ranked(_differences(pairs), keys).groupBy(*keys).agg(*_moment_aggs(), *_rank_aggs(), *_score_aggs())
    scores = ["_var", "_mm", "_md", "_m1", "_m2", "_x1", "_x2", "_y2", "_y1", "_sw_n"]
    keep = F.struct(*scores).alias("sw")
    done = _add_wilcoxon(_add_t(one.withColumn("sw", keep).drop(*scores)))
    return _add_shapiro(done.select("*", "sw.*").drop("sw", "n_nonzero", "statistic"))


def corrected(df: DataFrame, wanted: Sequence[tuple[str, str, str]], family: Sequence[str], key: Sequence[str],
              missing_as_one: bool = False) -> DataFrame:
    """Adds corrected p-values for (p column, method, new column); methods are holm and bh.

    Rows are comparisons, one each. Missing p-values are left out of the family, or count as
    1 when asked. They sort last, so all corrections partition by the family alone and share
    one shuffle.
    """
    whole = Window.partitionBy(*family)
    ps = list(dict.fromkeys(p for p, _, _ in wanted))
    value = {p: F.coalesce(finite(p), F.lit(1.0)) if missing_as_one else finite(p) for p in ps}
    d = df.select("*", *[value[p].alias(f"_p{i}") for i, p in enumerate(ps)])
    up = {p: whole.orderBy(F.asc_nulls_last(f"_p{i}"), *key) for i, p in enumerate(ps)}
    down = {p: whole.orderBy(F.desc_nulls_last(f"_p{i}"), *[F.desc(k) for k in key]) for i, p in enumerate(ps)}
    d = d.select("*", *[F.count(f"_p{i}").over(whole).alias(f"_m{i}") for i in range(len(ps))],
                 *[F.row_number().over(up[p]).alias(f"_r{i}") for i, p in enumerate(ps)])
    steps, out = [], []
    for j, (p, method, name) in enumerate(wanted):
        i = ps.index(p)
        pv, m, rank = F.col(f"_p{i}"), F.col(f"_m{i}"), F.col(f"_r{i}")
        if method == "holm":
            step = F.least(F.lit(1.0), (m - rank + 1) * pv)
            run = F.max(f"_v{j}").over(up[p].rowsBetween(Window.unboundedPreceding, 0))
        elif method == "bh":
            step = pv * m / rank
            run = F.least(F.lit(1.0), F.min(f"_v{j}").over(down[p].rowsBetween(Window.unboundedPreceding, 0)))
        else:
            raise ValueError(f"unknown correction {method!r}")
        steps.append(F.when(pv.isNotNull(), step).alias(f"_v{j}"))
        out.append(F.when(pv.isNotNull(), run).alias(name))
    return d.select("*", *steps).select(*df.columns, *out)


def holm(df: DataFrame, p: str, out: str, family: Sequence[str], key: Sequence[str], missing_as_one: bool = False) -> DataFrame:
    """Step-down correction: the running maximum of (m - rank + 1) p."""
    return corrected(df, [(p, "holm", out)], family, key, missing_as_one)


def benjamini_hochberg(df: DataFrame, p: str, out: str, family: Sequence[str], key: Sequence[str]) -> DataFrame:
    """False-discovery correction: the running minimum of m p / rank from the largest p down."""
    return corrected(df, [(p, "bh", out)], family, key)


def tost(pairs: DataFrame, keys: Sequence[str], margins: Sequence[float] = EQUIVALENCE_MARGINS) -> DataFrame:
    """Two one-sided tests against each margin; without spread p is NULL and nothing is equivalent."""
    m = paired_t(pairs, keys).withColumn("eps", F.explode(F.array(*[F.lit(float(e)) for e in margins])))
    se = F.when(F.col("sd_diff") > 0, F.col("sd_diff") / F.sqrt("n"))
    df = F.col("n") - 1
    m = m.select("*", t_upper_p((F.col("mean_diff") + F.col("eps")) / se, df).alias("p_low"),
                 t_upper_p((F.col("eps") - F.col("mean_diff")) / se, df).alias("p_high"))
    p = F.when(se.isNotNull(), F.greatest("p_low", "p_high"))
    inside = F.when((F.col("n") > 1) & se.isNull(), F.abs("mean_diff") <= F.col("eps")).otherwise(
        (F.col("ci90_lo") >= -F.col("eps")) & (F.col("ci90_hi") <= F.col("eps")))
    return m.select(*keys, "eps", "n", "mean_diff", p.alias("tost_p"), F.coalesce(p < 0.05, F.lit(False)).alias("equivalent"),
                    F.coalesce(inside, F.lit(False)).alias("ci90_inside"))


def compare(pairs: DataFrame, keys: Sequence[str] = ("metric", "config"), family: Sequence[str] = ("metric",)) -> DataFrame:
    """All tests of each comparison, corrected within the family, with its tier."""
    keys = list(keys)
    tests = paired_tests(pairs, keys).filter("n >= 2")
    wanted = [(p, method, f"{name}_{method}_p") for p, name in (("t_p", "t"), ("wilcoxon_p", "wilcoxon")) for method in ("holm", "bh")]
    tests = corrected(tests, wanted, family, keys)
    return tests.withColumn("tier", tier("t_p", "t_holm_p"))


def significance_table(finals: DataFrame, baseline: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every configuration against the baseline on both metrics."""
    rows = metric_rows(finals, keys=keys)
    return compare(pair_by_seed(rows, baseline, [*keys, "metric"]), [*keys, "metric", "config"], [*keys, "metric"])


def contrast_table(finals: DataFrame, contrasts=CONTRASTS) -> DataFrame:
    """Planned contrasts with one family per metric; a missing signed-rank p counts as 1 there."""
    keys = ["metric", "contrast", "cfg_a", "cfg_b"]
    tests = paired_tests(pair_contrasts(metric_rows(finals), contrasts), keys)
    tests = holm(tests, "t_p", "holm_p_t", ["metric"], keys)
    return holm(tests, "wilcoxon_p", "holm_p_w", ["metric"], keys, missing_as_one=True)


def restrict_seeds(finals: DataFrame, extended: Sequence[str], first: int, last: int) -> DataFrame:
    """All seeds for the extended configurations, the seed range for the others."""
    return finals.filter(F.col("config").isin(*extended) | F.col("seed").between(first, last))


def tier_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Comparisons whose tier differs between two significance tables, with both sizes."""
    cols = ["metric", "config"]

    def side(df, s):
        return df.select(*cols, F.col("n").alias(f"n_{s}"), F.col("tier").alias(f"tier_{s}"),
                         F.col("t_holm_p").alias(f"holm_{s}"))

    return side(before, "before").join(side(after, "after"), cols).filter("tier_before <> tier_after")


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per group with its two-sided p; NULL below three finite pairs."""
    d = df.filter(finite(x).isNotNull() & finite(y).isNotNull())
    d = average_rank(average_rank(d, group, x, "_rx"), group, y, "_ry")
    var_x, var_y = F.var_pop("_rx"), F.var_pop("_ry")
    r = F.when((F.count(F.lit(1)) >= 3) & (var_x > 0) & (var_y > 0),
               F.covar_pop("_rx", "_ry") / F.sqrt(F.nullif(var_x * var_y, F.lit(0.0))))
    out = d.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), r.alias("rho"))
    df_ = F.col("n") - 2
    rest = 1.0 - F.col("rho") * F.col("rho")
    t = F.when(rest > 1e-15, F.col("rho") * F.sqrt(df_ / rest))
    out = out.select("*", t_two_sided_p(t, df_).alias("_p"))
    return out.withColumn("p", F.when(F.col("rho").isNotNull() & (rest <= 1e-15), 0.0).otherwise(F.col("_p"))).drop("_p")


def indicator_correlations(epochs: DataFrame, finals: DataFrame, indicators: Sequence[str], drop: Column,
                           epoch: int = 3, config: str = "full", cell: str = "cell") -> DataFrame:
    """Per cell: rank correlation of early indicators with the later loss in accuracy."""
    early = epochs.filter((F.col("config") == config) & (F.col("epoch") == epoch))
    late = finals.filter(F.col("config") == config).select(cell, "seed", drop.alias("loss"))
    joined = early.select(cell, "seed", *indicators).join(late, [cell, "seed"])
    long = joined.unpivot([cell, "seed", "loss"], list(indicators), "indicator", "x")
    return spearman(long, [cell, "indicator"], "x", "loss").withColumn("rho_2", F.round("rho", 2))


def protocol_comparison(finals: DataFrame, treatment: str, baseline: str, protocol: str = "protocol") -> DataFrame:
    """The same paired difference under each split protocol, and whether its sign turns."""
    rows = metric_rows(finals.filter(F.col("config").isin(treatment, baseline)), keys=[protocol])
    keys = [protocol, "metric"]
    pairs = pair_by_seed(rows, baseline, keys)
    t = paired_tests(pairs, keys)
    signs = Window.partitionBy("metric")
    turned = F.min(F.signum("mean_diff")).over(signs) * F.max(F.signum("mean_diff")).over(signs) < 0
    return t.select(*keys, "n", "mean_diff", percent_points("mean_diff").alias("diff_pp"), "cohens_dz", "t_p", "wilcoxon_p",
                    (F.col("mean_diff") < 0).alias("reversal"), turned.alias("sign_differs"))
