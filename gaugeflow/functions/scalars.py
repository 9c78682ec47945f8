"""Column functions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row.

    A derived array that a lambda refers to would otherwise be computed again for every
    element, because the optimizer puts its expression in place of the column.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df, name: str, value: Column):
    """Adds a costly column that later filters and selects read without computing it again.

    Those would otherwise be given the expression itself; a generator between them keeps one
    evaluation per row.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def binary_entropy(a) -> Column:
    """Entropy of a two-way choice in bits; 0 and 1 are moved inside by 1e-12."""
    a = F.least(F.greatest(_c(a), F.lit(EPS)), F.lit(1.0 - EPS))
    return -(a * F.ln(a) + (1.0 - a) * F.ln(1.0 - a)) / F.ln(F.lit(2.0))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def array_sum(xs) -> Column:
    return F.aggregate(_c(xs), F.lit(0.0), lambda acc, x: acc + x)


def array_mean(xs) -> Column:
    return array_sum(xs) / F.size(_c(xs))


def array_sum_sq(xs) -> Column:
    return F.aggregate(_c(xs), F.lit(0.0), lambda acc, x: acc + x * x)


def array_var_pop(xs) -> Column:
    """Population variance of an array, around its own running mean; NULL when empty."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(a, x):
        gap, n = x - a["m"], a["n"] + 1.0
        return F.struct(n.alias("n"), (a["m"] + gap / n).alias("m"), (a["s"] + gap * gap * a["n"] / n).alias("s"))

    return F.aggregate(_c(xs), start, step, lambda a: F.try_divide(a["s"], a["n"]))


def finite(x) -> Column:
    """NULL for NaN and infinities, so that aggregates skip them."""
    x = _c(x)
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(x.isNotNull() & ~bad, x)


def std_or_zero(x) -> Column:
    """Sample standard deviation, 0 for a single value."""
    return F.when(F.count(_c(x)) > 0, F.coalesce(F.stddev_samp(_c(x)), F.lit(0.0)))


def percent_points(x) -> Column:
    return F.round(100.0 * _c(x), 2)


def mean_std_text(mean, std, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f±%.{digits}f", _c(mean), _c(std))


def mean_from_text(text) -> Column:
    """The mean of a "mean±std" cell."""
    return F.split(_c(text), "±")[0].cast("double")


def std_from_text(text) -> Column:
    return F.try_element_at(F.split(_c(text), "±"), F.lit(2)).cast("double")


def normalized_name(text) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(_c(text)), "[^A-Z0-9]", "")


def config_slug(name) -> Column:
    """Name safe in file names: "w/o" becomes "wo", other characters "_"."""
    text = F.regexp_replace(_c(name), "w/o", "wo")
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")


def tier(t_p, holm_p) -> Column:
    """Strength of a comparison; a missing p-value never counts as small."""
    t_p, holm_p = finite(t_p), finite(holm_p)
    return (
        F.when(holm_p < 0.05, "robust").when(t_p < 0.05, "suggestive").when(t_p < 0.10, "marginal").otherwise("n.s.")
    )
