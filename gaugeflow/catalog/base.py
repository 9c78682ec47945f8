"""Registry of queries, each with the SQL that must give the same rows.

Doubles are rounded to six digits on both sides, because sums of doubles depend on the
order of summation; counts are 64-bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Registers a query; ``digits`` is higher where values are exact decimals, so that
    rounding never meets a tie."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir), digits)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint") or kind.startswith("decimal"):
            c = c.cast("long")
        cols.append(c.alias(name))
    return df.select(*cols)


def r(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"


def u(h: str, first: int = 1) -> str:
    """Uniform number of a hash in SQL."""
    return f"(('0x' || substr({h}, {first}, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


RUNS = """runs AS (
  SELECT 'R' || user_id AS run_id, 'C' || (user_id % 5) AS class,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type, value,
         json_extract_string(props, '$.k')::DOUBLE AS level
  FROM events)"""

GAPPY = RUNS + """,
gappy AS (
  SELECT run_id, class, channel, pos, CASE WHEN event_type = channel AND value > CASE WHEN channel IN ('click', 'error') THEN 60 ELSE 5 END THEN value END AS value
  FROM runs, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS channel))"""

MULTIRATE = """placed AS (
  SELECT l_suppkey AS unit, l_quantity, l_tax, l_discount,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos
  FROM lineitem),
fast AS (SELECT unit, 'vibration' AS channel, pos, l_quantity AS value FROM placed),
slow AS (
  SELECT unit, 'force' AS channel, pos // 10 AS pos, l_tax AS value FROM placed WHERE pos % 10 = 0
  UNION ALL SELECT unit, 'torque', pos // 10, l_discount FROM placed WHERE pos % 10 = 0)"""

ELEMENTS = """el AS (
  SELECT vec_id AS window_id, 'L' || label AS class, 'c' || ((i - 1) // 16) AS channel, (i - 1) % 16 AS t,
         embedding[i]::DOUBLE AS v
  FROM embeddings, range(1, 65) AS g(i))"""

ALPHA = ELEMENTS + """,
al AS (SELECT window_id, class, channel, t, 1 / (1 + exp(-5 * v)) AS a FROM el)"""

_CONFIG = """CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'full' WHEN 'AF' THEN 'w/o_spectral' WHEN 'AO' THEN 'w/o_temporal'
    WHEN 'NF' THEN 'w/o_fusion' WHEN 'RF' THEN 'w/o_gating' WHEN 'RO' THEN 'full_r1' END"""
_CELL = "['O', 'A', 'B', 'C', 'D'][{key} % 5 + 1]"
DEGRADED = ("gaussian_noise_snr20", "gaussian_noise_snr10", "drift", "bias", "stuck", "dropout", "downsample")


def finals_sql(by_cell: bool = False, seed: str = "month") -> str:
    number = "year(l_shipdate) * 12 + month(l_shipdate)" if seed == "month" else "year(l_shipdate)"
    cell = _CELL.format(key="l_suppkey") + " AS cell, " if by_cell else ""
    return f"""items AS (
  SELECT {cell}{_CONFIG} AS config, {number} AS seed, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber FROM lineitem),
finals AS (
  SELECT {'cell, ' if by_cell else ''}config, seed, avg(l_discount) * 10 AS accuracy, avg(l_tax) * 10 AS macro_f1,
    avg(l_quantity) / 50 AS h_alpha, var_pop(l_discount) AS alpha_tvar,
    avg(CASE WHEN l_quantity > 42 THEN 1.0::DOUBLE ELSE 0 END) AS s_tau, avg(l_extendedprice) / 30000 AS rho_last,
    avg(CASE WHEN l_quantity > 45 THEN l_tax END) AS perm_null_z, avg(l_quantity) AS observed_var,
    avg(l_tax) AS null_mean, var_pop(l_tax) AS null_std
  FROM items GROUP BY ALL)"""


def degradation_sql(by_cell: bool = False) -> str:
    """Rows (config, seed, degradation, accuracy), clean included."""
    c = "cell, " if by_cell else ""
    names = "[" + ", ".join(f"'{d}'" for d in DEGRADED) + "]"
    return finals_sql(by_cell) + f""",
deg AS (
  SELECT {c}config, seed, 'clean' AS degradation, accuracy FROM finals
  UNION ALL
  SELECT {c}config, seed, {names}[l_linenumber] AS degradation, avg(l_discount) * 10 FROM items GROUP BY ALL),
degm AS (
  SELECT {c}degradation, config, avg(accuracy) AS mean, coalesce(stddev_samp(accuracy), 0) AS std, count(*) AS n FROM deg GROUP BY ALL)"""


def epochs_sql(by_cell: bool = False) -> str:
    cell = _CELL.format(key="o_custkey") + " AS cell, " if by_cell else ""
    months = "((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)"
    epoch = months + " // 3" if by_cell else months
    seed = "(o_custkey // 5) % 10" if by_cell else "o_custkey % 10"
    return f"""raw AS (
  SELECT {cell}CASE o_orderpriority WHEN '1-URGENT' THEN 'full' WHEN '2-HIGH' THEN 'w/o_spectral' WHEN '3-MEDIUM' THEN 'w/o_temporal'
    WHEN '4-NOT SPECIFIED' THEN 'w/o_fusion' WHEN '5-LOW' THEN 'w/o_gating' END AS config,
    {seed} AS seed, {epoch} AS epoch, o_totalprice AS p, o_orderstatus AS st FROM orders),
epochs AS (
  SELECT {'cell, ' if by_cell else ''}config, seed, epoch, avg(p) / 500000 AS val_acc, avg(p) / 150000 AS rho,
    avg(CASE WHEN p > 400000 THEN 1.0::DOUBLE ELSE 0 END) AS s_tau, min(p) / 500000 AS h_alpha,
    coalesce(avg(CASE WHEN st = 'O' THEN p END) / 500000, 0.5) AS acc_t_aux,
    coalesce(avg(CASE WHEN st = 'F' THEN p END) / 500000, 0.5) AS acc_f_aux
  FROM raw GROUP BY ALL)"""
