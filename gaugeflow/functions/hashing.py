"""Randomness from stable keys.

``rand(seed)`` depends on how rows are partitioned, and changes when a lost task is
run again. A hash of the row's own key and a seed gives the same draw everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_32 = 4294967296.0


def _parts(keys) -> list[Column]:
    return [k if isinstance(k, Column) else F.col(k) if isinstance(k, str) else F.lit(k) for k in keys]


def key_hash(*keys) -> Column:
    """Hex digest of the keys; a str names a column, other plain values are literals."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in _parts(keys)]))


def uniform_from(digest: Column, first: int = 1) -> Column:
    """Number in [0, 1) from eight hex digits of a digest."""
    return F.conv(F.substring(digest, first, 8), 16, 10).cast("double") / F.lit(TWO_32)


def uniform(*keys) -> Column:
    return uniform_from(key_hash(*keys))


def fast_uniform(*keys) -> Column:
    """Cheaper draw (xxhash64) for one draw per element of very long series."""
    bits = F.shiftrightunsigned(F.xxhash64(*_parts(keys)), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def normal_from(u1: Column, u2: Column) -> Column:
    """Standard normal from two uniforms (Box-Muller)."""
    return F.sqrt(-2.0 * F.ln(1.0 - u1)) * F.cos(F.lit(6.283185307179586) * u2)
