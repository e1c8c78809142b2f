"""Reproducible draws: a value depends on its keys only, never on the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bits(*keys: Column) -> Column:
    """32 bits from the keys, as bigint."""
    text = F.concat_ws(":", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*keys: Column) -> Column:
    """In (0, 1)."""
    return (hash_bits(*keys) + 0.5) / F.lit(4294967296.0)


def integer(low: Column | int, high: Column | int, *keys: Column) -> Column:
    """In [low, high], both included."""
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return (low + F.pmod(hash_bits(*keys), high - low + 1)).cast("bigint")


def normal(*keys: Column) -> Column:
    """Standard normal by the Box-Muller transform of two uniforms."""
    u, v = uniform(*keys, F.lit("u")), uniform(*keys, F.lit("v"))
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)
