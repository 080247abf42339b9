"""Deterministic draws: a number in [0, 1) from a seed and keys, the same on any partitioning.

Taken from an MD5 digest so that any SQL engine can reproduce the draw.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# 13 hex digits of the digest: 52 bits, exact in a double.
DIGITS = 13
SPAN = float(16**DIGITS)


def uniform(seed: int | str, *keys: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(SPAN)


def normal(seed: int | str, *keys: Column) -> Column:
    """Standard normal draw (Box-Muller)."""
    u, v = uniform(f"{seed}/u", *keys), uniform(f"{seed}/v", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2.0 * math.pi) * v)


def between(u: Column, low: float, high: float) -> Column:
    return F.lit(low) + u * F.lit(high - low)


def sign(u: Column) -> Column:
    return F.when(u < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
