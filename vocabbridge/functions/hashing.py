"""Seeded pseudo-random values computed from row keys.

A value depends only on the seed and the key, so results are the same for any
partitioning, order of rows or task retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 15 hexadecimal digits are 60 bits, the most that fit a bigint.
_HEX_DIGITS = 15
_RANGE = float(2**60)


def hash_long(seed: int | str, *key: Column) -> Column:
    """60 pseudo-random bits for (seed, key)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("bigint")


def hash_mod(seed: int | str, n: Column | int, *key: Column) -> Column:
    """Uniform integer in ``0..n-1``."""
    return F.pmod(hash_long(seed, *key), F.lit(n).cast("bigint"))


def hash_uniform(seed: int | str, *key: Column) -> Column:
    """Uniform double in ``[0, 1)``."""
    return hash_long(seed, *key).cast("double") / F.lit(_RANGE)


def hash_normal(seed: int | str, *key: Column) -> Column:
    """Standard normal double (Box-Muller on two uniforms)."""
    radius = F.sqrt(-2.0 * F.log(1.0 - hash_uniform(f"{seed}:r", *key)))
    return radius * F.cos(2.0 * math.pi * hash_uniform(f"{seed}:a", *key))


def hash_order(seed: int | str, *key: Column) -> Column:
    """A string whose sort order is a seeded permutation of the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))
