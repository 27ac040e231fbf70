"""Deterministic pseudo-random columns derived from a row's key.

A draw depends only on the key, never on partitioning or retries, so a lost
executor recomputes the same value.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = float(2**32)


def _hex_unit(digest: Column, start: int) -> Column:
    return (F.conv(F.substring(digest, start, 8), 16, 10).cast("double") + 0.5) / _TWO_32


def hash_uniform(*key: Column) -> Column:
    """Uniform draw in (0, 1) from the md5 of the '|'-joined key."""
    return _hex_unit(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1)


def hash_normal(*key: Column) -> Column:
    """Standard normal draw (Box-Muller on two uniforms from one md5)."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in key]))
    radius = F.sqrt(-2.0 * F.log(_hex_unit(digest, 1)))
    return radius * F.cos(2.0 * math.pi * _hex_unit(digest, 9))
