"""Random numbers as a function of (seed, tag, key): the same on any partitioning, and in SQL.

Every operator that draws takes its numbers here, with a tag of its own per
column and purpose, so no two draws share a stream.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(seed: int, tag: str, key: Column) -> Column:
    """32 bits of md5 as a long."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(seed: int, tag: str, key: Column) -> Column:
    """In [0, 1)."""
    return bits(seed, tag, key) / F.lit(4294967296.0)


def laplace(seed: int, tag: str, key: Column, scale: float | Column) -> Column:
    """By inverse CDF; the uniform is in (0, 1), so the result is finite."""
    u = (bits(seed, tag, key) + 0.5) / F.lit(4294967296.0) - 0.5
    return -F.signum(u) * scale * F.log(1 - 2 * F.abs(u))
