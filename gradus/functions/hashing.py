"""Reproducible pseudo-randomness: a function of the seed and the row's key alone.

Nothing depends on partitioning, task order or retries, so a recomputed partition yields the
same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(seed, *parts: Column) -> Column:
    """md5 hex digest of ``seed:part:part...``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def uniform(digest: Column) -> Column:
    """Number in [0, 1) from the first 32 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
