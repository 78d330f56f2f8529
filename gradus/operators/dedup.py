"""One row per key, distinct values, ordered heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The first row of every key in ascending ``order_by`` (NULLs first), as ``columns``.

    NULL is a key like any other. Remaining ties are broken by the other kept columns, so the
    result never depends on partitioning. ``min`` over a struct is combined on the map side: a hot
    key costs one row per map task, not one task per key.
    """
    keys = list(keys)
    kept = list(columns) if columns is not None else df.columns
    ranked = list(order_by) if order_by is not None else []
    ranked += [c for c in kept if c not in keys and c not in ranked]
    if not ranked:
        return df.select(*keys).distinct()
    first = F.min(F.struct(*ranked)).alias("__first")
    return df.groupBy(*keys).agg(first).select(
        *[F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in kept]
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def head(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows in an explicit order (a bounded top-n, never an arbitrary sample)."""
    return df.orderBy(*order_by).limit(n)
