"""Dimension and fact: projection to one row per key, joins, and one-pass star validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import first_per_key
from .metrics import count_where, gates
from .quality import InvalidDataset


def one_row_per_key(df: DataFrame, key: str, columns: Sequence[str], order_by: Sequence[str] | None = None) -> DataFrame:
    """Fixed projection with the key as grain; which duplicate stays is decided by a total order."""
    return first_per_key(df, [key], order_by, columns)


def left_join(dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    return dim.join(fact, key, "left")


def rows_without_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` rows with no match in ``right``; NULL never matches, duplicates stay."""
    return left.select(key).join(right.select(key), key, "left_anti")


def key_census(left: DataFrame, right: DataFrame, key: str, measures: Sequence[str] = ()) -> DataFrame:
    """Per key (NULL included): rows on the left, on the right, and right rows with each measure.

    Every question about how two tables meet on a key -- overlap, orphans, coverage, row
    multiplication -- is a sum over this one aggregate, so they cost a single shuffle of partial
    counts together and a hot key weighs no more than any other.
    """
    def flag(condition) -> F.Column:
        return F.when(condition, 1).otherwise(0).cast("bigint")

    yes, no = F.lit(True), F.lit(False)
    sides = left.select(
        F.col(key).alias("key"), flag(yes).alias("l"), flag(no).alias("r"),
        *[flag(no).alias(f"m{i}") for i, _ in enumerate(measures)],
    ).unionAll(right.select(
        F.col(key).alias("key"), flag(no).alias("l"), flag(yes).alias("r"),
        *[flag(F.col(m).isNotNull()).alias(f"m{i}") for i, m in enumerate(measures)],
    ))
    return sides.groupBy("key").agg(
        F.sum("l").alias("n_left"), F.sum("r").alias("n_right"),
        *[F.sum(f"m{i}").alias(f"n_{m}") for i, m in enumerate(measures)],
    )


def _sum(col) -> F.Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys per side and set differences, where NULL equals NULL."""
    in_left, in_right = F.col("n_left") > 0, F.col("n_right") > 0
    return key_census(left, right, key).agg(
        count_where(in_left).alias("left_keys"),
        count_where(in_right).alias("right_keys"),
        count_where(in_right & ~in_left).alias("right_only"),
        count_where(in_left & ~in_right).alias("left_only"),
        count_where(in_left & in_right).alias("both"),
    )


def keys_only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks, NULL equal to NULL."""
    return left.select(key).subtract(right.select(key))


def keys_in_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def star_metrics(dim: DataFrame, fact: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """The figures of a star check in one row, all from one census of the keys.

    ``matched`` counts joined rows whose first measure has a value.
    """
    n_dim, n_fact, n_measured = F.col("n_left"), F.col("n_right"), F.col(f"n_{measures[0]}")
    is_null = F.col("key").isNull()
    joinable = F.when(is_null, F.lit(0)).otherwise(n_fact)
    totals = key_census(dim, fact, key, measures).agg(
        _sum(n_dim).alias("dim_total"),
        count_where(n_dim > 0).alias("dim_distinct"),
        _sum(F.when(is_null, n_dim)).alias("dim_null_key"),
        _sum(n_fact).alias("fact_total"),
        count_where(n_fact > 0).alias("fact_distinct"),
        _sum(F.when(is_null, n_fact)).alias("fact_null_key"),
        *[_sum(n_fact - F.col(f"n_{m}")).alias(f"fact_null_{m}") for m in measures],
        _sum(F.when(is_null | (n_dim == 0), n_fact)).alias("orphan_fact"),
        _sum(F.when(joinable == 0, n_dim)).alias("dim_without_fact"),
        _sum(n_dim * F.greatest(joinable, F.lit(1))).alias("join_total"),
        _sum(F.when(~is_null, n_dim * n_measured)).alias("matched"),
    )
    return totals.select(
        "dim_total", "dim_distinct",
        (F.col("dim_total") - F.col("dim_distinct")).alias("dim_duplicate"),
        "dim_null_key", "fact_total", "fact_distinct",
        (F.col("fact_total") - F.col("fact_distinct")).alias("fact_duplicate"),
        "fact_null_key", *[f"fact_null_{m}" for m in measures],
        "orphan_fact", "dim_without_fact", "join_total", "matched",
        (F.col("join_total") - F.col("matched")).alias("non_matched"),
        (F.col("join_total") - F.col("dim_total")).alias("row_multiplication"),
    )


def star_gates(metrics: DataFrame) -> DataFrame:
    dim_grain = F.col("dim_total") == F.col("dim_distinct")
    fact_grain = F.col("fact_total") == F.col("fact_distinct")
    return gates(metrics, {
        "dim_grain": dim_grain,
        "fact_grain": fact_grain,
        "grain": dim_grain & fact_grain,
        "referential_integrity": F.col("orphan_fact") == 0,
        "join": F.col("row_multiplication") == 0,
    })


def join_multiplication(dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """Size of the left join, its distinct keys and the surplus, without performing the join."""
    joinable = F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.col("n_right"))
    return key_census(dim, fact, key).agg(
        _sum(F.col("n_left") * F.greatest(joinable, F.lit(1))).alias("join_total"),
        count_where(F.col("n_left") > 0).alias("join_distinct"),
    ).withColumn("row_multiplication", F.col("join_total") - F.col("join_distinct"))


def guarded_left_join(dim: DataFrame, fact: DataFrame, key: str, metrics: DataFrame | None = None) -> DataFrame:
    """Left join that refuses to multiply rows; the check runs first, before anything is written.

    ``metrics`` are the :func:`star_metrics` of the same two stored tables where they have been taken already: they tell
    whether rows would multiply, so no second census is taken and each side moves once, for the join.
    """
    census = join_multiplication(dim, fact, key) if metrics is None else metrics
    surplus = census.select("row_multiplication").first()["row_multiplication"]
    if surplus:
        raise InvalidDataset(f"joining on {key} would repeat keys: {surplus} surplus rows")
    return left_join(dim, fact, key)
