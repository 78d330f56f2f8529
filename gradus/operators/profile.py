"""Profiling: value counts, numeric summaries, timing statistics, dashboard figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import stage
from .metrics import count_where, melt
from .quality import group_counts

_HOT_SHARE = 1000  # a group with more than this part of the rows is hot: no more than so many groups are
_BUCKETS = 1024


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, most frequent first, ties by value."""
    return group_counts(df, column).orderBy(F.col("n").desc(), F.col(column).asc_nulls_first())


def counts_by_label(df: DataFrame, column: str) -> DataFrame:
    return group_counts(df, column).orderBy(column)


def value_probes(df: DataFrame, probes: Mapping[str, str]) -> DataFrame:
    """``(subject='probe', metric, value)``: rows satisfying each SQL condition, in one aggregate."""
    return melt(df.agg(*[count_where(F.expr(c)).alias(n) for n, c in probes.items()]), "probe")


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n, mean, stddev, min, max)`` of those columns that exist, in one aggregate."""
    present = [c for c in columns if c in df.columns]
    stats = {"n": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[
        f(F.col(c).cast("double")).alias(f"{s}__{c}") for c in present for s, f in stats.items()
    ])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{s}__{c}").alias(s) for s in stats]) for c in present
    ])))


def _same_group(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Inner join on equal groups, NULL being a group like any other."""
    renamed = right.withColumnsRenamed({g: f"__{g}" for g in groups})
    condition = [left[g].eqNullSafe(renamed[f"__{g}"]) for g in groups]
    return left.join(renamed, condition).drop(*[f"__{g}" for g in groups])


def _near_median(values: DataFrame, stats: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Values up to their group's bracket, with its ends; those below it are NULL.

    Bounds of hot groups, of which there are few, are broadcast, so that their rows stay where they are. The other
    groups are met in a plain join, whatever their number; none of them is large.
    """
    bounds = stats.select(
        *groups, "runs", F.get("__bracket", F.lit(0)).alias("__lo"), F.get("__bracket", F.lit(1)).alias("__hi"))
    total, least = stats.agg(F.coalesce(F.sum("runs"), F.lit(0)), F.coalesce(F.min("runs"), F.lit(1))).first()
    is_hot = F.col("runs") * _HOT_SHARE > total
    hot, cold = F.broadcast(bounds.filter(is_hot)), bounds.filter(~is_hot)
    near = _same_group(values, hot, groups)
    if least * _HOT_SHARE <= total:
        keys = hot.select(*[F.col(g).alias(f"__{g}") for g in groups])
        others = values.join(keys, [values[g].eqNullSafe(keys[f"__{g}"]) for g in groups], "left_anti")
        near = near.unionByName(_same_group(others, cold, groups))
    return near.filter(F.col("__v") <= F.col("__hi")).withColumn("__v", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")))


def group_stats(df: DataFrame, groups: Sequence[str], value: str, digits: int = 9) -> DataFrame:
    """Mean, median, min, max, sample deviation (0 for one run) and runs per group.

    The median is exact without gathering a group: a quantile sketch, computed along with the other
    figures, brackets it between two values. The distinct values inside the bracket (about a
    thousandth of the group) are counted in buckets of equal width, and ranked only in the buckets that hold the
    middle. A bracket that misses fails the job.
    """
    values = df.select(*groups, F.col(value).cast("double").alias("__v"))
    stats = stage(values.groupBy(*groups).agg(
        F.count("__v").alias("runs"), F.avg("__v").alias("__mean"),
        F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.stddev_samp("__v").alias("__std"),
        F.percentile_approx("__v", [0.4995, 0.5005], 10000).alias("__bracket"),
    ), "group-stats")
    within = F.try_divide(F.col("__v") - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    bucket = F.when(F.col("__v").isNull(), -1).when(F.col("__lo") == F.col("__hi"), 0).otherwise(
        F.floor(F.least(F.nanvl(within, F.lit(1.0)), F.lit(1.0)) * _BUCKETS)).cast("int")
    # used twice below, computed once: Spark reuses the exchange
    counted = _near_median(values, stats, groups).groupBy(*groups, "runs", bucket.alias("__bucket"), "__v").agg(
        F.count(F.lit(1)).alias("__n"))
    ranks = {"__low": F.floor((F.col("runs") + 1) / 2), "__high": F.floor((F.col("runs") + 2) / 2)}

    def running(keys: Sequence[str], order: str) -> Column:
        return F.sum("__n").over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first()).rowsBetween(
            Window.unboundedPreceding, 0))

    upto = counted.groupBy(*groups, "runs", "__bucket").agg(F.sum("__n").alias("__n")).withColumn(
        "__end", running(groups, "__bucket")).withColumn("__before", F.col("__end") - F.col("__n"))
    middle = F.lit(False)
    for rank in ranks.values():
        middle = middle | ((F.col("__before") < rank) & (rank <= F.col("__end")))
    wanted = upto.filter(middle).select(*groups, "__bucket", "__before")
    inside = _same_group(counted, wanted, [*groups, "__bucket"]).withColumn(
        "__upto", F.col("__before") + running([*groups, "__bucket"], "__v"))
    at = {name: F.min(F.when(F.col("__upto") >= rank, F.struct("__upto", "__v"))).alias(name) for name, rank in ranks.items()}
    median = inside.groupBy(*groups).agg(*at.values()).select(*groups, F.when(
        F.col("__low.__v").isNull() | F.col("__high.__v").isNull(), F.raise_error(F.lit("median outside its bracket"))
    ).otherwise((F.col("__low.__v") + F.col("__high.__v")) / 2).alias("__median"))
    none = stats.filter("runs = 0").select(*groups, F.lit(None).cast("double").alias("__median"))
    return _same_group(stats, median.unionByName(none), groups).select(*groups, "runs", *[
        F.round(c, digits).alias(name) for c, name in (
            (F.col("__mean"), "mean_sec"), (F.col("__median"), "median_sec"), (F.col("__min"), "min_sec"),
            (F.col("__max"), "max_sec"), (F.coalesce("__std", F.lit(0.0)), "std_sec"))
    ])


def throughput(stats: DataFrame, rows: str, mean: str = "mean_sec") -> DataFrame:
    """Adds rows per second and nanoseconds per row."""
    return stats.withColumn("rows_per_sec", F.try_divide(F.col(rows), F.col(mean))).withColumn(
        "ns_per_row", F.try_divide(F.col(mean), F.col(rows)) * 1e9)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """``(bin, n)`` over equal bins; 0 and bins + 1 hold what lies outside, NULL rows have a NULL bin."""
    b = F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def dashboard(df: DataFrame, dimensions: Sequence[str], on_time: Column | None = None) -> DataFrame:
    """``(dimension, value, n, on_time_percent)``: counts by every dimension from a single pass.

    Grouping sets expand each row once per dimension but combine on the map side, so the shuffle
    carries group counts only.
    """
    on_time = on_time if on_time is not None else F.lit(None).cast("boolean")
    keys = df.select(*[F.col(d).cast("string").alias(d) for d in dimensions], on_time.alias("__on_time"))
    grouped = keys.groupingSets([[d] for d in dimensions], *dimensions).agg(
        F.grouping_id().alias("__set"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("__on_time").cast("double")).alias("__share"),
    )
    full = (1 << len(dimensions)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        here = F.col("__set") == full - (1 << (len(dimensions) - 1 - i))
        name, value = F.when(here, F.lit(d)).otherwise(name), F.when(here, F.col(d)).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "n",
                          (F.col("__share") * 100).alias("on_time_percent"))


def column_profile(df: DataFrame) -> DataFrame:
    """``(column, rows, nulls)`` for every column, in one aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[count_where(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("__rows").alias("rows"), F.col(c).alias("nulls"))
        for c in df.columns
    ])))
