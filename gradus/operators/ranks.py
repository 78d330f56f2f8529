"""Exact ranks and running sums over all rows without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

#: Running sums go over at most so many neighbouring buckets in one window, then over the sums of such runs.
_RUN_BITS = 10


def positions(rows: DataFrame, group: str, bucket: str, order: Sequence[Column | str], place: str, total: str) -> DataFrame:
    """``rows`` with each row's place in its group (from 0, by ``bucket``, then ``order``) and the group's size.

    ``rows`` is read twice, so hand in a stored table. ``group`` and ``bucket`` hold no null; a bucket of a group is
    ranked in one task, so buckets have to be fine enough for that. No task sees a whole group: the places that earlier
    buckets take are running sums over runs of 1,024 buckets, then over the sums of the runs.
    """
    counts = rows.groupBy(group, bucket).agg(F.count("*").alias("__n")).withColumn("__run", F.shiftright(F.col(bucket), _RUN_BITS))
    inside = Window.partitionBy(group, "__run").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy(group, "__run").agg(F.sum("__n").alias("__of_run"))
    upto = Window.partitionBy(group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "__run", F.coalesce(F.sum("__of_run").over(upto), F.lit(0)).alias("__earlier"),
                       F.sum("__of_run").over(Window.partitionBy(group)).alias(total))
    before = counts.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(runs, [group, "__run"]).select(
        group, bucket, (F.col("__earlier") + F.col("__inside")).alias("__before"), total)
    ranked = rows.withColumn("__at", F.row_number().over(Window.partitionBy(group, bucket).orderBy(*order)))
    return ranked.join(before, [group, bucket]).withColumn(place, F.col("__before") + F.col("__at") - 1).select(*rows.columns, place, total)


def running(rows: DataFrame, order: Sequence[Column | str], rank: str, sums: Mapping[str, str] = {}) -> DataFrame:
    """``rows`` with each row's place in a total order (from 0), and the sums of columns over the rows before it.

    ``sums`` maps new names to columns. Rows are dealt out by ranges of the order and stored; a range is scanned in
    one task, and what lies before it comes from the totals of the ranges, a row for each partition.
    """
    dealt = stage(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = {rank: F.count(F.lit(1)), **{name: F.sum(column) for name, column in sums.items()}}
    parts = dealt.groupBy("__part").agg(*(total.alias(f"__{name}") for name, total in totals.items()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", *(F.coalesce(F.sum(f"__{name}").over(earlier), F.lit(0)).alias(f"__{name}") for name in totals))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = {rank: F.count(F.lit(1)).over(inside), **{name: F.sum(column).over(inside) for name, column in sums.items()}}
    return dealt.join(F.broadcast(parts), "__part").select(
        *rows.columns, *((F.coalesce(value, F.lit(0)) + F.col(f"__{name}")).alias(name) for name, value in before.items()))
