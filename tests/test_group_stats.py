"""Exact medians with one hot group among many, and with very many groups."""

import statistics

import pytest
from pyspark.sql import functions as F

from gradus.operators.profile import group_stats
from gradus.sources.staging import stage


def by_hand(rows):
    groups = {}
    for g, v in rows:
        groups.setdefault(g, [])
        if v is not None:
            groups[g].append(v)
    return {g: (len(v), statistics.median(v) if v else None, min(v, default=None), max(v, default=None)) for g, v in groups.items()}


def found(df):
    return {r["g"]: (r["runs"], r["median_sec"], r["min_sec"], r["max_sec"]) for r in group_stats(df, ["g"], "v", 12).collect()}


def test_hot_group_and_many_small_groups(spark):
    # a third of all rows in one group, a NULL group, groups of one, even and odd sizes
    df = stage(spark.range(30_000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 5001 == 1, F.lit(None)).otherwise(
            F.floor(F.sqrt("id")) * 30 + F.col("id") % 30).cast("long").alias("g"),
        F.when(F.col("id") % 97 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_003)) / 64).alias("v")), "hot")
    assert found(df) == by_hand([tuple(r) for r in df.collect()])


def test_equal_and_unbounded_values(spark):
    rows = [("same", 2.5)] * 7 + [("one", 1.0), ("none", None), ("wide", float("-inf")), ("wide", 3.0), ("wide", float("inf"))]
    rows += [("two", 1e300), ("two", -1e300)] + [("skew", 1e-9 * k) for k in range(999)] + [("skew", 1e9)]
    got = found(spark.createDataFrame(rows, "g string, v double"))
    for g, (runs, median, low, high) in by_hand(rows).items():
        assert got[g][0] == runs and got[g][2:] == (low, high)
        assert got[g][1] is None if median is None else got[g][1] == pytest.approx(median, abs=1e-11)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "g string, v double")) == {}
