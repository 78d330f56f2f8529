"""Shared shape of every report: long rows ``(subject, metric, value)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_frame(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A few known rows as a relation inside the plan: no task has to deliver them, and projections of them are folded."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    return spark.createDataFrame(pa.Table.from_arrays(
        [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(schema)], schema=schema))


def count_where(condition: Column) -> Column:
    """How many rows satisfy ``condition`` (NULL counts as no); 0 on empty input."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def is_missing(df: DataFrame, column: str) -> Column:
    """Whether a row has neither a value nor, in a floating-point column, a number."""
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return F.col(column).isNull() | F.isnan(column) if floating else F.col(column).isNull()


def distinct_with_null(col: Column) -> Column:
    """Size of ``distinct()``: NULL is one value, unlike in ``count(distinct)``."""
    return F.count_distinct(col) + F.coalesce(F.max(F.when(col.isNull(), 1)), F.lit(0))


def duplicate_count(col: Column) -> Column:
    return F.count(F.lit(1)) - distinct_with_null(col)


def total_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0).cast("bigint"))


def melt(row: DataFrame, subject: str, value_type: str = "bigint") -> DataFrame:
    """Turn a one-row aggregate into ``(subject, metric, value)`` rows."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast(value_type).alias("value"))
        for c in row.columns
    ])
    return row.select(F.lit(subject).alias("subject"), F.inline(pairs))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def gates(row: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """``(gate, passed)`` rows from a one-row frame; an undecided (NULL) gate has failed."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed"))
        for name, c in conditions.items()
    ])
    return row.select(F.inline(pairs))


def gate_status(gate_rows: DataFrame, failed: str = "FAILED") -> DataFrame:
    return gate_rows.agg(
        F.when(F.bool_and("passed"), "SUCCESS").otherwise(failed).alias("status"),
        F.count_if("passed").alias("passed"),
        F.count(F.lit(1)).alias("gates"),
    )
