"""Sinks: relational publishing, prediction files, promotion to tables, reports, sliced summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import gate_status, union_all
from ..operators.scoring import label_distribution, table_facts, table_gates
from .catalog import create_if_missing, replace_table, row_count
from .staging import observed


class PublishError(RuntimeError):
    pass


@dataclass(frozen=True)
class JdbcTarget:
    source: str
    table: str


def published_source(targets: Sequence[JdbcTarget], table: str) -> str:
    """Source of a target table; only listed targets may be published."""
    for t in targets:
        if t.table == table:
            return t.source
    raise ValueError(f"not a publishable table: {table}")


def publish_jdbc(
    spark: SparkSession, targets: Sequence[JdbcTarget], url: str, properties: Mapping[str, str],
    schema: str | None = None, connections: int = 8,
) -> list[str]:
    """Overwrite each target with its source over ``connections`` parallel connections; reading it stays as wide as it is."""
    done = []
    for t in targets:
        name = f"{schema}.{t.table}" if schema else t.table
        try:
            df = spark.table(published_source(targets, t.table)).repartition(connections)
            df.write.option("truncate", True).jdbc(url, name, mode="overwrite", properties=dict(properties))
        except Exception as error:
            raise PublishError(f"publishing table {t.table} failed") from error
        done.append(name)
    return done


def write_files(df: DataFrame, path: str) -> DataFrame:
    """Replace a Parquet folder and return its reader."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_observed(df: DataFrame, path: str, figures: Mapping[str, Column]) -> tuple[DataFrame, dict]:
    """:func:`write_files`, and aggregates of the rows taken while they are written."""
    watched, seen = observed(df, figures)
    return write_files(watched, path), seen.get


@dataclass(frozen=True)
class Promotion:
    """A Parquet folder to become a table, the columns the table must have and fill, and its label column if it has one."""

    path: str
    table: str
    required: tuple[str, ...]
    label: str | None = None


def promote(spark: SparkSession, promotions: Sequence[Promotion], key: str) -> DataFrame:
    """Replace each table from its folder, then check it: ``(table, gate, passed)``."""
    checks = []
    for p in promotions:
        source = spark.read.parquet(p.path)
        create_if_missing(source, p.table)
        replace_table(source, p.table)
        expected = row_count(source).scalar()
        facts = table_facts(spark.table(p.table), key, p.required, expected)
        checks.append(table_gates(facts).select(F.lit(p.table).alias("table"), "gate", "passed"))
    return union_all(checks)


def promoted_labels(spark: SparkSession, promotions: Sequence[Promotion]) -> DataFrame:
    """``(subject, label, n, percent)`` of every promoted table that has a label column."""
    return union_all([label_distribution(spark.table(p.table), p.label, p.table) for p in promotions if p.label])


def promotion_status(checks: DataFrame) -> DataFrame:
    return gate_status(checks, failed="FAIL")


def write_report(report: DataFrame, path: str) -> DataFrame:
    """JSON lines, one per metric row; reports have tens of rows, hence one file. Returns the reader of what is stored."""
    report.coalesce(1).write.mode("overwrite").json(path)
    return report.sparkSession.read.schema(report.schema).json(path)


def write_reports(reports: Mapping[str, DataFrame], root: str, rows: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Every report below ``root`` under its name, and the readers: they tell of the run, not of what tables hold later.

    Those named in ``rows`` list single rows of data, of which there may be many: Parquet files, written in parallel.
    """
    def write(name: str, df: DataFrame) -> DataFrame:
        path = f"{root.rstrip('/')}/{name}"
        return write_files(df, path) if name in rows else write_report(df, path)

    return {name: write(name, df) for name, df in reports.items()}


def _of_slice(new: DataFrame, column: str, value) -> DataFrame:
    """``new``, whose rows must all be of the slice; one that is not fails the job that reads it."""
    if column not in new.columns:
        return new.withColumn(column, F.lit(value))
    foreign = F.raise_error(F.concat(F.lit(f"a row of another slice than {column}={value}: "), F.coalesce(F.col(column).cast("string"), F.lit("NULL"))))
    return new.withColumn(column, F.when(F.col(column).eqNullSafe(F.lit(value)), F.col(column)).otherwise(foreign))


def replace_slice(existing: DataFrame, new: DataFrame, column: str, value) -> DataFrame:
    """``new`` in place of the rows of ``existing`` whose ``column`` is ``value``; the others stay.

    A row with NULL in the column is in no slice and stays too. A row of ``new`` of another slice raises.
    """
    kept = existing.filter(~F.col(column).eqNullSafe(F.lit(value)))
    return kept.unionByName(_of_slice(new, column, value), allowMissingColumns=True)


def write_csv_slice(spark: SparkSession, path: str, new: DataFrame, column: str, value) -> DataFrame:
    """CSV folder partitioned by ``column``: rewrites one partition, leaves the others untouched.

    A row of ``new`` of another slice raises before anything is written; an empty ``new`` empties the slice. The empty
    folder that then stands for it has no rows and disappears from what is read.
    """
    rows = _of_slice(new, column, value)
    if rows.isEmpty():
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(
            path, spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, str(value)))
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    else:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).option("header", True).csv(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
