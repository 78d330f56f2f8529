"""Raw ingest: every source of a landing area becomes one raw table, values untouched."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import table_name
from ..operators.metrics import union_all
from .catalog import replace_table

MANIFEST = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("table", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("columns", T.IntegerType()),
])


def read_source(
    spark: SparkSession, path: str, fmt: str = "csv", header: bool = True, infer_schema: bool = True,
    schema: T.StructType | str | None = None, **options,
) -> DataFrame:
    """A raw source with its own column names. Give a ``schema`` for large text sources: inferring
    types reads them one more time."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", header).option("inferSchema", infer_schema and schema is None)
    return reader.load(path)


@dataclass(frozen=True)
class Opened:
    """A source that could be opened, or the reason it could not."""

    source: str
    table: str
    frame: DataFrame | None
    reason: str | None


def open_sources(
    spark: SparkSession, sources: Mapping[str, str], fmt: str = "csv",
    known: Mapping[str, str] | None = None, schemas: Mapping[str, str | T.StructType] | None = None, **options,
) -> list[Opened]:
    opened = []
    for source, path in sources.items():
        table = table_name(source, known)
        try:
            own = {"schema": schemas[source]} if schemas and source in schemas else {}
            frame = read_source(spark, path, fmt, **{**options, **own})
        except PySparkException as error:
            opened.append(Opened(source, table, None, f"unreadable: {error.getCondition() or type(error).__name__}"))
            continue
        opened.append(Opened(source, table, frame, None if frame.columns else "no columns"))
    return opened


def manifest(spark: SparkSession, opened: Sequence[Opened], required: Sequence[str] = ()) -> DataFrame:
    """``(source, table, status, reason, rows, columns)``: ok, skipped or missing, all counts in one job.

    ``required`` tables that no source yields are listed as missing.
    """
    fixed = [(o.source, o.table, "skipped", o.reason, 0, 0) for o in opened if o.reason]
    seen = {o.table for o in opened}
    fixed += [(None, t, "missing", "required source not found", 0, 0) for t in required if t not in seen]
    parts = [
        o.frame.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(o.source).alias("source"), F.lit(o.table).alias("table"),
            F.when(F.col("rows") > 0, "ok").otherwise("skipped").alias("status"),
            F.when(F.col("rows") == 0, "no rows").alias("reason"),
            "rows", F.lit(len(o.frame.columns)).alias("columns"),
        )
        for o in opened if not o.reason
    ]
    if fixed or not parts:
        parts.append(spark.createDataFrame(fixed, MANIFEST))
    return union_all(parts)


#: Conditions by which Spark reports that a file's content could not be read.
_READ_FAILURE = re.compile(r"\[((?:FAILED_READ_FILE|MALFORMED_\w+|CANNOT_READ_FILE_FOOTER)[\w.]*)\]")


def ingest(
    spark: SparkSession, sources: Mapping[str, str], database: str, fmt: str = "csv",
    known: Mapping[str, str] | None = None, required: Sequence[str] = (),
    schemas: Mapping[str, str | T.StructType] | None = None, **options,
) -> DataFrame:
    """Load every usable source into ``database`` and return the manifest of what happened.

    A source that fails while its rows are read is skipped, its old table stays, and the others go on. Two
    sources that would become the same table raise before anything is read.
    """
    names = [table_name(source, known) for source in sources]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"several sources become the same table: {clash}")
    opened = open_sources(spark, sources, fmt, known, schemas, **options)
    stored = []
    for o in opened:
        frame, reason = o.frame if o.reason is None else None, o.reason
        if frame is not None:
            name = f"{database}.{o.table}"
            try:
                if frame.isEmpty():
                    frame, reason = None, "no rows"
                else:
                    replace_table(frame, name)
                    frame = spark.table(name)
            except (PySparkException, Py4JJavaError) as error:
                if not (failure := _READ_FAILURE.search(str(error))):
                    raise  # the source was read, storing it failed
                frame, reason = None, f"unreadable: {failure[1]}"
        stored.append(Opened(o.source, o.table, frame, reason))
    return manifest(spark, stored, required)
