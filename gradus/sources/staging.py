"""Materialise an intermediate result once, in the cluster's shared checkpoint folder.

A staged frame is a Parquet dataset, so later reads still prune columns and push filters down,
lineage is cut, and a lost executor costs nothing but a re-read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_CONF = "spark.checkpoint.dir"
_local_dir: dict[str, str] = {}
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get(_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"{_CONF} must name a folder that every executor can reach")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_dir:
        _local_dir[app] = tempfile.mkdtemp(prefix="gradus-stage-")
    return _local_dir[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_staged(df: DataFrame, label: str = "stage", partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` to the shared folder and return the path of what was written."""
    path = new_path(df.sparkSession, label)
    _staged.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return path


def stage(df: DataFrame, label: str = "stage", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written."""
    return df.sparkSession.read.schema(df.schema).parquet(write_staged(df, label, partition_by))


def observed(df: DataFrame, figures: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that holds these aggregates of its rows once one action has run over it."""
    seen = Observation()
    return df.observe(seen, *(c.alias(name) for name, c in figures.items())), seen


def stage_observed(df: DataFrame, label: str, figures: Mapping[str, Column]) -> tuple[DataFrame, dict]:
    """:func:`stage`, and aggregates of the rows taken while they are written, so nothing is read for them."""
    watched, seen = observed(df, figures)
    return stage(watched, label), seen.get


def _delete(spark: SparkSession, first: int) -> int:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while len(_staged) > first:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        dropped += bool(path.getFileSystem(conf).delete(path, True))  # what a failed write left goes too
    return dropped


def drop_staged(spark: SparkSession) -> int:
    """Delete what :func:`stage` has written in this process, once no lazy result needs it any more."""
    return _delete(spark, 0)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end, failed or not, what is staged inside; no lazy result of it may be used after."""
    first = len(_staged)
    try:
        yield
    finally:
        _delete(spark, first)
