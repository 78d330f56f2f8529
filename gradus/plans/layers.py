"""The data layers: raw -> standard -> star -> feature sets. Steps hand over stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as feature_ops
from ..operators import quality, star
from ..operators.features import FeatureSpec
from ..operators.metrics import count_where, is_missing, local_frame, melt, union_all
from ..operators.standardize import TableSpec, standardize_once
from ..sources.catalog import LAYERS, replace_table, table_exists
from ..sources.staging import stage


@dataclass(frozen=True)
class Layers:
    bronze: str = LAYERS[0]
    silver: str = LAYERS[1]
    gold: str = LAYERS[2]
    feature_store: str = LAYERS[3]

    def names(self) -> list[str]:
        return [self.bronze, self.silver, self.gold, self.feature_store]


@dataclass(frozen=True)
class StarSpec:
    """Dimension and fact of the star, and the tables passed through unchanged (source -> target)."""

    key: str
    dim_source: str
    dim_target: str
    dim_columns: tuple[str, ...]
    fact_source: str
    fact_target: str
    fact_columns: tuple[str, ...]
    measures: tuple[str, ...]
    fact_order: tuple[str, ...] = ()
    pass_through: Mapping[str, str] = field(default_factory=dict)


# --------------------------------------------------------------------------------------- silver

def _replaced(name: str, rows: DataFrame) -> DataFrame:
    replace_table(rows, name)
    return rows.sparkSession.table(name)


def standardize_layer(spark: SparkSession, specs: Sequence[TableSpec], layers: Layers) -> dict[str, DataFrame]:
    """Write every specified table that exists; returns ``summary``, ``rejected`` and ``counts`` frames.

    Sources without a spec stay raw; specs without a source are skipped. A raw table is read once: figures are taken
    while its typed rows are stored, and everything else is read from there.
    """
    summaries, rejected, counts = [], [], []
    for spec in specs:
        source = f"{layers.bronze}.{spec.source}"
        if not table_exists(spark, source):
            continue
        result = standardize_once(spark.table(source), spec, partial(_replaced, f"{layers.silver}.{spec.target}"))
        summaries.append(result.summary)
        if result.rejected is not None:
            rejected.append(result.rejected.select(
                F.lit(spec.target).alias("table"), F.col("key").cast("string").alias("key"), "reason"))
            counts.append(melt(result.counts, spec.target))
    frames = {"summary": summaries, "rejected": rejected, "counts": counts}
    return {name: union_all(parts) for name, parts in frames.items() if parts}


def quality_report(summaries: DataFrame, dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """``(subject, metric, value)``: the table summaries and how the keys of two tables overlap."""
    names = ("initial", "valid", "invalid", "excluded")
    rows = summaries.select(F.col("table").alias("subject"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("bigint").alias("value")) for n in names])))
    return rows.unionByName(melt(star.key_overlap(dim, fact, key), "key_overlap"))


# ----------------------------------------------------------------------------------------- gold

def star_layer(spark: SparkSession, spec: StarSpec, layers: Layers) -> dict[str, DataFrame]:
    """Write dimension, fact and pass-through tables; returns the star ``metrics`` and ``gates``.

    The figures are one row, taken once from what was written: gates, reports and the guard of the join read that row.
    """
    dim_name, fact_name = f"{layers.gold}.{spec.dim_target}", f"{layers.gold}.{spec.fact_target}"
    dim = star.one_row_per_key(spark.table(f"{layers.silver}.{spec.dim_source}"), spec.key, spec.dim_columns)
    replace_table(dim, dim_name, f"dimension, primary key {spec.key}: one row per {spec.key}")
    fact = star.one_row_per_key(
        spark.table(f"{layers.silver}.{spec.fact_source}"), spec.key, spec.fact_columns, spec.fact_order or None)
    replace_table(fact, fact_name, f"fact, foreign key {spec.key} -> {spec.dim_target}: one row per {spec.key}")
    for source, target in spec.pass_through.items():
        if table_exists(spark, f"{layers.silver}.{source}"):
            replace_table(spark.table(f"{layers.silver}.{source}"), f"{layers.gold}.{target}")
    census = star.star_metrics(spark.table(dim_name), spark.table(fact_name), spec.key, spec.measures)
    metrics = local_frame(spark, [tuple(census.first())], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in census.schema))
    return {"metrics": metrics, "gates": star.star_gates(metrics)}


# -------------------------------------------------------------------------------- feature store

def feature_sets(joined: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, DataFrame]:
    """Training and inference rows of one guarded, stored join."""
    return feature_ops.training_set(joined, spec, unique=True), feature_ops.inference_set(joined, spec, unique=True)


def feature_report(joined: DataFrame, training: DataFrame, inference: DataFrame, spec: FeatureSpec) -> DataFrame:
    """``(subject, metric, value)``: population counts, and what was measured on the finished sets."""
    def measured(df: DataFrame, subject: str, extra: Sequence[str]) -> DataFrame:
        nulls = F.lit(0).cast("bigint")
        for c in [*spec.features, *extra]:
            nulls = nulls + count_where(is_missing(df, c))
        return melt(df.agg(
            F.count(F.lit(1)).alias("written"), nulls.alias("null_features"),
            quality.duplicate_count(F.col(spec.key)).alias("duplicate_keys")), subject)

    return union_all([
        melt(feature_ops.feature_report(joined, spec, training=True), "training"),
        measured(training, "training", [spec.label]),
        melt(feature_ops.feature_report(joined, spec, training=False), "inference"),
        measured(inference, "inference", []),
    ])


def feature_layer(
    spark: SparkSession, star_spec: StarSpec, spec: FeatureSpec, layers: Layers,
    training_table: str = "training_dataset", inference_table: str = "inference_dataset", metrics: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Write both feature sets from one join; returns the ``report`` and the ``excluded`` rows.

    ``metrics`` are those of :func:`star_layer` where it has just written the two tables.
    """
    dim = spark.table(f"{layers.gold}.{star_spec.dim_target}")
    fact = spark.table(f"{layers.gold}.{star_spec.fact_target}")
    joined = stage(star.guarded_left_join(dim, fact, spec.key, metrics), "star")
    training, inference = feature_sets(joined, spec)
    names = [f"{layers.feature_store}.{t}" for t in (training_table, inference_table)]
    for df, name in zip((training, inference), names):
        replace_table(df, name)
    excluded = [
        feature_ops.excluded_rows(joined, spec, training=flag).select(F.lit(label).alias("set"), "key", "reason")
        for flag, label in ((True, "training"), (False, "inference"))
    ]
    return {
        "report": feature_report(joined, spark.table(names[0]), spark.table(names[1]), spec),
        "excluded": union_all(excluded),
    }
