"""End to end: landing area -> raw -> standard -> star -> (publish) -> feature sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.features import FeatureSpec
from ..operators.standardize import TableSpec
from ..sources import catalog, ingest
from ..sources.publish import JdbcTarget, publish_jdbc, write_reports
from ..sources.staging import scratch
from .layers import Layers, StarSpec, feature_layer, quality_report, standardize_layer, star_layer


@dataclass(frozen=True)
class FlowSpec:
    tables: Sequence[TableSpec]
    star: StarSpec
    features: FeatureSpec
    known_sources: Mapping[str, str] = field(default_factory=dict)
    layers: Layers = Layers()


@dataclass(frozen=True)
class JdbcPublication:
    url: str
    properties: Mapping[str, str]
    targets: Sequence[JdbcTarget]
    schema: str | None = None


def run(
    spark: SparkSession, spec: FlowSpec, sources: Mapping[str, str], fmt: str = "csv",
    publication: JdbcPublication | None = None, location: str | None = None, reports: str | None = None,
    schemas: Mapping[str, str | StructType] | None = None, **read_options,
) -> dict[str, DataFrame]:
    """Run all layers in order; the session stays the caller's. Returns the reports of every step.

    With ``reports`` they are written below that folder (JSON; lists of rows as Parquet), what is returned reads those
    files, and the intermediate data of the run is deleted. Without, they are computed when they are read.
    ``schemas`` gives a source's columns and types, so that its text is not read once more to infer them.
    """
    if reports is None:
        return _run(spark, spec, sources, fmt, publication, location, schemas, read_options)
    with scratch(spark):
        return write_reports(
            _run(spark, spec, sources, fmt, publication, location, schemas, read_options), reports, ("rejected", "excluded"))


def _run(spark, spec, sources, fmt, publication, location, schemas, read_options) -> dict[str, DataFrame]:
    layers = spec.layers
    catalog.create_layers(spark, layers.names(), location)
    manifest = ingest.ingest(
        spark, sources, layers.bronze, fmt, spec.known_sources, tuple(spec.known_sources.values()),
        schemas, **read_options)
    silver = standardize_layer(spark, spec.tables, layers)
    gold = star_layer(spark, spec.star, layers)
    if publication is not None:
        publish_jdbc(spark, publication.targets, publication.url, publication.properties, publication.schema)
    store = feature_layer(spark, spec.star, spec.features, layers, metrics=gold["metrics"])
    report = quality_report(
        silver["summary"], spark.table(f"{layers.silver}.{spec.star.dim_source}"),
        spark.table(f"{layers.silver}.{spec.star.fact_source}"), spec.star.key)
    return {
        "manifest": manifest, "quality": report, "rejected": silver["rejected"],
        "rule_counts": silver["counts"], "star_metrics": gold["metrics"], "star_gates": gold["gates"],
        "features": store["report"], "excluded": store["excluded"],
    }
