"""Model registry: one Parquet folder per (name, version, variant) with parameters and metadata in the same rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .gnb import GaussianNB


class ModelNotFound(FileNotFoundError):
    pass


class ModelMismatch(ValueError):
    pass


@dataclass(frozen=True)
class ModelId:
    name: str
    version: str
    variant: str

    def folder(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.name}/{self.version}/{self.variant}"


def save_model(spark: SparkSession, root: str, model_id: ModelId, model: GaussianNB, metadata: dict | None = None) -> None:
    """Replace the stored model of this id. The metadata's class mapping is what later turns indexes
    into labels. Parameters and metadata are one write, so neither can be newer than the other."""
    record = {
        "feature_names": list(model.features),
        "class_mapping": {str(k): v for k, v in model.class_mapping().items()},
        "class_distribution": {str(c): n for c, n in zip(model.labels, model.count)},
        "training_rows": sum(model.count),
        "has_scaler": False,
        "preprocessing": [],
        **(metadata or {}),
    }
    model.to_frame(spark).coalesce(1).select(
        "*", F.lit(model_id.name).alias("model_name"), F.lit(model_id.version).alias("model_version"),
        F.lit(model_id.variant).alias("model_variant"), F.current_timestamp().alias("saved_at"),
        F.lit(json.dumps(record, default=str)).alias("metadata"),
    ).write.mode("overwrite").parquet(model_id.folder(root))


def load_model(spark: SparkSession, root: str, model_id: ModelId) -> tuple[GaussianNB, dict]:
    try:
        stored = spark.read.parquet(model_id.folder(root))
    except AnalysisException as error:
        raise ModelNotFound(f"no stored model {model_id}") from error
    rows = stored.collect()  # one for each class and feature
    return GaussianNB.from_rows(rows), json.loads(rows[0]["metadata"])


def is_stored(spark: SparkSession, root: str, model_id: ModelId, model: GaussianNB) -> bool:
    """Whether the folder holds a row for each class and feature of ``model``, under this id."""
    rows = spark.read.parquet(model_id.folder(root)).filter(
        (F.col("model_name") == model_id.name) & (F.col("model_version") == model_id.version)
        & (F.col("model_variant") == model_id.variant) & F.col("metadata").isNotNull())
    return rows.count() == len(model.labels) * len(model.features)


def check_model(model: GaussianNB, metadata: dict, features: Sequence[str]) -> None:
    """The stored model must use exactly these features in this order, its own mapping, and no scaler."""
    trained = metadata.get("feature_names") or []
    if list(trained) != list(features) or list(model.features) != list(features):
        raise ModelMismatch(f"model features {trained} differ from input features {list(features)}")
    if metadata.get("has_scaler", True):
        raise ModelMismatch("the stored model expects scaled features")
    if metadata.get("class_mapping") != {str(k): v for k, v in model.class_mapping().items()}:
        raise ModelMismatch("class mapping and parameters disagree")


def label_order(metadata: dict | None, default: Sequence[str]) -> list[str]:
    """Labels by index from stored metadata, or the default list when there is none."""
    mapping = (metadata or {}).get("class_mapping") or {}
    return [label for label, _ in sorted(mapping.items(), key=lambda kv: kv[1])] or list(default)
