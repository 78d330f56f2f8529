"""Training of both variants with registry and gates; bulk inference with gates and comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluate, features as feature_ops, gnb, quality, registry, scoring
from ..operators.metrics import gate_status, union_all
from ..operators.model_selection import TrainedVariant, split_for, train_variant
from ..operators.registry import ModelId
from ..operators.split import StratifiedSplit
from ..sources import publish
from ..sources.staging import stage_observed

VARIANTS = (("without_smote", False), ("with_smote", True))


@dataclass(frozen=True)
class ModelSpec:
    """What is trained on which columns, and under which name it is kept."""

    key: str
    features: tuple[str, ...]
    label: str
    positive: str
    name: str
    version: str
    test_share: float = 0.2
    folds: int = 10
    neighbors: int = 5
    seed: int = 42

    def model_id(self, variant: str) -> ModelId:
        return ModelId(self.name, self.version, variant)


def load_training(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """The training table after its schema, leakage and key checks."""
    declared = T.StructType([T.StructField(c, T.StringType()) for c in [spec.key, *spec.features, spec.label]])
    feature_ops.check_schema(df, declared)
    feature_ops.check_leakage(df, spec.features, spec.key, labels=[spec.label])
    quality.require_unique_key(df, spec.key)
    quality.require_filled(df, [*spec.features, spec.label])
    return df


_FACTS = T.StructType([
    T.StructField("rows", T.LongType()), T.StructField("features_match", T.BooleanType()),
    T.StructField("label_matches", T.BooleanType()), T.StructField("leaking_columns", T.IntegerType()),
    T.StructField("test_rows", T.LongType()), T.StructField("folds", T.IntegerType()),
    T.StructField("cv_metrics", T.IntegerType()), T.StructField("holdout_accuracy", T.DoubleType()),
    T.StructField("confusion_total", T.LongType()), T.StructField("final_rows", T.LongType()),
    T.StructField("saved", T.BooleanType()), T.StructField("loaded", T.BooleanType()),
    T.StructField("smoke_ok", T.BooleanType()), T.StructField("has_scaler", T.BooleanType()),
])


@dataclass(frozen=True)
class VariantResult:
    variant: str
    trained: TrainedVariant
    gates: DataFrame
    status: str
    holdout: dict
    cv_summary: dict


def _one_variant(spark: SparkSession, df: DataFrame, spec: ModelSpec, split: StratifiedSplit, root: str,
                 variant: str, oversample: bool) -> VariantResult:
    v = train_variant(
        df, spec.key, spec.features, spec.label, spec.positive, variant, oversample,
        spec.test_share, spec.folds, spec.neighbors, spec.seed, split)
    cv = [r.asDict() for r in v.cv.collect()]  # one row per fold
    summary = {r["metric"]: {"mean": r["mean"], "std": r["std"]} for r in evaluate.fold_summary(
        spark.createDataFrame(cv, v.cv.schema)).collect()}
    confusion = [r.asDict() for r in v.confusion.collect()]
    holdout = evaluate.binary_metrics(
        spark.createDataFrame(confusion, v.confusion.schema), v.dev_model.labels, spec.positive).first().asDict()
    model_id = spec.model_id(variant)
    registry.save_model(spark, root, model_id, v.model, {
        "positive_class": spec.positive, "target_name": spec.label, "identifier_column": spec.key,
        "sampling": "SMOTE" if oversample else None, "cv_summary": summary, "holdout": holdout,
        "confusion": confusion, "folds": spec.folds, "test_share": spec.test_share, "seed": spec.seed,
    })
    model, metadata = registry.load_model(spark, root, model_id)
    registry.check_model(model, metadata, spec.features)
    smoke = evaluate.smoke_check(gnb.with_scores(
        split.with_part(df).filter("part = 'test'"), model), v.model.labels, spec.key).first()
    roles = feature_ops.model_roles(spec.features, spec.key, [spec.label])
    leaks = [c for c, verdict in feature_ops.column_verdicts(df.schema, roles) if verdict == "unexpected"]
    total = sum(split.counts.values())
    facts = spark.createDataFrame([(
        total, metadata["feature_names"] == list(spec.features), metadata["target_name"] == spec.label,
        len(leaks), total - sum(split.train.values()), len(cv), len(summary),
        holdout["accuracy"], sum(r["n"] for r in confusion),
        sum(v.model.count) if not oversample else (total if min(v.model.count) == max(v.model.count) else 0),
        registry.is_stored(spark, root, model_id, v.model), model == v.model, smoke["labels_known"], metadata["has_scaler"],
    )], _FACTS)
    gate_rows = evaluate.training_gates(facts, spec.folds, spec.test_share)
    status = gate_status(gate_rows).first()["status"]
    return VariantResult(variant, v, gate_rows, status, holdout, summary)


def train_variants(spark: SparkSession, df: DataFrame, spec: ModelSpec, root: str) -> dict:
    """Both variants on one split of a stored training table, saved, reloaded, gated and compared."""
    df = load_training(df, spec)
    split = split_for(df, spec.key, spec.label, spec.test_share, spec.folds, spec.seed, spec.neighbors)
    results = [_one_variant(spark, df, spec, split, root, name, flag) for name, flag in VARIANTS]
    names = tuple(r.variant for r in results)
    a, b = (spark.createDataFrame([r.holdout]) for r in results)
    means = [spark.createDataFrame([{m: s["mean"] for m, s in r.cv_summary.items()}]) for r in results]
    return {
        "variants": {r.variant: r for r in results},
        "holdout": evaluate.compare_variants(a, b, names),
        "cross_validation": evaluate.compare_variants(*means, names),
        "gates": union_all([r.gates.select(F.lit(r.variant).alias("variant"), "gate", "passed") for r in results]),
        "status": "SUCCESS" if all(r.status == "SUCCESS" for r in results) else "FAILED",
    }


def run_inference(
    spark: SparkSession, df: DataFrame, spec: ModelSpec, root: str, output: str,
    denied: Sequence[str] = (), smoke: bool = False, smoke_rows: int = 5,
    label_name: str = "prediction", probability_name: str = "probability",
) -> dict:
    """Score an inference table with both stored variants in one pass over it.

    Both models are scored in one projection, which is stored; what decides whether the input was fit is counted while
    it is written, and nothing is published before that is known. Predictions, comparison and counts of labels are read
    from the stored rows, without another scan of the input and without a join.

    Writes one Parquet folder per variant, the comparison, and below ``reports`` as JSON the gates, how far the
    variants agree, some keys on which they do not, and how often each label was given; what is returned reads those
    files. In smoke mode scores a few rows and writes nothing. The status follows from the gates.
    """
    if smoke:
        gates_in = scoring.require_scorable(df, spec.key, spec.features)
    else:
        scoring.require_columns(df, spec.key, spec.features)
    models = {}
    for variant, _ in VARIANTS:
        model, metadata = registry.load_model(spark, root, spec.model_id(variant))
        registry.check_model(model, metadata, spec.features)
        models[variant] = model
    if smoke:
        rows = [scoring.smoke_predictions(df, m, spec.key, smoke_rows).withColumn("variant", F.lit(v))
                for v, m in models.items()]
        return {"smoke": union_all(rows), "input_gates": gates_in, "status": "SMOKE_TEST_PASS"}
    variants, output = list(models), output.rstrip("/")
    joint, scored = stage_observed(
        scoring.joint_predictions(df, models, spec.key, spec.version), "scored",
        scoring.key_figures(spec.key) | scoring.null_figures(df, [spec.key, *spec.features]))
    distinct = joint.agg(F.count_distinct(spec.key).alias("n")).first()["n"]
    gates_in = scoring.require_passed(scoring.input_gates(
        scoring.counted_input(spark, scored, distinct, spec.key, spec.features), df.columns, spec.key, spec.features))
    required = [spec.key, *spec.features, label_name, "model_variant"]
    stored, checks = {}, []
    for variant in variants:
        predictions = scoring.variant_predictions(joint, spec.features, spec.key, variant, label_name, probability_name)
        stored[variant], written = publish.write_observed(
            predictions, f"{output}/prediction_result_{variant}",
            scoring.key_figures(spec.key) | scoring.null_figures(predictions, required))
        if all(written[c] == scored[c] for c in ("rows", "key_sum")):
            facts = scoring.written_facts(spark, written, scored, distinct, predictions.columns, required, denied)
        else:  # something was lost or repeated on the way: count exactly what
            facts = scoring.prediction_facts(stored[variant], df, spec.key, required, denied)
        checks.append(scoring.prediction_gates(facts).select(F.lit(variant).alias("variant"), "gate", "passed"))
    names = tuple(f"prediction_{v}" for v in variants)
    comparison = publish.write_files(
        joint.select(spec.key, *(F.col(f"`label:{v}`").alias(n) for v, n in zip(variants, names))), f"{output}/prediction_comparison")
    reports = publish.write_reports({
        "input_gates": gates_in, "gates": union_all(checks),
        **scoring.pair_reports(spark, joint, variants, names),
        "disagreeing_keys": scoring.disagreeing_keys(comparison, spec.key, *names),
    }, f"{output}/reports")
    return {
        "predictions": stored, "comparison": comparison, **reports,
        "status": gate_status(reports["gates"]).first()["status"],
    }


def predict_or_fallback(
    spark: SparkSession, df: DataFrame, spec: ModelSpec, root: str, variant: str, fallback: F.Column
) -> DataFrame:
    """Score a batch with the stored model, or by rule where no model is stored yet."""
    try:
        model, metadata = registry.load_model(spark, root, spec.model_id(variant))
    except registry.ModelNotFound:
        return df.withColumn("prediction", fallback).withColumn("source", F.lit("rule"))
    registry.check_model(model, metadata, spec.features)
    return gnb.with_scores(df, model).drop("prediction_index", "probabilities").withColumn("source", F.lit("model"))
