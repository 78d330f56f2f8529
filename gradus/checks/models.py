"""Split, resampling, model, metrics, scoring and UDF-like columns."""

from __future__ import annotations

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..operators import evaluate, features, gnb, history, registry, resample, scoring
from ..operators.metrics import melt
from ..operators.model_selection import cross_validate, fit_variant, holdout, split_for
from ..operators.quality import validate_labelled
from ..operators.registry import ModelId
from ..operators.split import stratified_split
from ..sources.staging import new_path, stage
from .bindings import FEATURES, KEY, LABEL, LATE, ON_TIME, SPEC, inference, populations, table, training
from .registry import check
from .sql import using

LABELS = (LATE, ON_TIME)
METRIC_COLUMNS = ", ".join(f"round({m}, 6) AS {m}" for m in evaluate.METRICS)


def rounded(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def split_of(rows, oversample=False):
    return split_for(rows, KEY, LABEL) if oversample else stratified_split(rows, KEY, LABEL)


@check("m1_validated_training_set", using("train", """
  SELECT 'training' AS subject, m AS metric, v::BIGINT AS value FROM (
    SELECT unnest(['rows', 'distinct_keys', 'duplicate_keys', 'null_label']) AS m,
           unnest([count(*), count(DISTINCT o_orderkey), 0, 0]) AS v FROM train)"""))
def validated_training_set(spark, d):
    rows = training(spark, d, stored=False)
    features.check_leakage(rows, FEATURES, KEY, SPEC.denied, [LABEL])
    report = validate_labelled(rows, KEY, FEATURES, LABEL)
    return melt(report.select("rows", "distinct_keys", "duplicate_keys", "null_label"), "training")


@check("m2_target_encoding", using("train", """
  SELECT o_orderkey, CASE label WHEN 'Late' THEN 0 ELSE 1 END::INTEGER AS label_index FROM train"""))
def target_encoding(spark, d):
    rows = training(spark, d)
    mapping = gnb.target_encoding(r[LABEL] for r in rows.select(LABEL).distinct().collect())
    return gnb.encode(rows, LABEL, mapping).select(KEY, "label_index")


@check("m3_index_to_label", using("predicted", "SELECT o_orderkey, prediction FROM predicted"))
def index_to_label(spark, d):
    rows, open_rows = populations(spark, d)
    model = gnb.fit(rows, FEATURES, LABEL)
    scored = gnb.with_scores(open_rows, model).drop("prediction")
    return gnb.decode(scored, "prediction_index", model.class_mapping()).select(KEY, "prediction")


@check("m4_stratified_split", using("parts", "SELECT o_orderkey, label, part FROM parts"))
def stratified_holdout(spark, d):
    rows = training(spark, d)
    return split_of(rows).with_part(rows).select(KEY, LABEL, "part")


@check("m5_stratified_folds", using("folded", "SELECT o_orderkey, label, fold FROM folded"))
def stratified_folds(spark, d):
    rows = training(spark, d)
    return split_of(rows).with_fold(rows).filter("fold IS NOT NULL").select(KEY, LABEL, "fold")


def params_sql(model: str) -> str:
    parts = [
        f"SELECT label, '{f}' AS feature, n::BIGINT AS n, round(prior, 6) AS prior, round(m{i}, 6) AS mean, "
        f"round(v{i} / pow(10, greatest(0, floor(log10(v{i})))), 6) AS var_mantissa FROM {model}"
        for i, f in enumerate(FEATURES, 1)
    ]
    return " UNION ALL ".join(parts)


def params_frame(model, spark):
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.floor(F.log10("var")).cast("double")))
    return model.to_frame(spark).select(
        "label", "feature", "n", F.round("prior", 6).alias("prior"), F.round("mean", 6).alias("mean"),
        F.round(F.col("var") / scale, 6).alias("var_mantissa"))


@check("m6_gnb_fit", using("full_model", params_sql("full_model")))
def gnb_fit(spark, d):
    return params_frame(gnb.fit(training(spark, d), FEATURES, LABEL), spark)


@check("m7_predicted_class", using("full_fit", "SELECT o_orderkey, prediction FROM full_fit"))
def predicted_class(spark, d):
    rows = training(spark, d)
    return gnb.with_scores(rows, gnb.fit(rows, FEATURES, LABEL)).select(KEY, "prediction")


@check("m8_predicted_probability", using("predicted", """
  SELECT o_orderkey, prediction, round(probability, 6) AS probability FROM predicted"""))
def predicted_probability(spark, d):
    rows, open_rows = populations(spark, d)
    return gnb.with_scores(open_rows, gnb.fit(rows, FEATURES, LABEL)).select(
        KEY, "prediction", F.round(gnb.predicted_probability(), 6).alias("probability"))


@check("m9_smote_rows", using("synthetic", """
  SELECT origin, neighbor, copy::INTEGER AS copy, round(gap, 6) AS gap, round(l_quantity, 6) AS l_quantity,
         round(l_extendedprice, 4) AS l_extendedprice, round(order_year, 6) AS order_year,
         round(order_day, 6) AS order_day FROM synthetic"""))
def smote_rows(spark, d):
    rows = resample.smote(training(spark, d), KEY, LABEL, FEATURES).drop(LABEL)
    return rounded(rounded(rows, "gap", "l_quantity", "order_year", "order_day"), "l_extendedprice", digits=4)


@check("m9_smote_class_counts", using("balanced", "SELECT label, count(*)::BIGINT AS n FROM balanced GROUP BY 1"))
def smote_class_counts(spark, d):
    rows = training(spark, d)
    both = resample.balanced(rows, resample.smote(rows, KEY, LABEL, FEATURES), FEATURES, LABEL)
    return both.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))


@check("m10_smote_per_fold", using("synthetic_rounds", """
  SELECT fold::INTEGER AS held_out, count(*)::BIGINT AS n, sum(neighbor)::BIGINT AS neighbors,
         round(sum(gap), 4) AS gaps, round(avg(order_day), 4) AS order_day FROM synthetic_rounds GROUP BY 1"""))
def smote_per_fold(spark, d):
    rows = training(spark, d)
    split = split_of(rows, True)
    folded = stage(split.with_fold(rows).filter("fold IS NOT NULL"), "folded")
    return resample.smote_folds(folded, split, FEATURES).groupBy("held_out").agg(
        F.count(F.lit(1)).alias("n"), F.sum("neighbor").alias("neighbors"), F.round(F.sum("gap"), 4).alias("gaps"),
        F.round(F.avg("order_day"), 4).alias("order_day"))


@check("m11_cross_validation", using("fold_metrics", f"SELECT fold::INTEGER AS fold, {METRIC_COLUMNS} FROM fold_metrics"))
def cross_validation(spark, d):
    rows = training(spark, d)
    return rounded(cross_validate(rows, split_of(rows), FEATURES, ON_TIME, False), *evaluate.METRICS)


@check("m11_cross_validation_smote", using(
    "smote_fold_metrics", f"SELECT fold::INTEGER AS fold, {METRIC_COLUMNS} FROM smote_fold_metrics"))
def cross_validation_smote(spark, d):
    rows = training(spark, d)
    return rounded(cross_validate(rows, split_of(rows, True), FEATURES, ON_TIME, True), *evaluate.METRICS)


def holdout_cells(spark, d, oversample=False):
    rows = training(spark, d)
    model, scored = holdout(rows, split_of(rows, oversample), FEATURES, oversample)
    return evaluate.confusion_cells(scored, LABEL, "prediction", model.labels)


@check("m12_binary_metrics", using("holdout_metrics", f"SELECT {METRIC_COLUMNS} FROM holdout_metrics"))
def binary_metrics(spark, d):
    return rounded(evaluate.binary_metrics(holdout_cells(spark, d), LABELS, ON_TIME), *evaluate.METRICS)


@check("m13_confusion_matrix", using("holdout_cells", """
  SELECT 'Late' AS actual, 'Late' AS predicted, tn::BIGINT AS n FROM holdout_cells
  UNION ALL SELECT 'Late', 'On time', fp FROM holdout_cells
  UNION ALL SELECT 'On time', 'Late', fn FROM holdout_cells
  UNION ALL SELECT 'On time', 'On time', tp FROM holdout_cells"""))
def confusion_matrix(spark, d):
    rows = training(spark, d)
    model, scored = holdout(rows, split_of(rows), FEATURES, False)
    return evaluate.confusion_matrix(scored, LABEL, "prediction", model.labels)


REPORT_SQL = """
  SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, n::BIGINT AS support FROM (
    WITH c AS (
      SELECT 'Late' AS label, tn * 1.0 / nullif(tn + fn, 0) AS p, tn * 1.0 / nullif(tn + fp, 0) AS r,
             2.0 * tn / nullif(2 * tn + fn + fp, 0) AS f, tn + fp AS n FROM holdout_cells
      UNION ALL
      SELECT 'On time', tp * 1.0 / nullif(tp + fp, 0), tp * 1.0 / nullif(tp + fn, 0),
             2.0 * tp / nullif(2 * tp + fp + fn, 0), tp + fn FROM holdout_cells)
    SELECT label, coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce(f, 0) AS f, n FROM c
    UNION ALL SELECT 'accuracy', -1, -1, (tp + tn) * 1.0 / n, n FROM holdout_cells
    UNION ALL SELECT 'macro avg', avg(coalesce(p, 0)), avg(coalesce(r, 0)), avg(coalesce(f, 0)), sum(n) FROM c
    UNION ALL SELECT 'weighted avg', sum(coalesce(p, 0) * n) / sum(n), sum(coalesce(r, 0) * n) / sum(n),
                     sum(coalesce(f, 0) * n) / sum(n), sum(n) FROM c)"""


@check("m14_classification_report", using("holdout_cells", REPORT_SQL))
def classification_report(spark, d):
    report = evaluate.classification_report(holdout_cells(spark, d), LABELS).na.fill(-1.0, ["precision", "recall"])
    return rounded(report, "precision", "recall", "f1")


@check("m15_holdout_predictions", using("holdout", """
  SELECT o_orderkey, actual AS label, prediction, round(probability, 6) AS probability FROM holdout"""))
def holdout_predictions(spark, d):
    rows = training(spark, d)
    _, scored = holdout(rows, split_of(rows), FEATURES, False)
    return scored.select(KEY, LABEL, "prediction", F.round(gnb.predicted_probability(), 6).alias("probability"))


@check("m15_holdout_smote", using("smote_metrics", f"SELECT {METRIC_COLUMNS} FROM smote_metrics"))
def holdout_smote(spark, d):
    cells = holdout_cells(spark, d, oversample=True)
    return rounded(evaluate.binary_metrics(cells, LABELS, ON_TIME), *evaluate.METRICS)


@check("m16_final_refit_smote", using("smote_model", params_sql("smote_model")))
def final_refit(spark, d):
    return params_frame(fit_variant(training(spark, d), KEY, FEATURES, LABEL, oversample=True), spark)


def stored_model(spark, d):
    """A model saved twice under one id (the second save replaces the first), and loaded."""
    root, model_id = new_path(spark, "registry"), ModelId("delivery", "v2", "plain")
    rows = training(spark, d)
    registry.save_model(spark, root, model_id, gnb.fit(rows.filter("order_year < 1998"), FEATURES, LABEL))
    registry.save_model(spark, root, model_id, gnb.fit(rows, FEATURES, LABEL), {"positive_class": ON_TIME})
    return registry.load_model(spark, root, model_id)


@check("m17_registry_roundtrip", using("full_model", params_sql("full_model")))
def registry_roundtrip(spark, d):
    return params_frame(stored_model(spark, d)[0], spark)


@check("m18_registry_metadata", using("train", """
  SELECT label, CASE label WHEN 'Late' THEN 0 ELSE 1 END::INTEGER AS label_index, count(*)::BIGINT AS n,
         'On time' AS positive_class FROM train GROUP BY label"""))
def registry_metadata(spark, d):
    _, metadata = stored_model(spark, d)
    rows = [(c, i, metadata["class_distribution"][c], metadata["positive_class"])
            for c, i in metadata["class_mapping"].items()]
    return spark.createDataFrame(rows, "label string, label_index int, n bigint, positive_class string")


@check("m19_model_consistency", using("full_model", """
  SELECT 'same_features' AS "case", true AS accepted FROM (SELECT count(*) FROM full_model)
  UNION ALL SELECT 'other_order', false UNION ALL SELECT 'missing_feature', false
  UNION ALL SELECT 'scaled', false"""))
def model_consistency(spark, d):
    model, metadata = stored_model(spark, d)
    cases = {
        "same_features": (FEATURES, metadata), "other_order": (FEATURES[::-1], metadata),
        "missing_feature": (FEATURES[:-1], metadata), "scaled": (FEATURES, {**metadata, "has_scaler": True}),
    }
    rows = []
    for name, (names, stored) in cases.items():
        try:
            registry.check_model(model, stored, names)
            rows.append((name, True))
        except registry.ModelMismatch:
            rows.append((name, False))
    return spark.createDataFrame(rows, "case string, accepted boolean")


@check("m20_smoke_prediction", using("holdout", """
  SELECT least(count(*), 5)::BIGINT AS rows, true AS labels_known FROM holdout"""))
def smoke_prediction(spark, d):
    rows = training(spark, d)
    model, scored = holdout(rows, split_of(rows), FEATURES, False)
    return evaluate.smoke_check(scored, model.labels, KEY)


@check("m22_variant_comparison", using("holdout_metrics smote_metrics", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(a.{m}, 6) AS plain, round(b.{m}, 6) AS smote, "
    f"CASE WHEN a.{m} > b.{m} THEN 'plain' WHEN b.{m} > a.{m} THEN 'smote' ELSE 'seri' END AS winner "
    f"FROM holdout_metrics a, smote_metrics b" for m in evaluate.METRICS)))
def variant_comparison(spark, d):
    rows = training(spark, d)
    split = split_of(rows, True)
    frames = []
    for oversample in (False, True):
        model, scored = holdout(rows, split, FEATURES, oversample)
        frames.append(evaluate.binary_metrics(
            evaluate.confusion_cells(scored, LABEL, "prediction", model.labels), LABELS, ON_TIME))
    return rounded(evaluate.compare_variants(*frames, ("plain", "smote")), "plain", "smote")


@check("m23_batch_predictions", using("predicted", """
  SELECT p.o_orderkey, l_quantity, l_extendedprice, order_year, order_day, prediction,
         round(probability, 6) AS probability, 'v2' AS model_version, 'plain' AS model_variant, true AS timed
  FROM predicted p JOIN infer i ON p.o_orderkey = i.o_orderkey"""))
def batch_predictions(spark, d):
    rows, open_rows = populations(spark, d)
    rows = scoring.batch_predictions(open_rows, gnb.fit(rows, FEATURES, LABEL), KEY, "v2", "plain")
    timed = F.col("prediction_timestamp").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$")
    return rounded(rows.withColumn("timed", timed).drop("prediction_timestamp"), "probability")


@check("m24_comparison_table", using("compared", "SELECT * FROM compared"))
def comparison_table(spark, d):
    rows, open_rows = populations(spark, d)
    a, b = (scoring.batch_predictions(open_rows, fit_variant(rows, KEY, FEATURES, LABEL, s), KEY, "v2", str(s))
            for s in (False, True))
    return scoring.comparison_table(a, b, KEY)


@check("m25_smoke_mode", using("predicted", """
  SELECT o_orderkey, prediction, round(probability, 6) AS probability FROM predicted ORDER BY o_orderkey LIMIT 5"""))
def smoke_mode(spark, d):
    rows, open_rows = populations(spark, d)
    model = gnb.fit(rows, FEATURES, LABEL)
    return rounded(scoring.smoke_predictions(open_rows, model, KEY, 0), "probability")


def spark_ml_scored(spark, d):
    """The same model through Spark ML: assembled vectors and its Gaussian classifier."""
    rows, open_rows = populations(spark, d)
    stages = history.feature_stages([], FEATURES).fit(rows)
    encoded = stages.transform(gnb.encode(rows, LABEL, {LATE: 0, ON_TIME: 1}))
    model = NaiveBayes(modelType="gaussian", labelCol="label_index").fit(encoded)
    return history.score_with_stored(open_rows, stages, model)


@check("m26_spark_ml_scoring", using("predicted", "SELECT o_orderkey, prediction FROM predicted"))
def spark_ml_scoring(spark, d):
    return spark_ml_scored(spark, d).select(
        KEY, scoring.label_of_index(F.col("prediction"), LABELS, LATE).alias("prediction"))


@check("m27_label_order", using("train", """
  SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS label_index, 'stored' AS origin
  FROM (SELECT DISTINCT label FROM train) UNION ALL VALUES ('x', 0, 'default'), ('y', 1, 'default')"""))
def label_order(spark, d):
    _, metadata = stored_model(spark, d)
    rows = [(c, i, "stored") for i, c in enumerate(registry.label_order(metadata, ["x", "y"]))]
    rows += [(c, i, "default") for i, c in enumerate(registry.label_order(None, ["x", "y"]))]
    return spark.createDataFrame(rows, "label string, label_index int, origin string")


@check("f1_label_of_index", """
  SELECT l_orderkey, l_linenumber, l_discount, CASE trunc(l_quantity / 25)::INTEGER WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'other' END AS size
  FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT l_orderkey, l_linenumber, l_discount, 'other' FROM lineitem WHERE l_returnflag = 'N'
  UNION ALL SELECT l_orderkey, l_linenumber, l_discount, 'large' FROM lineitem WHERE l_returnflag = 'R'""")
def label_of_index(spark, d):
    index = F.when(F.col("l_returnflag") == "A", F.col("l_quantity") / 25).when(
        F.col("l_returnflag") == "R", F.lit(-1.0)).when(F.col("l_tax") > 0.04, F.lit(float("nan")))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount",
        scoring.label_of_index(index, ["small", "large"], "other").alias("size"))


@check("f2_vector_to_array", using("infer", """
  SELECT o_orderkey, 4::INTEGER AS size, l_quantity + l_extendedprice + order_year + order_day AS total,
         0::INTEGER AS size_of_null FROM infer"""))
def vector_to_array(spark, d):
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(inference(spark, d))
    values = scoring.vector_values(F.col("v"))
    none = scoring.vector_values(F.when(F.col(KEY) < 0, F.col("v")))
    return rows.select(
        KEY, F.size(values).alias("size"),
        F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(none).alias("size_of_null"))
