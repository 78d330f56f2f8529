"""The earlier feature design."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import evaluate, features, gnb, history, profile, registry
from ..operators.split import random_split
from ..plans import modelling
from ..sources.staging import new_path, stage
from .bindings import FEATURES, KEY, LABEL, LATE, ON_TIME, SPEC, star, table, training
from .composite import MODEL
from .models import LABELS, holdout_cells, rounded, split_of
from .registry import check
from .sql import using

AS_OF = "2002-01-15"
_END = f"coalesce(l_shipdate::DATE, DATE '{AS_OF}')"
_MONTHS = f"""ceil((year({_END}) - year(o_orderdate)) * 12 + month({_END}) - month(o_orderdate)
  + CASE WHEN day({_END}) = day(o_orderdate)
           OR (last_day({_END}) = {_END} AND last_day(o_orderdate::DATE) = o_orderdate::DATE) THEN 0
         ELSE (day({_END}) - day(o_orderdate)) / 31.0 END)::INTEGER"""


def with_semesters(spark, d):
    months = history.study_months(F.col("o_orderdate"), F.col("l_shipdate"), F.lit(AS_OF).cast("date"))
    return star(spark, d).withColumn("months", months).withColumn("semester", history.semesters(F.col("months")))


@check("d1_study_months", using("star", f"SELECT o_orderkey, {_MONTHS} AS months FROM star"))
def study_months(spark, d):
    return with_semesters(spark, d).select(KEY, "months")


@check("d2_semesters", using("star", f"""
  SELECT semester, count(*)::BIGINT AS n FROM (SELECT ceil({_MONTHS} / 6.0)::INTEGER AS semester FROM star) GROUP BY 1"""))
def semesters(spark, d):
    return with_semesters(spark, d).groupBy("semester").agg(F.count(F.lit(1)).alias("n"))


@check("d3_credit_percent", """
  SELECT l_orderkey, round(sum(l_quantity) * 100.0 / (SELECT max(p_size) FROM part), 6) AS percent
  FROM lineitem GROUP BY 1""")
def credit_percent(spark, d):
    total = history.single_value(table(spark, d, "part").agg(F.max("p_size").alias("total")), "total")
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    return sums.select("l_orderkey", F.round(history.percent_of(F.col("q"), total), 6).alias("percent"))


@check("d4_semester_label", using("star", f"""
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN '' WHEN ceil({_MONTHS} / 6.0) <= 3 THEN 'On time'
                          ELSE 'Late' END AS label FROM star"""))
def semester_label(spark, d):
    finished = features.in_population("o_orderstatus", "F")
    label = history.semester_label(F.col("semester"), finished, ON_TIME, LATE, limit=3)
    return with_semesters(spark, d).select(KEY, F.coalesce(label, F.lit("")).alias("label"))


@check("d5_indexed_features", using("labelled", """
  , freq AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i
             FROM labelled GROUP BY 1)
  SELECT o_orderkey, i::DOUBLE AS priority_index, o_totalprice, order_day::DOUBLE AS order_day
  FROM labelled JOIN freq ON labelled.o_orderpriority = freq.o_orderpriority""").replace(")\n\n  , freq", "),\n freq"))
def indexed_features(spark, d):
    rows = stage(features.labelled_population(star(spark, d), SPEC), "labelled")
    fitted = history.feature_stages(["o_orderpriority"], ["o_totalprice", "order_day"]).fit(rows)
    values = vector_to_array("features")
    return fitted.transform(rows).select(KEY, *[
        F.get(values, F.lit(i)).alias(n) for i, n in enumerate(("priority_index", "o_totalprice", "order_day"))])


@check("d6_random_split", """
  SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 < 0.8
                          THEN 0 ELSE 1 END::INTEGER AS part FROM orders""")
def hash_random_split(spark, d):
    return random_split(table(spark, d, "orders"), KEY, [0.8, 0.2]).select(KEY, "part")


@check("d7_smoothing_search", using("fold_metrics", """
  SELECT unnest([0.1, 0.5, 1.0])::DOUBLE AS smoothing, round((SELECT avg(accuracy) FROM fold_metrics), 6) AS accuracy"""))
def smoothing_search(spark, d):
    rows = training(spark, d)
    folded = split_of(rows).with_fold(rows).filter("fold IS NOT NULL")
    encoded = gnb.encode(folded, LABEL, {LATE: 0, ON_TIME: 1})
    vectors = stage(history.feature_stages([], FEATURES).fit(encoded).transform(encoded).select(
        "features", "label_index", "fold"), "vectors")
    found = history.smoothing_search(vectors, "features", "label_index", "fold", folds=10)
    return rounded(found, "accuracy")


@check("d8_weighted_metrics", using("holdout_cells", """
  SELECT round((tn * 1.0 / nullif(tn + fn, 0) * (tn + fp) + tp * 1.0 / nullif(tp + fp, 0) * (tp + fn)) / n, 6) AS precision,
         round((tp + tn) * 1.0 / n, 6) AS recall,
         round((2.0 * tn / (2 * tn + fn + fp) * (tn + fp) + 2.0 * tp / (2 * tp + fp + fn) * (tp + fn)) / n, 6) AS f1
  FROM holdout_cells"""))
def weighted_metrics(spark, d):
    report = evaluate.classification_report(holdout_cells(spark, d), LABELS)
    return rounded(report.filter("label = 'weighted avg'").select("precision", "recall", "f1"), "precision", "recall", "f1")


@check("d9_roc_auc", using("full_fit", """
  SELECT round((sum(CASE WHEN actual = 'On time' THEN avg_rank ELSE 0 END) - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auc
  FROM (SELECT actual, first + (same - 1) / 2.0 AS avg_rank, p, n FROM (
          SELECT actual, rank() OVER (ORDER BY score) AS first, count(*) OVER (PARTITION BY score) AS same,
                 count(*) FILTER (actual = 'On time') OVER () AS p, count(*) OVER () AS n
          FROM (SELECT actual, CASE prediction WHEN 'On time' THEN probability ELSE 1 - probability END AS score
                FROM full_fit)))
  GROUP BY p, n"""))
def roc_auc(spark, d):
    rows = training(spark, d)
    scored = gnb.with_scores(rows, gnb.fit(rows, FEATURES, LABEL))
    scores = scored.select(LABEL, F.get("probabilities", F.lit(1)).alias("score"))
    points = history.roc_points(scores, "score", F.col(LABEL) == ON_TIME)
    return rounded(history.roc_auc(points), "auc")


@check("d10_dashboard", using("labelled", " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, {c}::VARCHAR AS value, count(*)::BIGINT AS n, "
    f"round(avg((label = 'On time')::INTEGER) * 100, 6) AS on_time_percent FROM labelled GROUP BY {c}"
    for c in ("o_orderpriority", "order_year", "label"))))
def dashboard(spark, d):
    rows = features.labelled_population(star(spark, d), SPEC)
    shown = profile.dashboard(rows, ["o_orderpriority", "order_year", "label"], F.col(LABEL) == ON_TIME)
    return rounded(shown, "on_time_percent")


@check("d10_histogram", """
  SELECT CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice >= 400000 THEN 8
              ELSE floor((o_totalprice - 50000) / 50000) + 1 END::BIGINT AS bin, count(*)::BIGINT AS n
  FROM orders GROUP BY 1""")
def histogram(spark, d):
    return profile.histogram(table(spark, d, "orders"), "o_totalprice", 50000, 400000, 7)


@check("d11_column_profile", using("star", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS rows, (count(*) - count({c}))::BIGINT AS nulls FROM star"
    for c in ("o_orderkey", "o_totalprice", "l_quantity", "l_shipdate"))))
def column_profile(spark, d):
    return profile.column_profile(star(spark, d).select("o_orderkey", "o_totalprice", "l_quantity", "l_shipdate"))


@check("d12_batch_or_rule", using("predicted star", f"""
  SELECT o_orderkey, prediction, 'model' AS source FROM predicted
  UNION ALL SELECT i.o_orderkey, CASE WHEN ceil({_MONTHS} / 6.0) <= 3 THEN 'On time' ELSE 'Late' END, 'rule'
  FROM star s JOIN infer i ON s.o_orderkey = i.o_orderkey"""))
def batch_or_rule(spark, d):
    root = new_path(spark, "registry")
    registry.save_model(spark, root, MODEL.model_id("plain"), gnb.fit(training(spark, d), FEATURES, LABEL))
    rows = features.complete_rows(SPEC.with_derived(with_semesters(spark, d)).filter("o_orderstatus = 'O'"), FEATURES)
    rule = history.fallback_label(F.col("semester"), ON_TIME, LATE, limit=3)
    scored = [modelling.predict_or_fallback(spark, rows, MODEL, root, v, rule).select(KEY, "prediction", "source")
              for v in ("plain", "absent")]
    return scored[0].unionByName(scored[1])


