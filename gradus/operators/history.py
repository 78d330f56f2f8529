"""Earlier feature design: months of study, semesters, credit share, Spark ML features and search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import stage
from . import gnb
from .quality import InvalidDataset


def study_months(start: Column, end: Column, as_of: Column) -> Column:
    """Started months between ``start`` and ``end`` (``as_of`` while there is no end)."""
    return F.ceil(F.months_between(F.coalesce(end, as_of).cast("date"), start.cast("date"))).cast("int")


def semesters(months: Column) -> Column:
    return F.ceil(months / 6).cast("int")


def semester_label(semester: Column, applies: Column, on_time: str, late: str, limit: int = 8) -> Column:
    """``on_time`` up to the limit, ``late`` beyond; NULL where it does not apply or is unknown."""
    return F.when(applies & (semester <= limit), F.lit(on_time)).when(applies & (semester > limit), F.lit(late))


def single_value(df: DataFrame, column: str):
    """The one value of a constants table; anything else than exactly one is an error."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(2).collect()
    if len(values) != 1:
        raise InvalidDataset(f"{column} must have exactly one value")
    return values[0][0]


def percent_of(value: Column, total) -> Column:
    return F.try_divide(value, F.lit(total)) * 100


def fallback_label(semester: Column, on_time: str, late: str, limit: int = 8) -> Column:
    """Rule used when no model is stored."""
    return F.when(semester <= limit, F.lit(on_time)).otherwise(F.lit(late))


# --------------------------------------------------------------------------------- Spark ML path

def feature_stages(categorical: Sequence[str], numeric: Sequence[str], output: str = "features") -> Pipeline:
    """Index categories (unseen ones get their own index), assemble one vector."""
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in categorical]
    inputs = [*[f"{c}_index" for c in categorical], *numeric]
    return Pipeline(stages=[*indexers, VectorAssembler(inputCols=inputs, outputCol=output)])


def score_with_stored(df: DataFrame, features: PipelineModel, classifier) -> DataFrame:
    """Feature stages fitted on the training data, then the stored classifier."""
    return classifier.transform(features.transform(df))


def smoothing_search(
    df: DataFrame, features_col: str, label_col: str, fold_col: str, folds: int, grid: Sequence[float] = (0.1, 0.5, 1.0),
) -> DataFrame:
    """``(smoothing, accuracy)``: mean accuracy over user-given folds for every grid value.

    Smoothing adds to counts, and a Gaussian model has none but the class sizes, which Spark's estimator leaves as they
    are: every value of the grid stands for the same model. So a fold is fitted once, from the merged moments of the
    others, and one pass over the stored vectors scores all folds. Folds that are empty or out of range are refused.
    """
    width = df.select(F.size(vector_to_array(features_col)).alias("n")).first()
    if width is None:
        raise InvalidDataset("no rows to search on")
    names = [f"feature_{i}" for i in range(width["n"])]
    rows = df.select(F.col(label_col).alias("label"), F.col(fold_col).cast("int").alias("fold"), vector_to_array(features_col).alias("values")).select(
        "label", "fold", *(F.get("values", F.lit(i)).alias(n) for i, n in enumerate(names)))
    stats = gnb.moments(rows, names, ["fold", "label"])
    present = {f for f, _ in stats}
    if present != set(range(folds)):
        raise InvalidDataset(f"folds 0 to {folds - 1} expected")
    models = gnb.fit_folds(stats, range(folds), names)
    scored = gnb.with_scores(rows, models, "fold")
    right = scored.groupBy("fold").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
    smoothing = F.explode(F.lit([float(g) for g in grid]).cast("array<double>")).alias("smoothing")
    return right.agg(F.avg("accuracy").alias("accuracy")).select(smoothing, "accuracy")


# ------------------------------------------------------------------------------------------- ROC

def roc_points(scored: DataFrame, score: str, positive: Column, buckets: int | None = None) -> DataFrame:
    """``(threshold, tp, fp, n_pos, n_neg)`` for every distinct score, highest first.

    Counts per distinct score are cumulated in two levels: buckets of similar size, cut at sketched
    quantiles of the scores, have their totals summed up; inside a bucket the running sum starts from
    the total above it. No step orders the whole data in one task. By default a bucket has about 65,536 scores; there
    are at most 4096 buckets, so beyond some 268 million distinct scores they grow.
    """
    per_score = stage(scored.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")), "roc")
    buckets = buckets or min(4096, -(-per_score.count() // 65536))
    quantiles = [i / buckets for i in range(1, buckets)]
    bounds = per_score.agg(F.percentile_approx("threshold", quantiles, 10000).alias("b")).first()["b"] or [] if quantiles else []
    bounds = sorted(set(bounds))
    bucket = F.size(F.filter(F.lit(bounds).cast("array<double>"), lambda b: b < F.col("threshold"))) if bounds else F.lit(0)
    placed = per_score.withColumn("bucket", bucket)
    above = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = placed.groupBy("bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        "bucket",  # at most `buckets` rows from here on
        F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"),
        F.sum("p").over(everywhere).alias("n_pos"), F.sum("n").over(everywhere).alias("n_neg"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.col("threshold").desc())
    return placed.join(offsets, "bucket").select(
        "threshold", "pos", "neg",
        (F.col("p0") + F.sum("pos").over(inside)).alias("tp"),
        (F.col("n0") + F.sum("neg").over(inside)).alias("fp"),
        "n_pos", "n_neg",
    )


def roc_auc(points: DataFrame) -> DataFrame:
    """Exact area under the curve, ties counted half; NULL when a class is absent."""
    below = F.col("n_neg") - F.col("fp")
    won = F.col("pos").cast("double") * (below.cast("double") + F.col("neg") / 2.0)
    return points.agg(F.sum(won).alias("w"), F.max("n_pos").alias("p"), F.max("n_neg").alias("n")).select(
        F.try_divide(F.col("w"), F.col("p").cast("double") * F.col("n")).alias("auc"))
