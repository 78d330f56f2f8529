"""Metrics of a classifier, all derived from one map-combined count of (actual, predicted)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import gates

METRICS = ("accuracy", "precision", "recall", "f1")


def confusion_cells(
    df: DataFrame, actual: str, predicted: str, labels: Sequence, groups: Sequence[str] = ()
) -> DataFrame:
    """``(groups..., actual, predicted, n)``: one row for each cell of the label grid that has rows.

    What lies outside the grid is told apart while counting: a filter before would be pushed below the scoring that
    computes ``predicted``, and compute it twice.
    """
    known = F.col(actual).isin(*labels) & F.col(predicted).isin(*labels)
    return df.groupBy(*groups, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count_if(known).alias("n")).filter("n > 0")


def _labels(df: DataFrame, labels: Sequence, name: str) -> DataFrame:
    """``(name_at, name)``: a row for each label, in order."""
    return df.sparkSession.range(1).select(F.posexplode(F.lit(list(labels))).alias(f"{name}_at", name))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence) -> DataFrame:
    """Long form ``(actual, predicted, n)``, the full grid in label order, empty cells included."""
    grid = _labels(df, labels, "actual").withColumn("__all", F.lit(list(labels))).select(
        "*", F.posexplode("__all").alias("predicted_at", "predicted"))
    cells = confusion_cells(df, actual, predicted, labels)
    return grid.join(cells, ["actual", "predicted"], "left").orderBy("actual_at", "predicted_at").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def _sum(condition: Column | None = None) -> Column:
    n = F.col("n") if condition is None else F.when(condition, F.col("n"))
    return F.coalesce(F.sum(n), F.lit(0)).cast("long")


def _scores(hit: Column, predicted: Column, support: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 when undefined."""
    return {"precision": _ratio(hit, predicted), "recall": _ratio(hit, support), "f1": _ratio(2 * hit, predicted + support)}


def binary_metrics(cells: DataFrame, labels: Sequence, positive, keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., accuracy, precision, recall, f1)``: accuracy over all cells, the others of the class ``positive``."""
    if positive not in labels:
        raise ValueError(f"{positive!r} is not one of the labels")
    actual, predicted = F.col("actual") == F.lit(positive), F.col("predicted") == F.lit(positive)
    sums = [
        _sum().alias("__all"), _sum(F.col("actual") == F.col("predicted")).alias("__right"), _sum(actual & predicted).alias("__hit"),
        _sum(predicted).alias("__predicted"), _sum(actual).alias("__support")]
    row = cells.groupBy(*keep).agg(*sums) if keep else cells.agg(*sums)
    m = {"accuracy": _ratio(F.col("__right"), F.col("__all"))} | _scores(*map(F.col, ("__hit", "__predicted", "__support")))
    return row.select(*keep, *[m[name].alias(name) for name in METRICS])


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """``(metric, mean, std)`` over folds; the deviation is the population one."""
    row = per_fold.agg(*[
        f(name).alias(f"{name}_{stat}") for name in METRICS for stat, f in (("mean", F.avg), ("std", F.stddev_pop))
    ])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(f"{n}_mean").alias("mean"), F.col(f"{n}_std").alias("std"))
        for n in METRICS
    ])))


def classification_report(cells: DataFrame, labels: Sequence) -> DataFrame:
    """``(label, precision, recall, f1, support)`` per class, then accuracy, macro and weighted averages.

    The accuracy row carries its value in ``f1`` only.
    """
    zero, right = F.lit(0).cast("long"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), right.alias("hit")),
        F.struct(F.col("predicted").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hit")))))
    summed = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    counted = _labels(cells, labels, "class").join(summed, "class", "left").na.fill(0, ["support", "predicted", "hit"])
    scores = _scores(F.col("hit"), F.col("predicted"), F.col("support"))
    names = F.lit([str(c) for c in labels])
    per_class = counted.select(
        F.get(names, F.col("class_at")).alias("label"), *[c.alias(n) for n, c in scores.items()], "support", "hit")
    none = F.lit(None).cast("double")
    total = per_class.agg(
        F.sum("support").alias("support"), F.sum("hit").alias("hit"),
        *[F.avg(n).alias(f"macro_{n}") for n in scores],
        *[_ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(f"weighted_{n}") for n in scores])
    averages = [("accuracy", none, none, _ratio(F.col("hit"), F.col("support")))] + [
        (f"{kind} avg", *[F.col(f"{kind}_{n}") for n in scores]) for kind in ("macro", "weighted")]
    summary = total.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("support"))
        for a, p, r, f in averages])))
    return per_class.drop("hit").unionByName(summary)


def compare_variants(first: DataFrame, second: DataFrame, names: tuple[str, str], tie: str = "seri") -> DataFrame:
    """``(metric, <first>, <second>, winner)`` from two one-row metric frames."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    a = first.select(F.inline(pairs)).withColumnRenamed("value", names[0])
    b = second.select(F.inline(pairs)).withColumnRenamed("value", names[1])
    winner = (
        F.when(F.col(names[0]) > F.col(names[1]), F.lit(names[0]))
        .when(F.col(names[1]) > F.col(names[0]), F.lit(names[1]))
        .otherwise(F.lit(tie))
    )
    return a.join(b, "metric").withColumn("winner", winner)


def smoke_check(scored: DataFrame, labels: Sequence, order_by: str, n: int = 5) -> DataFrame:
    """Whether the first ``n`` predictions all carry a known label."""
    few = scored.orderBy(order_by).limit(n)
    return few.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bool_and(F.col("prediction").isin(*labels)), F.lit(False)).alias("labels_known"),
    )


def training_gates(facts: DataFrame, folds: int, test_share: float) -> DataFrame:
    """Fourteen gates over one row of facts about a trained variant."""
    return gates(facts, {
        "dataset_read": F.col("rows") > 0,
        "feature_schema": F.col("features_match"),
        "label_schema": F.col("label_matches"),
        "no_leakage": F.col("leaking_columns") == 0,
        "holdout_share": F.col("test_rows") == F.ceil(F.lit(test_share) * F.col("rows")),
        "folds_complete": F.col("folds") == folds,
        "cv_metrics": F.col("cv_metrics") == len(METRICS),
        "holdout_scored": F.col("holdout_accuracy").isNotNull(),
        "confusion_matrix": F.col("confusion_total") == F.col("test_rows"),
        "final_model": F.col("final_rows") == F.col("rows"),
        "model_saved": F.col("saved"),
        "model_loaded": F.col("loaded"),
        "smoke_test": F.col("smoke_ok"),
        "no_scaler": ~F.col("has_scaler"),
    })
