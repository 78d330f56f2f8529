"""Labels with many values: split, folds and confusion grow with the rows, not with a branch per class."""

from collections import Counter

from pyspark.sql import functions as F

from gradus.operators import evaluate
from gradus.operators.split import fold_sizes, stratified_split, train_sizes
from gradus.sources.staging import stage


def many_classes(spark, n=6000, classes=300):
    return stage(spark.range(n, numPartitions=4).select(
        F.col("id").alias("k"), F.format_string("class %04d", F.col("id") % classes).alias("c")), "many-classes")


def test_split_and_folds_of_many_classes_are_exact(spark):
    rows = many_classes(spark)
    split = stratified_split(rows, "k", "c", folds=5)
    counts = {f"class {c:04d}": 20 for c in range(300)}
    assert split.counts == counts and split.train == train_sizes(counts, 0.2)
    assert split.folds == fold_sizes(split.train, 5)
    folded = split.with_fold(rows)
    got = Counter({(r["c"], r["fold"]): r["n"] for r in folded.groupBy("c", "fold").agg(F.count("*").alias("n")).collect()})
    for c in counts:
        assert [got[(c, f)] for f in range(5)] == list(split.folds[c])
        assert got[(c, None)] == 20 - split.train[c]
    wide = folded._jdf.queryExecution().optimizedPlan().toString()
    assert wide.count("CASE WHEN") <= 5


def test_rows_of_unknown_and_null_classes_are_in_no_fold(spark):
    rows = many_classes(spark, 200, 4)
    split = stratified_split(rows, "k", "c", folds=2)
    other = spark.createDataFrame([(1, "elsewhere"), (2, None)], "k long, c string")
    assert [r["fold"] for r in split.with_fold(other).collect()] == [None, None]


def test_confusion_of_many_classes_matches_counting(spark):
    rows = many_classes(spark).withColumn("p", F.when(F.col("k") % 3 == 0, F.lit("class 0001")).otherwise(F.col("c")))
    labels = [f"class {c:04d}" for c in range(300)]
    want = Counter((r["c"], r["p"]) for r in rows.collect())
    grid = evaluate.confusion_matrix(rows, "c", "p", labels).collect()
    assert [(r["actual"], r["predicted"]) for r in grid] == [(a, p) for a in labels for p in labels]
    assert {(r["actual"], r["predicted"]): r["n"] for r in grid if r["n"]} == dict(want)
    cells = evaluate.confusion_cells(rows, "c", "p", labels)
    report = {r["label"]: r for r in evaluate.classification_report(cells, labels).collect()}
    for label in labels:
        hit, support = want[(label, label)], 20
        predicted = sum(n for (_, p), n in want.items() if p == label)
        precision = hit / predicted if predicted else 0.0
        assert abs(report[label]["precision"] - precision) < 1e-12 and abs(report[label]["recall"] - hit / support) < 1e-12
        assert report[label]["support"] == support
    assert abs(report["accuracy"]["f1"] - sum(want[(c, c)] for c in labels) / 6000) < 1e-12
    m = evaluate.binary_metrics(cells, labels, "class 0001").first()
    assert abs(m["accuracy"] - report["accuracy"]["f1"]) < 1e-12 and abs(m["f1"] - report["class 0001"]["f1"]) < 1e-12


def test_confusion_without_rows_is_a_grid_of_zeros(spark):
    none = spark.createDataFrame([], "c string, p string")
    assert [r["n"] for r in evaluate.confusion_matrix(none, "c", "p", ["a", "b"]).collect()] == [0, 0, 0, 0]
    cells = evaluate.confusion_cells(none, "c", "p", ["a", "b"])
    assert evaluate.binary_metrics(cells, ["a", "b"], "a").first().asDict() == dict.fromkeys(evaluate.METRICS, 0.0)
    assert {r["label"]: r["support"] for r in evaluate.classification_report(cells, ["a", "b"]).collect()} == {
        "a": 0, "b": 0, "accuracy": 0, "macro avg": 0, "weighted avg": 0}
