"""Split, neighbours, oversampling, classifier and metrics against independent calculations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradus.checks.bindings import FEATURES, KEY, LABEL, ON_TIME, inference, training
from gradus.operators import evaluate, gnb, history, neighbors, resample, scoring
from gradus.operators import model_selection as ms
from gradus.operators.quality import InvalidDataset
from gradus.operators.split import fold_sizes, random_split, stratified_split, train_sizes
from gradus.sources.staging import stage

# figures computed outside this project's Spark code, per scale: (training rows matrix, holdout matrix)
GOLDEN = {
    "0.001": ([156, 31, 32, 41], [23, 14, 4, 11]),
    "0.01": ([1590, 195, 443, 259], [321, 36, 85, 56]),
    "0.1": ([16737, 1802, 4251, 2458], [3344, 364, 869, 473]),
}


def matrix(df, labels):
    return [r["n"] for r in evaluate.confusion_matrix(df, LABEL, "prediction", labels).collect()]


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_golden_matrices(spark, scale):
    rows = training(spark, f"/root/testdata/sf{scale}")
    model = gnb.fit(rows, FEATURES, LABEL)
    assert matrix(gnb.with_scores(rows, model), model.labels) == GOLDEN[scale][0]
    split = stratified_split(rows, KEY, LABEL)
    dev, scored = ms.holdout(rows, split, FEATURES, oversample=False)
    assert matrix(scored, dev.labels) == GOLDEN[scale][1]


def test_sizes():
    assert train_sizes({"Late": 1785, "On time": 702}, 0.2) == {"Late": 1428, "On time": 561}
    assert train_sizes({"a": 5, "b": 5}, 0.5) == {"a": 3, "b": 2} or sum(train_sizes({"a": 5, "b": 5}, 0.5).values()) == 5
    sizes = fold_sizes({"a": 23, "b": 17}, 10)
    assert sum(sizes["a"]) == 23 and sum(sizes["b"]) == 17
    for c, n in (("a", 23), ("b", 17)):
        assert set(sizes[c]) <= {n // 10, n // 10 + 1}
    totals = [a + b for a, b in zip(sizes["a"], sizes["b"])]
    assert max(totals) - min(totals) <= 1


def labelled(spark, n=500, parts=4):
    return spark.range(n, numPartitions=parts).select(
        F.col("id").alias("k"), F.when(F.col("id") % 7 < 2, "x").otherwise("y").alias("c"))


def test_split_does_not_depend_on_partitions(spark):
    splits = [stratified_split(labelled(spark, parts=p), "k", "c") for p in (1, 9)]
    assert splits[0].cuts == splits[1].cuts
    df = labelled(spark)
    got = {(r["c"], r["fold"]): r["n"] for r in splits[0].with_fold(df).groupBy("c", "fold").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    for c in ("x", "y"):
        assert [got[(c, f)] for f in range(10)] == splits[0].folds[c]
        assert got[(c, None)] == splits[0].counts[c] - splits[0].train[c]
    assert sum(n for (c, f), n in got.items() if f is None) == 100
    parts = splits[0].with_part(df).join(splits[0].with_fold(df), ["k", "c"])
    assert parts.filter("(part = 'train') <> (fold IS NOT NULL)").count() == 0


def test_split_needs_two_rows_per_class(spark):
    with pytest.raises(InvalidDataset):
        stratified_split(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "k int, c string"), "k", "c")


def test_random_split_is_stable(spark):
    a = random_split(spark.range(1000, numPartitions=3), "id", [0.8, 0.2]).groupBy("part").count().collect()
    assert sorted(r["count"] for r in a) == sorted(
        r["count"] for r in random_split(spark.range(1000, numPartitions=8), "id", [0.8, 0.2]).groupBy("part").count().collect())
    assert 750 < max(r["count"] for r in a) < 850


def brute_force(pdf, k, features, without_fold=None):
    x, keys, folds = pdf[features].to_numpy(float), pdf["id"].to_numpy(), pdf["fold"].to_numpy()
    out = {}
    for i in range(len(x)):
        gap = (x - x[i]) ** 2
        d2 = gap[:, 0]
        for j in range(1, x.shape[1]):
            d2 = d2 + gap[:, j]
        order = [j for j in np.lexsort((keys, d2)) if keys[j] != keys[i] and folds[j] != without_fold]
        out[keys[i]] = [keys[j] for j in order[:k]]
    return out


@pytest.fixture(scope="module")
def crowd(spark):
    """A third of the points on one spot, some on a lattice, some far out."""
    rng = np.random.default_rng(7)
    n = 1200
    x = np.column_stack([rng.normal(0, 100, n), rng.integers(0, 9, n), rng.exponential(4, n)])
    x[:400] = 5
    x[400:700] = np.round(x[400:700] / 50)
    x[700:706] *= 1000
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["id"] = rng.permutation(n)
    pdf["fold"] = pdf["id"] % 5
    return pdf, stage(spark.createDataFrame(pdf))


@pytest.mark.parametrize("cell_rows", [5000, 150, 40])
def test_neighbors_are_exact(crowd, cell_rows):
    pdf, df = crowd
    found = neighbors.nearest_neighbors(df, "id", ["a", "b", "c"], 5, cell_rows=cell_rows)
    got = {r["id"]: list(r["key"]) for r in found.select("id", "neighbors.key").collect()}
    assert got == brute_force(pdf, 5, ["a", "b", "c"])


@pytest.mark.parametrize("cell_rows", [5000, 150])
def test_neighbors_survive_losing_a_fold(crowd, cell_rows):
    pdf, df = crowd
    found = neighbors.nearest_neighbors(df, "id", ["a", "b", "c"], 5, fold="fold", cell_rows=cell_rows)
    for f in (0, 3):
        near = neighbors.outside_fold(F.col("neighbors"), F.lit(f), 5)
        got = {r["id"]: list(r["n"]) for r in found.select("id", near.getField("key").alias("n")).collect()}
        assert got == brute_force(pdf, 5, ["a", "b", "c"], f)


def test_hot_spots_are_joined_apart(crowd, monkeypatch):
    pdf, df = crowd
    monkeypatch.setattr(neighbors, "_HOT_SPOT_ROWS", 100)
    found = neighbors.nearest_neighbors(df, "id", ["a", "b", "c"], 5)
    got = {r["id"]: list(r["key"]) for r in found.select("id", "neighbors.key").collect()}
    assert got == brute_force(pdf, 5, ["a", "b", "c"])


def test_many_visitors_are_chunked(crowd, monkeypatch):
    pdf, df = crowd
    monkeypatch.setattr(neighbors, "_VISITORS", 7)
    found = neighbors.nearest_neighbors(df, "id", ["a", "b", "c"], 5, cell_rows=100)
    got = {r["id"]: list(r["key"]) for r in found.select("id", "neighbors.key").collect()}
    assert got == brute_force(pdf, 5, ["a", "b", "c"])


def test_smote_balances_on_segments(spark, sf):
    rows = training(spark, sf)
    synthetic = resample.smote(rows, KEY, LABEL, FEATURES).toPandas()
    counts = {r[LABEL]: r["n"] for r in rows.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(synthetic) == counts["Late"] - counts["On time"] and set(synthetic[LABEL]) == {"On time"}
    base = rows.toPandas().set_index(KEY)
    a, b = base.loc[synthetic["origin"]], base.loc[synthetic["neighbor"]]
    assert set(a[LABEL]) == set(b[LABEL]) == {"On time"}
    for f in FEATURES:
        want = a[f].to_numpy() + synthetic["gap"].to_numpy() * (b[f].to_numpy() - a[f].to_numpy())
        assert np.allclose(synthetic[f], want)
    assert synthetic["origin"].value_counts().max() - synthetic["origin"].value_counts().min() <= 1


def test_smote_rounds_never_see_their_fold(spark, sf):
    rows = training(spark, sf)
    split = ms.split_for(rows, KEY, LABEL)
    folded = stage(split.with_fold(rows).filter("fold IS NOT NULL"))
    made = resample.smote_folds(folded, split, FEATURES)
    fold_of = {r[KEY]: r["fold"] for r in folded.collect()}
    per_round = {}
    for r in made.collect():
        assert fold_of[r["origin"]] != r["held_out"] and fold_of[r["neighbor"]] != r["held_out"]
        per_round[r["held_out"]] = per_round.get(r["held_out"], 0) + 1
    for f in range(10):
        sizes = resample.round_counts(split.train, split.folds, f)
        assert per_round[f] == sizes["Late"] - sizes["On time"]


def test_smote_needs_more_rows_than_neighbors(spark):
    df = spark.range(40).select("id", F.when(F.col("id") < 5, "few").otherwise("many").alias("c"), F.rand(1).alias("x"))
    with pytest.raises(InvalidDataset):
        resample.smote(stage(df), "id", "c", ["x"])


def test_smote_three_classes_and_balanced_input(spark):
    df = stage(spark.range(90).select("id", F.when(F.col("id") < 10, "a").when(F.col("id") < 30, "b").otherwise("c").alias("c"),
                                      (F.col("id") * 1.5).alias("x"), F.sqrt("id").alias("y")))
    both = resample.balanced(df, resample.smote(df, "id", "c", ["x", "y"]), ["x", "y"], "c")
    assert {r["c"]: r["count"] for r in both.groupBy("c").count().collect()} == {"a": 60, "b": 60, "c": 60}
    even = stage(df.filter("id BETWEEN 10 AND 49"))
    assert resample.smote(even, "id", "c", ["x", "y"]).count() == 0


def test_fit_equals_closed_form(spark, sf):
    rows = training(spark, sf)
    pdf = rows.toPandas()
    model = gnb.fit(rows, FEATURES, LABEL)
    x = pdf[list(FEATURES)].to_numpy(float)
    epsilon = 1e-9 * x.var(axis=0).max()
    for i, label in enumerate(model.labels):
        part = x[(pdf[LABEL] == label).to_numpy()]
        assert np.allclose(model.mean[i], part.mean(axis=0), rtol=1e-12)
        assert np.allclose(model.var[i], part.var(axis=0) + epsilon, rtol=1e-10)
        assert model.prior[i] == pytest.approx(len(part) / len(x))


def test_fold_models_equal_direct_fits(spark, sf):
    rows = training(spark, sf)
    split = stratified_split(rows, KEY, LABEL)
    folded = split.with_fold(rows).filter("fold IS NOT NULL")
    models = gnb.fit_folds(gnb.moments(folded, FEATURES, ["fold", LABEL]), range(10), FEATURES)
    direct = gnb.fit(folded.filter("fold <> 4"), FEATURES, LABEL)
    assert np.allclose(models[4].mean, direct.mean, rtol=1e-12) and np.allclose(models[4].var, direct.var, rtol=1e-10)


def test_spark_ml_agrees(spark, sf):
    from pyspark.ml.classification import NaiveBayes

    rows = training(spark, sf)
    model = gnb.fit(rows, FEATURES, LABEL)
    data = history.feature_stages([], FEATURES).fit(rows).transform(gnb.encode(rows, LABEL, model.class_mapping()))
    other = NaiveBayes(modelType="gaussian", labelCol="label_index").fit(data).transform(data)
    mine = gnb.with_scores(other.withColumnRenamed("prediction", "ml").drop("rawPrediction"), model)
    assert mine.filter("ml <> prediction_index").count() == 0


def test_one_class_and_constant_feature(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0, "a"), (2, 5.0, 2.0, "a"), (3, 5.0, 4.0, "b"), (4, 5.0, 5.0, "b")],
                               "k int, x double, y double, c string")
    model = gnb.fit(df, ["x", "y"], "c")
    assert min(v for vs in model.var for v in vs) > 0
    assert [r["prediction"] for r in gnb.with_scores(df, model).orderBy("k").collect()] == ["a", "a", "b", "b"]
    single = gnb.fit(df.filter("c = 'a'"), ["x", "y"], "c")
    assert {r["prediction"] for r in gnb.with_scores(df, single).collect()} == {"a"}
    with pytest.raises(InvalidDataset):
        gnb.fit(df.filter("k > 9"), ["x", "y"], "c")


def test_tie_goes_to_lowest_index_and_probabilities_add_up(spark):
    model = gnb.GaussianNB(("a", "b"), ("x",), (1, 1), (0.5, 0.5), ((0.0,), (2.0,)), ((1.0,), (1.0,)))
    row = gnb.with_scores(spark.createDataFrame([(1.0,)], "x double"), model).first()
    assert row["prediction"] == "a" and sum(row["probabilities"]) == pytest.approx(1.0)
    far = gnb.with_scores(spark.createDataFrame([(1e6,)], "x double"), model).first()
    assert far["prediction"] == "b" and far["probabilities"][1] == pytest.approx(1.0)


def test_decode_rejects_unknown_index(spark):
    df = spark.createDataFrame([(0,), (3,)], "i int")
    with pytest.raises(Exception, match="unknown class index 3"):
        gnb.decode(df, "i", {"a": 0, "b": 1}).collect()


def test_undefined_metrics_are_zero(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "b")], "y string, p string")
    cells = evaluate.confusion_cells(df, "y", "p", ["a", "b"])
    assert evaluate.binary_metrics(cells, ["a", "b"], "a").first().asDict() == {
        "accuracy": 0.5, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    assert [r["n"] for r in evaluate.confusion_matrix(df, "y", "p", ["a", "b"]).collect()] == [0, 1, 0, 1]


def test_equal_folds_have_no_deviation(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5)] * 3, "accuracy double, precision double, recall double, f1 double")
    assert {r["std"] for r in evaluate.fold_summary(df).collect()} == {0.0}


def test_auc_by_pairs(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"s": np.round(rng.random(300), 2), "y": rng.random(300) < 0.3})
    pos, neg = pdf[pdf.y].s.to_numpy(), pdf[~pdf.y].s.to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    for buckets in (256, 4):
        points = history.roc_points(spark.createDataFrame(pdf), "s", F.col("y"), buckets)
        assert history.roc_auc(points).first()["auc"] == pytest.approx(want)
        last = points.orderBy("threshold").first()
        assert (last["tp"], last["fp"]) == (len(pos), len(neg))


def test_prediction_columns(spark, sf):
    model = gnb.fit(training(spark, sf), FEATURES, LABEL)
    out = scoring.batch_predictions(inference(spark, sf), model, KEY, "v", "w")
    assert out.columns == [KEY, *FEATURES, "prediction", "probability", "prediction_timestamp", "model_version", "model_variant"]
    low = out.agg(F.min("probability")).first()[0]
    assert 0.5 <= low <= 1.0 and not math.isnan(low)
    assert ON_TIME in model.labels


def test_smoothing_search_agrees_with_spark(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rng = np.random.default_rng(4)
    label = rng.integers(0, 3, 240)
    pdf = pd.DataFrame({"a": rng.normal(label, 1.0), "b": rng.normal(-label, 2.0), "y": label.astype(float), "part": np.arange(240) % 4})
    data = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(spark.createDataFrame(pdf)).cache()
    bayes = NaiveBayes(modelType="gaussian", featuresCol="x", labelCol="y")
    grid = [0.5, 2.0]
    theirs = CrossValidator(
        estimator=bayes, estimatorParamMaps=ParamGridBuilder().addGrid(bayes.smoothing, grid).build(), numFolds=4, foldCol="part",
        evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")).fit(data).avgMetrics
    ours = history.smoothing_search(data, "x", "y", "part", 4, grid).collect()
    assert [(r["smoothing"], pytest.approx(r["accuracy"])) for r in ours] == list(zip(grid, theirs))
    assert 0.4 < theirs[0] < 1.0
    for folds in (3, 5):
        with pytest.raises(InvalidDataset):
            history.smoothing_search(data, "x", "y", "part", folds)
    with pytest.raises(InvalidDataset):
        history.smoothing_search(data.limit(0), "x", "y", "part", 4)


def test_roc_points_in_any_number_of_buckets(spark):
    rows = spark.range(3000).selectExpr("cast(id % 997 as double) AS s", "id % 7 = 0 AS y").cache()
    order = ["threshold"]
    default = history.roc_points(rows, "s", F.col("y")).orderBy(order).collect()
    assert default == history.roc_points(rows, "s", F.col("y"), 50).orderBy(order).collect() and len(default) == 997
    assert history.roc_points(rows.limit(0), "s", F.col("y")).count() == 0
