"""Refusals: foreign rows, missing numbers, features that do not vary, columns out of place."""

import numpy as np
import pandas as pd
import pytest
from gradus.checks.bindings import training
from gradus.checks.composite import MODEL
from gradus.operators import features, neighbors, quality, resample, scoring
from gradus.operators.gnb import GaussianNB, Moments
from gradus.plans import modelling
from gradus.sources import catalog, ingest, publish
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_slices_refuse_foreign_rows_and_empty_themselves(spark, folder):
    old = spark.createDataFrame([("train", 1), ("infer", 2)], "category string, n int")
    mixed = spark.createDataFrame([("infer", 3), ("train", 4)], "category string, n int")
    with pytest.raises(Exception, match="another slice"):
        publish.replace_slice(old, mixed, "category", "infer").collect()
    path = f"{folder}/csv"
    for value in ("train", "infer"):
        publish.write_csv_slice(spark, path, old.filter(F.col("category") == value), "category", value)
    with pytest.raises(Exception, match="another slice"):
        publish.write_csv_slice(spark, path, mixed, "category", "infer")
    stored = publish.write_csv_slice(spark, path, old.limit(0), "category", "infer")
    assert [tuple(r) for r in stored.select("category", "n").collect()] == [("train", 1)]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, None, "y"), (3, 1.0, None)], "k int, f double, label string")
    counted = quality.validate_labelled(df, "k", ["f"], "label").first()
    assert (counted.null_f, counted.null_label) == (2, 1)
    assert scoring.input_facts(df, "k", ["f"]).first().null_f == 2
    with pytest.raises(quality.InvalidDataset, match="f"):
        quality.require_filled(df, ["k", "f"])
    with pytest.raises(quality.InvalidDataset):
        scoring.require_scorable(df.drop("label"), "k", ["f"])


def test_constant_features_are_refused():
    with pytest.raises(quality.InvalidDataset, match="varies"):
        GaussianNB.from_moments({"a": Moments(3, (1.0,), (0.0,)), "b": Moments(2, (1.0,), (0.0,))}, ["f"])


def test_verdict_of_every_column():
    schema = T.StructType.fromDDL("k int, f double, y string, late string, z int")
    roles = features.model_roles(["f", "g"], "k", ["y"])
    assert features.column_verdicts(schema, roles, ["late", "y"]) == [
        ("late", "denied"), ("k", "key"), ("f", "feature"), ("y", "label"), ("late", "unexpected"), ("z", "unexpected"), ("g", "missing")]


def test_copies_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(resample, "_COPY_BLOCK", 7)
    order = resample.HashOrder("k", "label", 1)
    rows = spark.createDataFrame([(1, "a", 20, 0.0, [(2, [1.0])]), (2, "a", 7, 1.0, [(1, [0.0])]), (3, "a", 0, 1.0, [(1, [0.0])])],
                                 "k int, label string, copies int, f double, neighbors array<struct<key:int,x:array<double>>>")
    made = resample._synthesize(rows, order, ["f"], 1).groupBy("origin").agg(F.sort_array(F.collect_list("copy")).alias("c")).collect()
    assert {r.origin: r.c for r in made} == {1: list(range(1, 21)), 2: list(range(1, 8))}


def _lattice(n: int) -> pd.DataFrame:
    """97 percent of the rows on 40 spots, the others on a coarse lattice."""
    draw = np.random.default_rng(7)
    spots = draw.integers(0, 30, (40, 3)).astype(float)
    x = np.where((draw.random(n) < 0.97)[:, None], spots[draw.integers(0, 40, n)], draw.integers(0, 60, (n, 3)) / 2)
    return pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(n), fold=draw.integers(0, 4, n))


def test_crowded_lattices_are_exact_without_infinite_balls(spark, monkeypatch):
    visits, inner = [], neighbors._visiting_pairs

    def counted(placed, visiting, *rest):
        visits.append([visiting.count(), visiting.filter("isnan(limit2) or limit2 = double('Infinity')").count()])
        return inner(placed, visiting, *rest)

    monkeypatch.setattr(neighbors, "_visiting_pairs", counted)
    for n in (4000, 8000):
        pdf = _lattice(n)
        found = neighbors.nearest_neighbors(spark.createDataFrame(pdf), "id", ["a", "b", "c"], 5, fold="fold", cell_rows=60)
        near = neighbors.outside_fold(F.col("neighbors"), F.lit(1), 5)
        got = {r["id"]: list(r["n"]) for r in found.select("id", near.getField("key").alias("n")).collect()}
        x, others = pdf[["a", "b", "c"]].to_numpy(), pdf[pdf["fold"] != 1]
        for i in range(0, n, 7):
            d2 = ((others[["a", "b", "c"]].to_numpy() - x[i]) ** 2).sum(axis=1)
            order = others["id"].to_numpy()[np.lexsort((others["id"], d2))]
            assert got[i] == [int(j) for j in order if j != i][:5]
    (few, endless), (more, endless_too) = visits
    assert endless == endless_too == 0 and 0 < more <= 2.5 * few


def test_anchors_bound_a_ball_by_real_points():
    points = np.arange(40, dtype=float)[:, None]
    tree = neighbors.SplitTree(points, 3)
    anchors = neighbors.Anchors(tree, points, np.arange(40) % 2)
    cell = int(tree.cells(np.array([[7.0]]))[0])
    limit = anchors.limits(np.array([[7.0]]), cell, 3)[0]
    assert 9 <= limit < np.inf  # with the odd points left out, 6, 8 and 4 are nearest
    none = neighbors.Anchors(tree, points[:0], np.empty(0, int))
    assert np.isinf(none.limits(np.array([[7.0]]), cell, 3)).all()


def test_whole_number_labels_come_back_as_numbers(spark, sf, folder):
    rows = training(spark, sf).withColumn(MODEL.label, F.when(F.col(MODEL.label) == MODEL.positive, 1).otherwise(0))
    spec = modelling.ModelSpec(MODEL.key, MODEL.features, MODEL.label, 1, "numbers", "1", folds=2)
    trained = modelling.train_variants(spark, rows, spec, folder)
    assert trained["status"] == "SUCCESS"
    again = modelling.registry.load_model(spark, folder, spec.model_id("with_smote"))[0]
    assert again.labels == (0, 1)


def test_a_source_that_fails_while_read_is_skipped(spark, folder):
    spark.sql("CREATE DATABASE IF NOT EXISTS contracts")
    spark.createDataFrame([("1",), ("x",)], "a string").coalesce(1).write.csv(f"{folder}/bad")
    spark.createDataFrame([("1",), ("2",)], "a string").coalesce(1).write.csv(f"{folder}/good")
    options = {"schema": "a int", "header": False, "mode": "FAILFAST"}
    found = ingest.ingest(spark, {"bad": f"{folder}/bad", "good": f"{folder}/good"}, "contracts", **options).collect()
    assert {(r["table"], r["status"], r["rows"]) for r in found} == {("bad", "skipped", 0), ("good", "ok", 2)}
    assert not catalog.table_exists(spark, "contracts.bad")
    with pytest.raises(ValueError, match="same table"):
        ingest.ingest(spark, {"a b": f"{folder}/good", "a-b": f"{folder}/good"}, "contracts", **options)


def test_replacing_keeps_the_comment(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS contracts")
    catalog.replace_table(spark.range(3), "contracts.kept", "one row for each number")
    catalog.replace_table(spark.range(2), "contracts.kept")
    assert catalog.table_comment(spark, "contracts.kept") == "one row for each number"
    assert spark.table("contracts.kept").count() == 2
