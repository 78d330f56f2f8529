"""The academic preset from landing files to predictions, and the shape of the physical plans."""

import dataclasses
import os
import uuid

import pytest
from pyspark.sql import functions as F

from gradus.checks import bindings
from gradus.operators import features, gnb, quality, registry, scoring
from gradus.operators.model_selection import fit_variant
from gradus.operators.quality import InvalidDataset
from gradus.plans import academic, flow, modelling
from gradus.plans.layers import Layers
from gradus.sources import publish, staging


def landing(spark, folder, n=400):
    """Students 0..n-1: two thirds graduated, the others active; every tenth has no result card."""
    i = F.col("id")
    students = spark.range(n).select(
        i.alias("ID"), F.when(i % 2 == 0, "L").otherwise("P").alias("Jenis Kelamin"),
        F.date_add(F.lit("2014-08-01").cast("date"), (i % 3).cast("int") * 366).alias("Tanggal Masuk"),
        F.when(i % 3 < 2, F.date_add(F.lit("2018-06-01").cast("date"), (i % 11).cast("int") * 80)).alias("Tanggal Keluar"),
        (F.lit(2.5) + (i % 13) / 10).alias("IPK"), (F.lit(100) + i % 40).alias("Total SKS"),
        (F.lit(40) + i % 17).alias("Jumlah MK"), F.when(i % 3 < 2, " Lulus").otherwise("AKTIF ").alias("Status Mahasiswa"))
    results = spark.range(n).filter("id % 10 <> 0").select(
        i.alias("ID"), (F.lit(2.0) + (i % 11) * 0.15).alias("IP"), (F.lit(18) + i % 5).alias("SKS"))
    programmes = spark.createDataFrame([("A", "Informatika", 20)], "Kode string, `Nama Program Studi` string, `Jumlah Dosen` int")
    paths = {}
    for name, df in (("Referensi Data Mahasiswa", students), ("Data KHS", results.union(results.limit(3))),
                     ("Data Program Studi", programmes)):
        paths[name] = f"{folder}/{academic.KNOWN_SOURCES[name]}"
        df.write.option("header", True).csv(paths[name])
    return paths


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("flow"))
    tag = uuid.uuid4().hex[:6]
    layers = Layers(*[f"{n}_{tag}" for n in Layers().names()])
    spec = dataclasses.replace(academic.FLOW, layers=layers)
    reports = flow.run(spark, spec, landing(spark, folder), location=folder)
    return folder, layers, reports


def test_flow_reports(spark, ran):
    _, layers, reports = ran
    assert not spark.sparkContext._jsc.sc().isStopped()
    status = {(r["table"], r["status"]) for r in reports["manifest"].collect()}
    assert ("data_khs", "ok") in status and ("data_kurikulum", "missing") in status
    metrics = reports["star_metrics"].first().asDict()
    assert metrics["dim_total"] == 400 and metrics["fact_total"] == 360 and metrics["row_multiplication"] == 0
    assert metrics["dim_without_fact"] == 40 and metrics["orphan_fact"] == 0
    assert all(r["passed"] for r in reports["star_gates"].collect())
    report = {(r["subject"], r["metric"]): r["value"] for r in reports["features"].collect()}
    training = spark.table(f"{layers.feature_store}.training_dataset")
    assert report[("training", "written")] == training.count() == 240
    assert report[("training", "null_features")] == report[("training", "duplicate_keys")] == 0
    assert training.columns == ["id_mahasiswa", "ip", "sks", "angkatan", "jumlah_mk", "status_kelulusan"]
    assert reports["excluded"].filter("set = 'training' AND reason = 'missing_ip'").count() == 27
    overlap = {r["metric"]: r["value"] for r in reports["quality"].filter("subject = 'key_overlap'").collect()}
    assert overlap == {"left_keys": 400, "right_keys": 360, "right_only": 0, "left_only": 40, "both": 360}
    assert "primary key id_mahasiswa" in spark.catalog.getTable(f"{layers.gold}.dim_mahasiswa").description
    assert spark.table(f"{layers.gold}.gold_program_studi").count() == 1


def test_reports_outlive_the_tables(spark, tmp_path):
    layers = Layers(*[f"{n}_{uuid.uuid4().hex[:6]}" for n in Layers().names()])
    spec = dataclasses.replace(academic.FLOW, layers=layers)
    kept, staged = staging.stage(spark.range(3), "kept"), len(staging._staged)
    reports = flow.run(
        spark, spec, landing(spark, str(tmp_path), 60), location=str(tmp_path), reports=f"{tmp_path}/reports",
        schemas={"Data Program Studi": "Kode string, `Nama Program Studi` string, `Jumlah Dosen` string"})
    assert len(staging._staged) == staged and kept.count() == 3
    assert spark.table(f"{layers.bronze}.data_program_studi").schema[2].dataType.simpleString() == "string"
    for name in (layers.bronze, layers.silver, layers.gold, layers.feature_store):
        spark.sql(f"DROP DATABASE {name} CASCADE")
    report = {(r["subject"], r["metric"]): r["value"] for r in reports["features"].collect()}
    assert report[("training", "written")] == 36 and all(r["passed"] for r in reports["star_gates"].collect())
    assert spark.read.parquet(f"{tmp_path}/reports/excluded").count() == reports["excluded"].count() > 0
    assert academic.jdbc_targets(layers)[0].source == f"{layers.gold}.gold_mahasiswa"
    assert academic.dashboard_tables(layers)[-1] == f"{layers.feature_store}.prediction_result"


def test_training_and_inference(spark, ran):
    folder, layers, _ = ran
    training = spark.table(f"{layers.feature_store}.training_dataset")
    result = modelling.train_variants(spark, training, academic.MODEL, f"{folder}/models")
    assert result["status"] == "SUCCESS", [r for r in result["gates"].collect() if not r["passed"]]
    assert result["gates"].count() == 28
    assert {r["metric"] for r in result["holdout"].collect()} == {"accuracy", "precision", "recall", "f1"}

    inputs = spark.table(f"{layers.feature_store}.inference_dataset")
    smoke = modelling.run_inference(spark, inputs, academic.MODEL, f"{folder}/models", f"{folder}/none", smoke=True)
    assert smoke["status"] == "SMOKE_TEST_PASS" and smoke["smoke"].count() == 10
    out = modelling.run_inference(
        spark, inputs, academic.MODEL, f"{folder}/models", f"{folder}/out", academic.DENIED,
        label_name=academic.PREDICTION_LABEL, probability_name=academic.PREDICTION_PROBABILITY)
    assert out["status"] == "SUCCESS" and out["agreement"].first()["total"] == inputs.count()
    assert out["comparison"].columns == ["id_mahasiswa", "prediction_without_smote", "prediction_with_smote"]
    checks = publish.promote(spark, [publish.Promotion(
        f"{folder}/out/prediction_result_{v}", f"{layers.feature_store}.prediction_result_{v}",
        ("id_mahasiswa", *academic.FEATURES, academic.PREDICTION_LABEL, academic.PREDICTION_PROBABILITY,
         "prediction_timestamp", "model_version", "model_variant")) for v, _ in modelling.VARIANTS], "id_mahasiswa")
    assert publish.promotion_status(checks).first()["status"] == "SUCCESS"
    # the preset names the same tables, and the reports that were written tell of them
    presets = academic.promotions(f"{folder}/out", layers)
    assert [p.table.split(".")[1] for p in presets] == [
        "prediction_result_without_smote", "prediction_result_with_smote", "prediction_comparison"]
    assert publish.promotion_status(publish.promote(spark, presets, "id_mahasiswa")).first()["status"] == "SUCCESS"
    labels = {(r["subject"].split("result_")[-1], r["label"], r["n"]) for r in publish.promoted_labels(spark, presets).collect()}
    assert labels == {(r["subject"], r["label"], r["n"]) for r in out["distribution"].collect()}
    written = spark.read.json(f"{folder}/out/reports/agreement").first()
    assert written["total"] == inputs.count() and spark.read.json(f"{folder}/out/reports/gates").filter("not passed").isEmpty()
    differing = out["comparison"].filter("prediction_without_smote <> prediction_with_smote").count()
    assert out["disagreeing_keys"].count() == min(10, differing)


def test_unfit_inputs_stop_before_scoring(spark):
    key, names = "k", ("x",)
    for schema, rows in (("k int, y double", [(1, 1.0)]), ("k int, x double, lama int", [(1, 1.0, 2)]),
                         ("k int, x double", [(1, None)]), ("k int, x double", [(None, 1.0)]),
                         ("k int, x double", [(1, 1.0), (1, 2.0)])):
        with pytest.raises((InvalidDataset, features.LeakageError)):
            scoring.require_scorable(spark.createDataFrame(rows, schema), key, names)
    assert scoring.require_scorable(spark.createDataFrame([(1, 1.0)], "k int, x double"), key, names).count() == 6


def test_agreement_of_nothing_is_zero(spark):
    row = scoring.agreement(spark.createDataFrame([], "a string, b string"), "a", "b").first()
    assert (row["total"], row["agreement_rate"]) == (0, 0.0)


def test_rule_when_no_model_is_stored(spark, folder):
    df = spark.createDataFrame([(1, 7), (2, 9)], "id_mahasiswa int, s int")
    rule = F.when(F.col("s") <= 8, academic.ON_TIME).otherwise(academic.LATE)
    got = modelling.predict_or_fallback(spark, df, academic.MODEL, folder, "without_smote", rule)
    assert [(r["prediction"], r["source"]) for r in got.orderBy("s").collect()] == [
        (academic.ON_TIME, "rule"), (academic.LATE, "rule")]


# ---------------------------------------------------------------------------------------- plans

def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_scan_prunes_and_pushes_down(spark, sf):
    df = bindings.table(spark, sf, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 1000").select("o_orderkey")
    text = plan(df)
    assert "EqualTo(o_orderstatus,F), GreaterThan(o_total" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in text


def test_rule_counts_are_one_pass(spark, sf):
    from gradus.checks.projections import LINE_RULES, lines_with_gaps

    text = df_physical(quality.rule_counts(lines_with_gaps(spark, sf), "l_orderkey", LINE_RULES))
    assert text.count("FileScan") == 1 and "l_extendedprice" not in text


def df_physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_narrow(spark, sf):
    rows = bindings.training(spark, sf)
    text = df_physical(gnb.with_scores(rows, gnb.fit(rows, bindings.FEATURES, bindings.LABEL)))
    assert "Exchange" not in text and "Python" not in text and "Join" not in text


def test_split_assignment_is_narrow(spark, sf):
    from gradus.operators.split import stratified_split

    rows = bindings.training(spark, sf)
    text = df_physical(stratified_split(rows, bindings.KEY, bindings.LABEL).with_fold(rows))
    assert "Exchange" not in text and "Join" not in text


def test_no_cross_joins(spark, sf):
    from gradus.checks import queries

    for name in ("q2_star_metrics", "u4_key_overlap", "a9_distribution_percent", "a15_group_stats", "m22_variant_comparison",
                 "q4_prediction_gates", "m10_smote_per_fold", "d9_roc_auc"):
        text = df_physical(queries[name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


@pytest.fixture
def stored_models(spark, folder):
    """Both variants of a small model, fitted on rows of two classes."""
    spec = modelling.ModelSpec("k", ("x", "y"), "label", "a", "m", "v1")
    rows = [(i, float(i % 7), float(i % 11) + (i % 3 == 0) * 5, "a" if i % 3 == 0 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, x double, y double, label string").cache()
    for variant, oversample in modelling.VARIANTS:
        registry.save_model(spark, f"{folder}/models", spec.model_id(variant), fit_variant(df, "k", ("x", "y"), "label", oversample))
    return spec, df.drop("label")


def test_inference_reads_its_input_once_and_equals_two_passes(spark, folder, stored_models):
    spec, inputs = stored_models
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    out = modelling.run_inference(spark, inputs.mapInPandas(counted, inputs.schema), spec, f"{folder}/models", f"{folder}/out")
    assert read.value == inputs.count() == 200 and out["status"] == "SUCCESS"
    sets = []
    for variant, _ in modelling.VARIANTS:
        model, _ = registry.load_model(spark, f"{folder}/models", spec.model_id(variant))
        alone = scoring.batch_predictions(inputs, model, "k", "v1", variant).drop("prediction_timestamp")
        assert set(out["predictions"][variant].drop("prediction_timestamp").collect()) == set(alone.collect())
        sets.append(alone)
    expected = scoring.comparison_table(*sets, "k", names=("prediction_without_smote", "prediction_with_smote"))
    names = expected.columns[1:]
    assert set(out["comparison"].collect()) == set(expected.collect())
    assert out["agreement"].collect() == scoring.agreement(expected, *names).collect()
    assert set(out["mismatches"].collect()) == set(scoring.mismatch_patterns(expected, *names).collect())
    for variant, alone in zip(("without_smote", "with_smote"), sets):
        assert set(out["distribution"].filter(F.col("subject") == variant).collect()) == set(
            scoring.label_distribution(alone, "prediction", variant).collect())


def test_unfit_input_publishes_nothing(spark, folder, stored_models):
    spec, inputs = stored_models
    for bad in (inputs.unionAll(inputs.limit(1)), inputs.withColumn("x", F.when(F.col("k") > 0, F.col("x"))),
                inputs.withColumn("k", F.when(F.col("k") > 0, F.col("k")))):
        with pytest.raises(InvalidDataset):
            modelling.run_inference(spark, bad, spec, f"{folder}/models", f"{folder}/none")
    assert not os.path.exists(f"{folder}/none")


def test_predictions_lost_on_the_way_fail_their_gates(spark, folder, stored_models, monkeypatch):
    spec, inputs = stored_models
    write = publish.write_observed
    monkeypatch.setattr(publish, "write_observed", lambda df, *rest: write(df.filter("k <> 5"), *rest))
    out = modelling.run_inference(spark, inputs, spec, f"{folder}/models", f"{folder}/lossy")
    assert out["status"] == "FAILED"
    assert {r["gate"] for r in out["gates"].filter("not passed").collect()} == {"row_count", "coverage"}
