import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.operators import features
from gradus.plans.academic import FEATURE_SPEC


def joined(spark):
    rows = [
        ("1", "2018-08-01", "2022-07-31", "Lulus", 52, 3.5, 20),
        ("2", "2018-08-01", "2022-08-01", "LULUS", 50, 3.1, 20),
        ("3", "2018-08-01", None, " lulus ", 48, 2.9, 18),
        ("4", "2018-08-01", "2022-01-01", "LULUS", 48, None, None),
        ("5", "2020-08-01", None, "AKTIF", 40, float("nan"), 20),
        ("6", "2020-08-01", None, "aktif", 40, 3.0, 20),
        ("7", "2020-08-01", None, None, 40, 3.0, 20),
    ]
    df = spark.createDataFrame(rows, "id_mahasiswa string, tanggal_masuk string, tanggal_keluar string, "
                                     "status_mahasiswa string, jumlah_mk int, ip double, sks int")
    return df.withColumn("tanggal_masuk", F.to_date("tanggal_masuk")).withColumn("tanggal_keluar", F.to_date("tanggal_keluar"))


def test_labels_and_populations(spark):
    rows = {r["id_mahasiswa"]: r["status_kelulusan"] for r in features.training_set(joined(spark), FEATURE_SPEC).collect()}
    assert rows == {"1": "Tepat Waktu", "2": "Terlambat", "3": "Terlambat"}  # limit day counts; no exit is late
    open_rows = features.inference_set(joined(spark), FEATURE_SPEC)
    assert [r["id_mahasiswa"] for r in open_rows.collect()] == ["6"]  # NaN is missing, NULL status in no population
    assert open_rows.columns == ["id_mahasiswa", "ip", "sks", "angkatan", "jumlah_mk"]


def test_report_and_quarantine(spark):
    r = features.feature_report(joined(spark), FEATURE_SPEC).first().asDict()
    assert r == {"initial": 4, "valid": 3, "duplicate_rows": 0, "without_measures": 1, "incomplete": 1,
                 "label_on_time": 2, "label_late": 2, "days_unknown": 1}
    lost = {tuple(x) for x in features.excluded_rows(joined(spark), FEATURE_SPEC).collect()}
    assert lost == {("4", "missing_ip"), ("4", "missing_sks")}


def test_leakage_guard(spark):
    df = features.training_set(joined(spark), FEATURE_SPEC)
    features.check_leakage(df, FEATURE_SPEC.features, "id_mahasiswa", FEATURE_SPEC.denied, ["status_kelulusan"])
    with pytest.raises(features.LeakageError):
        features.check_leakage(df, FEATURE_SPEC.features, "id_mahasiswa", FEATURE_SPEC.denied)
    with pytest.raises(features.LeakageError):
        features.check_leakage(df.withColumn("lama_studi", F.lit(1)), FEATURE_SPEC.features, "id_mahasiswa",
                               FEATURE_SPEC.denied, ["status_kelulusan"])


def test_schema_contract(spark):
    want = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    features.check_schema(spark.createDataFrame([(1, "x")], want), want, types=True)
    for bad in ("a int", "a int, b string, c int"):
        with pytest.raises(features.SchemaError):
            features.check_schema(spark.createDataFrame([], bad), want)
    with pytest.raises(features.SchemaError):
        features.check_schema(spark.createDataFrame([], "a bigint, b string"), want, types=True)
