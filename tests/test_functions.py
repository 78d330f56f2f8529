import pytest
from pyspark.sql import functions as F

from gradus.functions import casts, hashing, names


@pytest.mark.parametrize("source, table, column", [
    ("  Referensi Data-Mahasiswa ", "referensi_data_mahasiswa", "referensi_data_mahasiswa"),
    ("IPK (akhir)/x", "ipk_akhir_x", "ipk_akhir_x"),
    ("Brand#1 é", "brand#1_é", "brand1_"),
])
def test_names(spark, source, table, column):
    assert names.table_name(source) == table
    assert names.clean_name(source) == column
    row = spark.createDataFrame([(source,)], "s string").select(
        names.table_name_expr(F.col("s")), names.clean_name_expr(F.col("s"))).first()
    assert tuple(row) == (table, column)


def test_known_names_win():
    assert names.table_name(" Data KHS ", {"Data KHS": "results"}) == "results"


def test_name_collision_raises():
    with pytest.raises(names.NameCollision):
        names.target_names(["A B", "A-B"])
    assert names.target_names([" Status Mahasiswa ", "x"], {"status mahasiswa": "s"}) == ["s", "x"]


def test_lenient_casts(spark):
    rows = [("3.7",), ("145.7",), ("1e2",), ("abc",), ("9e12",), ("",), (None,), ("-2.9",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(casts.to_int(F.col("x"))).collect()]
    assert got == [3, 145, 100, None, None, None, None, -2]
    days = [("2020-1-5",), ("2020-01-05 00:00:00",), ("2020-01-05T10",), ("05/01/2020",), ("44000",)]
    got = [r[0] for r in spark.createDataFrame(days, "x string").select(
        F.year(casts.to_date(F.col("x")))).collect()]
    assert got == [2020, 2020, 2020, None, 44000]


def test_hash_is_partition_independent(spark):
    u = hashing.uniform(hashing.key_hash(42, F.col("id")))
    a = {r["id"]: r["u"] for r in spark.range(100, numPartitions=1).select("id", u.alias("u")).collect()}
    b = {r["id"]: r["u"] for r in spark.range(100, numPartitions=7).select("id", u.alias("u")).collect()}
    assert a == b and a[1] == pytest.approx(0.34786711167544127) and 0 <= min(a.values()) <= max(a.values()) < 1
