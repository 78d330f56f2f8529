"""Quality rules, standardising and star checks on hand-made rows."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from gradus.operators import dedup, quality, star
from gradus.operators.metrics import gates
from gradus.operators.standardize import rename_columns, standardize, standardize_once, trim_strings
from gradus.plans.academic import STUDENTS, TERM_RESULTS
from gradus.sources.staging import stage

STUDENT_COLUMNS = ["ID", "Jenis Kelamin", "Tanggal Masuk", "Tanggal Keluar", "IPK", "Total SKS", "Jumlah MK",
                   " Status Mahasiswa "]
STUDENT_ROWS = [
    ("1", "L", "2018-08-01", "2022-07-31", "3.50", "144", "52", "Lulus"),
    ("2", "P", "2018-08-01", "2022-08-01", "3.10", "145.7", "50", "LULUS"),
    ("3", "L", "2018-08-01", None, "2.90", "140", "48", " lulus "),
    ("4", "P", None, "2022-07-01", "3.00", "100", "40", "AKTIF"),
    ("5", "L", "2020-08-01", "2019-08-01", "3.00", "100", "40", "AKTIF"),
    ("6", "P", "2020-08-01", None, "4.20", "100", "40", "AKTIF"),
    ("7", "L", "2020-08-01", None, None, "-3", "40", "CUTI"),
    ("8", "P", "2020-08-01", None, "abc", "1e2", "40", ""),
    (None, "L", "2020-08-01", None, "3.0", "90", "30", "AKTIF"),
    (None, "L", "2020-08-01", None, "3.0", "90", "30", "AKTIF"),
    ("1", "L", "2018-08-01", "2022-07-31", "3.40", "140", "51", "Lulus"),
    (None,) * 8,
    ("9", "L", "44000", None, "3.0", "90", "30", "AKTIF"),
    ("10", "L", "2020-08-01", None, "NaN", "90", "30", None),
]
RESULT_ROWS = [("1", "3.5", "20"), ("2", "0", "0"), ("3", None, "18"), ("4", "4.5", "20"), ("5", "-1", "20"),
               (None, "3.0", "20"), ("6", "NaN", "20"), ("99", "3.0", "21"), ("1", "3.6", "21")]


def students(spark):
    return spark.createDataFrame(STUDENT_ROWS, ", ".join(f"`{c}` string" for c in STUDENT_COLUMNS))


def results(spark):
    return spark.createDataFrame(RESULT_ROWS, "ID string, IP string, SKS string")


def test_student_rules(spark):
    done = standardize(students(spark), STUDENTS)
    counts = done.counts.first().asDict()
    assert counts == {
        "initial": 13, "valid": 9, "duplicate_key": 2, "null_id": 2, "null_tanggal_masuk": 1,
        "keluar_sebelum_masuk": 1, "ipk_out_of_range": 2, "ipk_null": 2, "total_sks_negatif": 1,
        "jumlah_mk_negatif": 0, "status_unknown": 2, "tanggal_tidak_wajar": 1,
    }
    rejected = {(r["key"], r["reason"]) for r in done.rejected.collect()}
    assert rejected == {("4", "null_tanggal_masuk"), ("5", "keluar_sebelum_masuk"), ("6", "ipk_out_of_range"),
                        ("10", "ipk_out_of_range")}
    summary = done.summary.first().asDict()
    assert summary["excluded"] == 4 and summary["invalid"] == 2 + 2 + 1 + 1 + 2 + 2 + 1 + 0 + 2
    kept = {(r["id_mahasiswa"], r["total_sks"]) for r in done.rows.select("id_mahasiswa", "total_sks").collect()}
    assert ("2", 145) in kept and ("8", 100) in kept and (None, 90) in kept


def test_result_rules(spark):
    done = standardize(results(spark), TERM_RESULTS)
    counts = done.counts.first().asDict()
    assert counts["initial"] == 9 and counts["valid"] == 4 and counts["duplicate_key"] == 1
    assert (counts["ip_atas_4"], counts["ip_negatif"], counts["null_ip"], counts["null_id"]) == (2, 1, 1, 1)
    assert (counts["ip_sama_dengan_nol"], counts["sks_sama_dengan_nol"]) == (1, 1)
    summary = done.summary.first().asDict()
    assert summary["invalid"] == 1 + 1 + 1 + 0 + 1 + 2 + 0  # info counts are left out


@pytest.mark.parametrize("make,spec", [(students, STUDENTS), (results, TERM_RESULTS), (results, dataclasses.replace(
    TERM_RESULTS, rules=tuple(dataclasses.replace(r, rejects=False) for r in TERM_RESULTS.rules)))])
def test_one_pass_equals_separate_passes(spark, make, spec):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    source = make(spark)
    lazily = standardize(source, spec)
    once = standardize_once(source.mapInPandas(counted, source.schema), spec, stage)
    for frame in ("rows", "rejected", "counts", "summary"):
        got, expected = (df.select(*(F.col(c).cast("string") for c in df.columns)) for df in (getattr(once, frame), getattr(lazily, frame)))
        assert got.columns == expected.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert read.value == source.count()


def test_one_pass_over_nothing_and_without_a_key(spark):
    nothing = standardize_once(students(spark).limit(0), STUDENTS, stage)
    assert nothing.rows.count() == nothing.rejected.count() == nothing.counts.first()["initial"] == 0
    plain = standardize_once(results(spark), dataclasses.replace(TERM_RESULTS, key=None, rules=()), stage)
    assert tuple(plain.summary.first())[1:] == (9, 9, 0, 0) and plain.rejected is None


def test_trim_keeps_tabs(spark):
    row = trim_strings(spark.createDataFrame([(" a\t ", 1)], "s string, n int")).first()
    assert tuple(row) == ("a\t", 1)


def test_rename_raises_on_collision(spark):
    with pytest.raises(ValueError):
        rename_columns(spark.createDataFrame([(1, 2)], "`A B` int, `A-B` int"), {})


def test_null_is_one_distinct_key(spark):
    df = spark.createDataFrame([(1,), (None,), (None,), (2,), (2,)], "k int")
    assert tuple(quality.key_counts(df, "k").first()) == (5, 3, 2)
    assert tuple(quality.key_counts(df.filter("k > 9"), "k").first()) == (0, 0, 0)


def test_first_per_key_is_deterministic(spark):
    rows = [(1, "b", 2), (1, "a", 9), (None, "z", 1), (None, None, 5), (2, "c", 3)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "k int, s string, n int").repartition(parts)
        got = {tuple(r) for r in dedup.first_per_key(df, ["k"]).collect()}
        assert got == {(1, "a", 9), (None, None, 5), (2, "c", 3)}
    assert {tuple(r) for r in dedup.first_per_key(df, ["k"], ["n"], ["k", "n"]).collect()} == {(1, 2), (None, 1), (2, 3)}


def two_sides(spark):
    dim = spark.createDataFrame([(1,), (2,), (None,), (4,)], "k int")
    fact = spark.createDataFrame([(1, 1.0), (1, None), (3, 2.0), (None, 5.0)], "k int, m double")
    return dim, fact


def test_star_metrics_equal_real_joins(spark):
    dim, fact = two_sides(spark)
    m = star.star_metrics(dim, fact, "k", ["m"]).first().asDict()
    joined = dim.join(fact, "k", "left")
    assert m["join_total"] == joined.count()
    assert m["matched"] == joined.filter("m IS NOT NULL").count()
    assert m["orphan_fact"] == star.rows_without_match(fact, dim, "k").count() == 2  # NULL never matches
    assert m["dim_without_fact"] == star.rows_without_match(dim, fact, "k").count() == 3
    assert m["row_multiplication"] == 1 and m["fact_null_m"] == 1 and m["dim_null_key"] == 1
    passed = {r["gate"]: r["passed"] for r in star.star_gates(spark.createDataFrame([m])).collect()}
    assert passed == {"dim_grain": True, "fact_grain": False, "grain": False, "referential_integrity": False, "join": False}


def test_set_semantics_treat_null_as_equal(spark):
    dim, fact = two_sides(spark)
    assert tuple(star.key_overlap(dim, fact, "k").first()) == (4, 3, 1, 2, 2)
    assert star.keys_in_both(dim, fact, "k").count() == 2
    assert star.keys_only_in(fact, dim, "k").count() == 1


def test_multiplying_join_is_refused(spark):
    dim, fact = two_sides(spark)
    with pytest.raises(quality.InvalidDataset):
        star.guarded_left_join(dim, fact, "k")
    assert star.guarded_left_join(dim, fact.groupBy("k").agg(F.max("m").alias("m")), "k").count() == 4


def test_undecided_gate_fails(spark):
    row = spark.range(1).select(F.lit(None).cast("boolean").alias("x"))
    assert gates(row, {"g": F.col("x")}).first()["passed"] is False


def test_require_unique_key(spark):
    with pytest.raises(quality.InvalidDataset):
        quality.require_unique_key(spark.createDataFrame([(1,), (1,)], "k int"), "k")


def test_group_stats_are_exact(spark):
    import statistics

    from gradus.operators.profile import group_stats

    data = {"a": [5.0] * 40 + [float(i % 7) for i in range(61)], None: [3.0, 1.0], "one": [2.5], "none": [None],
            "big": [float((i * 7919) % 20011) for i in range(20000)]}
    rows = [(g, v) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r.asDict() for r in group_stats(df, ["g"], "v").collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        vs = [v for v in vs if v is not None]
        assert got[g]["runs"] == len(vs)
        if vs:
            assert got[g]["median_sec"] == statistics.median(vs) and got[g]["min_sec"] == min(vs)
            assert got[g]["std_sec"] == pytest.approx(statistics.stdev(vs) if len(vs) > 1 else 0.0)
