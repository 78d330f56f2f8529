"""Catalog, ingest, sinks and registry."""

import uuid

import pytest
from pyspark.sql import functions as F

from gradus.operators import registry
from gradus.operators.gnb import GaussianNB
from gradus.sources import catalog, ingest, publish, staging


@pytest.fixture
def database(spark, folder):
    name = f"t_{uuid.uuid4().hex[:8]}"
    catalog.create_layers(spark, [name], folder)
    return name


def test_replace_is_full_and_may_read_itself(spark, database):
    name = f"{database}.t"
    catalog.replace_table(spark.range(10).withColumn("x", F.lit(1)), name, comment="it's one row per id")
    assert catalog.table_comment(spark, name) == "it's one row per id"
    catalog.replace_table(spark.table(name).filter("id < 4").select("id"), name)
    assert spark.table(name).count() == 4 and spark.table(name).columns == ["id"]
    assert [t.name for t in spark.catalog.listTables(database) if not t.isTemporary] == ["t"]  # nothing left over


def test_create_if_missing_keeps_content(spark, database):
    df = spark.createDataFrame([(1, 2, 1.5, True, "a")], "a bigint, b int, c float, d boolean, e string")
    catalog.create_if_missing(df, f"{database}.n")
    assert [f.dataType.simpleString() for f in spark.table(f"{database}.n").schema] == [
        "bigint", "int", "double", "boolean", "string"]
    catalog.replace_table(df, f"{database}.n")
    catalog.create_if_missing(df, f"{database}.n")
    assert spark.table(f"{database}.n").count() == 1


def test_inventory_keeps_errors(spark, database, folder):
    catalog.replace_table(spark.range(3), f"{database}.good")
    spark.sql(f"CREATE TABLE {database}.source (id bigint) USING parquet")
    spark.sql(f"CREATE VIEW {database}.broken AS SELECT id FROM {database}.source")
    spark.sql(f"DROP TABLE {database}.source")
    rows = {r["table"]: (r["rows"], r["error"]) for r in catalog.layer_inventory(spark, [database]).collect()}
    assert rows["good"] == (3, None) and rows["broken"][0] is None and "source" in rows["broken"][1]


def test_catalog_views_are_idempotent(spark, database):
    catalog.replace_table(spark.range(3), f"{database}.numbers")
    catalog.create_layers(spark, [f"{database}_bi"])
    for _ in range(2):
        names = catalog.register_catalog_views(spark, f"{database}_bi", [f"{database}.numbers"])
    assert spark.table(names[0]).count() == 3
    spark.sql(f"DROP DATABASE {database}_bi CASCADE")


def test_ingest_skips_and_reports(spark, database, folder):
    spark.createDataFrame([("1", "2020-01-05"), ("2", None)], "ID string, `Tanggal Masuk` string").write.option(
        "header", True).csv(f"{folder}/students")
    spark.createDataFrame([], "a string").coalesce(1).write.option("header", True).csv(f"{folder}/empty")
    manifest = ingest.ingest(
        spark, {" Data-A (x)": f"{folder}/students", "B": f"{folder}/empty", "C": f"{folder}/absent"}, database,
        required=("data_a_x", "d"))
    got = {(r["table"], r["status"], r["rows"]) for r in manifest.collect()}
    assert got == {("data_a_x", "ok", 2), ("b", "skipped", 0), ("c", "skipped", 0), ("d", "missing", 0)}
    assert dict(spark.table(f"{database}.data_a_x").dtypes) == {"ID": "int", "Tanggal Masuk": "date"}


class _Writer:
    """Stands in for a JDBC writer: no database is available here."""

    calls: list = []
    fail = False

    def option(self, *_):
        return self

    def jdbc(self, url, name, mode, properties):
        if self.fail:
            raise OSError("no route")
        self.calls.append((url, name, mode, properties))


def test_jdbc_publishing(spark, database, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    catalog.replace_table(spark.range(3), f"{database}.dim")
    targets = [publish.JdbcTarget(f"{database}.dim", "dim_public")]
    monkeypatch.setattr(DataFrame, "write", property(lambda self: _Writer()))
    assert publish.publish_jdbc(spark, targets, "jdbc:x", {"user": "u"}, "public") == ["public.dim_public"]
    assert _Writer.calls == [("jdbc:x", "public.dim_public", "overwrite", {"user": "u"})]
    monkeypatch.setattr(_Writer, "fail", True)
    with pytest.raises(publish.PublishError, match="dim_public"):
        publish.publish_jdbc(spark, targets, "jdbc:x", {})
    with pytest.raises(ValueError):
        publish.published_source(targets, "secrets")


def test_promotion_gates(spark, database, folder):
    publish.write_files(spark.createDataFrame([(1, "a"), (1, None)], "k int, p string"), f"{folder}/p")
    checks = publish.promote(spark, [publish.Promotion(f"{folder}/p", f"{database}.p", ("k", "p", "missing"))], "k")
    assert {r["gate"]: r["passed"] for r in checks.collect()} == {
        "row_count": True, "unique_key": False, "no_nulls": False, "schema": False}
    assert publish.promotion_status(checks).first()["status"] == "FAIL"


def test_slices(spark, folder):
    old = spark.createDataFrame([("train", 1.0), ("infer", 2.0), (None, 3.0)], "category string, sec double")
    new = spark.createDataFrame([("infer", 9.0)], "category string, sec double")
    got = {tuple(r) for r in publish.replace_slice(old, new, "category", "infer").collect()}
    assert got == {("train", 1.0), ("infer", 9.0), (None, 3.0)}
    old.dropna().write.partitionBy("category").option("header", True).csv(f"{folder}/csv")
    stored = publish.write_csv_slice(spark, f"{folder}/csv", new, "category", "infer")
    assert {(r["category"], r["sec"]) for r in stored.collect()} == {("train", 1.0), ("infer", 9.0)}


MODEL = GaussianNB(("a", "b"), ("x", "y"), (3, 4), (3 / 7, 4 / 7), ((0.0, 1.0), (2.0, 3.0)), ((1.0, 1.0), (2.0, 2.0)))


def test_registry(spark, folder):
    model_id = registry.ModelId("m", "v2", "plain")
    with pytest.raises(registry.ModelNotFound):
        registry.load_model(spark, folder, model_id)
    registry.save_model(spark, folder, model_id, MODEL, {"positive_class": "a"})
    model, metadata = registry.load_model(spark, folder, model_id)
    assert model == MODEL and metadata["class_mapping"] == {"a": 0, "b": 1} and metadata["positive_class"] == "a"
    registry.check_model(model, metadata, ["x", "y"])
    for names, stored in ((["y", "x"], metadata), (["x", "y"], {**metadata, "has_scaler": True}),
                          (["x", "y"], {**metadata, "class_mapping": {"a": 1, "b": 0}})):
        with pytest.raises(registry.ModelMismatch):
            registry.check_model(model, stored, names)
    assert registry.label_order(metadata, ["z"]) == ["a", "b"] and registry.label_order({}, ["z"]) == ["z"]


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert staging.shared_dir(spark) == configured.rstrip("/")
    staged = staging.stage(spark.range(5).withColumn("x", F.lit("a")), "test")
    assert staged.count() == 5 and staged.columns == ["id", "x"]
    (file,) = {f.rsplit("/", 1)[0] for f in staged.inputFiles()}
    assert file.removeprefix("file://").startswith(staging.shared_dir(spark).removeprefix("file:"))


def test_staged_data_can_be_dropped(spark, monkeypatch):
    monkeypatch.setattr(staging, "_staged", [])
    staging.stage(spark.range(3))
    assert staging.drop_staged(spark) == 1 and staging.drop_staged(spark) == 0
