"""Sources, sinks and catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.names import table_name_expr
from ..operators import quality, scoring
from ..operators.gnb import fit
from ..sources import catalog, ingest, publish
from ..sources.staging import new_path, shared_dir
from .bindings import FEATURES, KEY, LABEL, TABLES, populations, table
from .registry import check
from .sql import using


def scratch_layers(spark) -> list[str]:
    """Four fresh namespaces below the shared folder, named like the layers."""
    tag = uuid.uuid4().hex[:8]
    layers = [f"{layer}_{tag}" for layer in catalog.LAYERS]
    catalog.create_layers(spark, layers, f"{shared_dir(spark)}/warehouse")
    return layers


def customer_layers(spark, d):
    """The customers carried through all four layers; returns the layer names and tables."""
    layers = scratch_layers(spark)
    customers = table(spark, d, "customer")
    names = [f"{layer}.customers" for layer in layers]
    catalog.replace_table(customers, names[0])
    catalog.replace_table(spark.table(names[0]).filter("c_acctbal >= 0"), names[1])
    catalog.replace_table(
        spark.table(names[1]).select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), names[2],
        comment="one row per c_custkey")
    catalog.replace_table(
        spark.table(names[2]).filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal"), names[3])
    return layers, names


def plain_layer(column: str = "layer"):
    """Layer name without its unique tag."""
    return F.regexp_replace(column, "_[0-9a-f]{8}$", "")


_LAYER_SQL = """
  SELECT 'bronze' AS layer, count(*)::BIGINT AS rows, 0 AS step FROM customer
  UNION ALL SELECT 'silver', count(*)::BIGINT, 1 FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT 'gold', count(*)::BIGINT, 2 FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT 'feature_store', count(*)::BIGINT, 3 FROM customer
            WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'"""


@check("s1_raw_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t})::BIGINT AS rows, "
    f"(SELECT count(*) FROM (DESCRIBE {t}))::INTEGER AS columns" for t in TABLES))
def raw_tables(spark, d):
    opened = ingest.open_sources(spark, {t: f"{d}/{t}.parquet" for t in TABLES}, fmt="parquet")
    return ingest.manifest(spark, opened).select("table", "rows", "columns")


@check("s1_csv_header_inferred", """
  SELECT c_mktsegment, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS balance,
         sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1""")
def csv_ingest(spark, d):
    path = new_path(spark, "landing")
    table(spark, d, "customer").write.option("header", True).csv(path)
    database = scratch_layers(spark)[0]
    ingest.ingest(spark, {"Data Customer (raw)": path}, database, known={"Data Customer (raw)": "customers"})
    return spark.table(f"{database}.customers").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"),
        F.sum("c_custkey").alias("keys"))


@check("s2_table_names", """
  SELECT DISTINCT p_brand || ' - ' || p_type || ' (' || p_name || ')' AS source,
         translate(lower(trim(p_brand || ' - ' || p_type || ' (' || p_name || ')')), ' -/()', '___') AS table_name
  FROM part""")
def table_names(spark, d):
    source = F.concat("p_brand", F.lit(" - "), "p_type", F.lit(" ("), "p_name", F.lit(")"))
    return table(spark, d, "part").select(source.alias("source")).distinct().withColumn(
        "table_name", table_name_expr(F.col("source")))


@check("s3_ingest_manifest", """
  SELECT 'Order Data' AS source, 'order_data' AS "table", 'ok' AS status, '' AS reason,
         count(*)::BIGINT AS rows, 6::INTEGER AS columns FROM orders
  UNION ALL SELECT 'Empty', 'empty', 'skipped', 'no rows', 0, 3
  UNION ALL SELECT 'Nowhere', 'nowhere', 'skipped', 'unreadable: PATH_NOT_FOUND', 0, 0
  UNION ALL SELECT '', 'needed', 'missing', 'required source not found', 0, 0""")
def ingest_manifest(spark, d):
    empty = new_path(spark, "empty")
    table(spark, d, "nation").filter("n_nationkey < 0").write.parquet(empty)
    opened = ingest.open_sources(spark, {
        "Order Data": f"{d}/orders.parquet", "Empty": empty, "Nowhere": f"{d}/no_such_table.parquet",
    }, fmt="parquet")
    return ingest.manifest(spark, opened, required=("needed", "order_data")).na.fill("", ["source", "reason"])


@check("s4_table_scan", """
  SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000""")
def table_scan(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 100000").select(
        "o_orderkey", "o_orderpriority")


@check("s5_full_replace", """
  SELECT c_nationkey, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS balance
  FROM customer WHERE c_acctbal >= 0 GROUP BY 1""")
def full_replace(spark, d):
    name = f"{scratch_layers(spark)[1]}.customers"
    catalog.replace_table(table(spark, d, "customer"), name)
    catalog.replace_table(spark.table(name).filter("c_acctbal >= 0"), name)  # a query over itself
    return spark.table(name).groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@check("s6_create_if_missing", """
  SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
           WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'double' WHEN 'BOOLEAN' THEN 'boolean'
           ELSE 'string' END AS stored_type
  FROM (DESCRIBE lineitem)""")
def create_if_missing(spark, d):
    name = f"{scratch_layers(spark)[3]}.lines"
    catalog.create_if_missing(table(spark, d, "lineitem"), name)
    catalog.create_if_missing(table(spark, d, "orders"), name)  # already there: stays as it is
    return spark.sql(f"DESCRIBE TABLE {name}").select(
        F.col("col_name").alias("column_name"), F.col("data_type").alias("stored_type"))


@check("s7_layer_namespaces", """
  SELECT layer, count(*)::BIGINT AS tables FROM (
    SELECT 'bronze' AS layer FROM (SELECT 1 FROM customer LIMIT 1)
    UNION ALL SELECT 'silver' UNION ALL SELECT 'gold' UNION ALL SELECT 'feature_store') GROUP BY 1""")
def layer_namespaces(spark, d):
    layers, _ = customer_layers(spark, d)
    catalog.create_layers(spark, layers)  # again: nothing happens
    return catalog.layer_inventory(spark, layers).groupBy(plain_layer().alias("layer")).agg(
        F.count(F.lit(1)).alias("tables"))


@check("s8_table_exists", """
  SELECT 'customers' AS "table", true AS present, count(*)::BIGINT AS rows FROM customer
  UNION ALL SELECT 'absent', false, 0""")
def table_exists(spark, d):
    name = f"{scratch_layers(spark)[0]}.customers"
    catalog.replace_table(table(spark, d, "customer"), name)
    absent = name.replace("customers", "absent")
    return catalog.row_count(spark.table(name)).select(F.inline(F.array(
        F.struct(F.lit("customers").alias("table"), F.lit(catalog.table_exists(spark, name)).alias("present"),
                 F.col("rows").alias("rows")),
        F.struct(F.lit("absent").alias("table"), F.lit(catalog.table_exists(spark, absent)).alias("present"),
                 F.lit(0).cast("bigint").alias("rows")),
    )))


@check("s9_table_comment", """
  SELECT 'one row per c_custkey' AS comment, count(*)::BIGINT AS rows FROM customer WHERE c_acctbal >= 0""")
def table_comment(spark, d):
    _, names = customer_layers(spark, d)
    return catalog.row_count(spark.table(names[2])).select(
        F.lit(catalog.table_comment(spark, names[2])).alias("comment"), "rows")


@check("s12_prediction_files", using("predicted", """
  SELECT prediction, count(*)::BIGINT AS n, round(avg(probability), 6) AS probability FROM predicted GROUP BY 1"""))
def prediction_files(spark, d):
    rows, open_rows = populations(spark, d)
    rows = scoring.batch_predictions(open_rows, fit(rows, FEATURES, LABEL), KEY, "v1", "plain")
    stored = publish.write_files(rows, new_path(spark, "predictions"))
    return stored.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("probability"), 6).alias("probability"))


@check("s13_promoted_tables", using("predicted", """
  SELECT t AS "table", gate, ok AS passed
  FROM (SELECT unnest(['predictions', 'keys']) AS t),
       (SELECT unnest(['row_count', 'unique_key', 'no_nulls', 'schema']) AS gate),
       (SELECT count(*) = count(DISTINCT o_orderkey) AND count(*) = count(prediction) AS ok FROM predicted)"""))
def promoted_tables(spark, d):
    rows, open_rows = populations(spark, d)
    rows = publish.write_files(scoring.batch_predictions(
        open_rows, fit(rows, FEATURES, LABEL), KEY, "v1", "plain"), new_path(spark, "predictions"))
    keys_path, store = new_path(spark, "keys"), scratch_layers(spark)[3]
    publish.write_files(rows.select(KEY, "prediction"), keys_path)
    checks = publish.promote(spark, [
        publish.Promotion(rows.inputFiles()[0].rsplit("/", 1)[0], f"{store}.predictions", tuple(rows.columns)),
        publish.Promotion(keys_path, f"{store}.keys", (KEY, "prediction")),
    ], KEY)
    return checks.withColumn("table", F.element_at(F.split("table", r"\."), -1))


@check("s14_reload_check", """
  SELECT 'bronze' AS layer, count(*)::BIGINT AS rows,
         'c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey' AS columns FROM customer
  UNION ALL SELECT 'feature_store', count(*)::BIGINT, 'c_acctbal,c_custkey' FROM customer
            WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'""")
def reload_check(spark, d):
    _, names = customer_layers(spark, d)
    return catalog.reload_check(spark, [names[0], names[3]]).select(
        plain_layer(F.element_at(F.split("table", r"\."), 1)).alias("layer"), "rows", "columns")


@check("s15_json_report", """
  SELECT 'nulls' AS subject, column_name AS metric, 0::BIGINT AS value FROM (DESCRIBE customer)
  UNION ALL SELECT 'rows', 'customer', count(*) FROM customer""")
def json_report(spark, d):
    customers = table(spark, d, "customer")
    report = quality.null_counts(customers).unionByName(
        catalog.row_count(customers).select(
            F.lit("rows").alias("subject"), F.lit("customer").alias("metric"), F.col("rows").alias("value")))
    path = new_path(spark, "report")
    publish.write_report(report, path)
    return spark.read.schema("subject string, metric string, value bigint").json(path)


@check("s16_layer_inventory", f"""
  SELECT layer, 'customers' AS "table", rows, '' AS error FROM ({_LAYER_SQL})""")
def layer_inventory(spark, d):
    layers, _ = customer_layers(spark, d)
    return catalog.layer_inventory(spark, layers).withColumn("layer", plain_layer()).na.fill("", ["error"])


@check("s17_layer_reconcile", f"""
  SELECT step::INTEGER AS step, layer, rows, coalesce(lag(rows) OVER (ORDER BY step) - rows, 0)::BIGINT AS lost
  FROM ({_LAYER_SQL})""")
def layer_reconcile(spark, d):
    layers, names = customer_layers(spark, d)
    rows = catalog.reconcile({layer: spark.table(name) for layer, name in zip(layers, names)})
    return rows.withColumn("layer", plain_layer()).na.fill(0, ["lost"])


@check("s18_sql_over_tables", """
  SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 1""")
def sql_over_tables(spark, d):
    _, names = customer_layers(spark, d)
    return spark.sql(f"SELECT c_mktsegment, count(*) AS n FROM {names[2]} GROUP BY c_mktsegment")


@check("s19_registered_views", """
  SELECT n_name, count(*)::BIGINT AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def registered_views(spark, d):
    tag = uuid.uuid4().hex[:8]
    frames = {f"{t}_{tag}": table(spark, d, t) for t in ("customer", "nation")}
    catalog.register_views(spark, frames)
    c, n = catalog.register_views(spark, frames)  # registering again changes nothing
    return spark.sql(
        f"SELECT n_name, count(*) AS customers FROM {c} JOIN {n} ON c_nationkey = n_nationkey GROUP BY n_name")


_SLICE_SQL = """
  SELECT event_type, count(*)::BIGINT AS n,
         round(CASE WHEN event_type = 'click' THEN avg(value) * 2 ELSE avg(value) END, 6) AS mean
  FROM events GROUP BY 1"""


def _event_means(events, factor):
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("value") * F.lit(factor)).alias("mean"))


@check("s20_replace_slice", _SLICE_SQL)
def replace_slice(spark, d):
    events = table(spark, d, "events")
    new = _event_means(events.filter("event_type = 'click'"), 2)
    kept = publish.replace_slice(_event_means(events, 1), new, "event_type", "click")
    return kept.withColumn("mean", F.round("mean", 6))


@check("s20_csv_slice", _SLICE_SQL)
def csv_slice(spark, d):
    events, path = table(spark, d, "events"), new_path(spark, "timings")
    _event_means(events, 1).write.partitionBy("event_type").option("header", True).csv(path)
    again = _event_means(events.filter("event_type = 'click'"), 2)
    stored = publish.write_csv_slice(spark, path, again, "event_type", "click")
    return stored.select("event_type", F.col("n").cast("bigint").alias("n"), F.round("mean", 6).alias("mean"))


