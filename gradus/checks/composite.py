"""Composite reports, gates and whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, gnb, registry, scoring, star as star_ops
from ..operators.features import FeatureSpec, column_verdicts, model_roles
from ..operators.metrics import gate_status, melt, union_all
from ..operators.model_selection import fit_variant
from ..operators.quality import Rule
from ..operators.split import stratified_split
from ..operators.standardize import TableSpec, standardize, standardize_once
from ..plans import flow, layers as layer_plans, modelling
from ..plans.layers import Layers, StarSpec
from ..plans.modelling import ModelSpec
from ..sources.catalog import replace_table
from ..sources.staging import new_path, stage
from .aggregates import AGREEMENT_SQL, SUMMARY_SQL, quality_summaries
from .bindings import FEATURES, KEY, LABEL, LATE, ON_TIME, SPEC, fact, inference, populations, star, table, training
from .joins import keyed_lines, open_orders
from .models import rounded
from .registry import check
from .sql import pivot_metrics, using
from .tables_io import scratch_layers

# ------------------------------------------------------------- the test tables as a raw landing area
ORDERS = TableSpec(
    source="orders_raw", target="orders", key="order_key",
    columns={"Order Key": "order_key", "Status": "status", "Entry Date": "entry_date", "Exit Date": "exit_date"},
    casts={"entry_date": "date", "exit_date": "date", "price_eur": "double"},
    rules=(
        Rule("null_key", "order_key IS NULL"),
        Rule("no_entry_date", "entry_date IS NULL", rejects=True),
        Rule("exit_before_entry", "exit_date < entry_date", rejects=True),
        Rule("status_unknown", "upper(trim(status)) NOT IN ('F', 'O')"),
        Rule("price_high", "price_eur > 400000", info=True),
    ),
)
LINE_COLUMNS = {  # raw name -> column of lineitem
    "Order Key": "l_orderkey", "Line": "l_linenumber", "Part-Key": "l_partkey", "Supp-Key": "l_suppkey",
    "Quantity": "l_quantity", "Extended Price": "l_extendedprice", "Discount": "l_discount", "Tax": "l_tax",
    "Return/Flag": "l_returnflag", "Line Status": "l_linestatus", "Ship Date": "l_shipdate",
}
LINE_PLACE = ("line", "part_key", "supp_key", "quantity", "extended_price", "discount", "tax", "return_flag",
              "line_status", "ship_date")
LINES = TableSpec(
    source="lines_raw", target="lines", key="order_key",
    columns={"Order Key": "order_key", "Line": "line"},
    casts={"line": "int", "part_key": "int", "supp_key": "int", "quantity": "double", "extended_price": "double",
           "discount": "double", "tax": "double", "ship_date": "date"},
    rules=(
        Rule("null_key", "order_key IS NULL", rejects=True),
        Rule("no_quantity", "quantity IS NULL", rejects=True),
        Rule("no_price", "extended_price IS NULL", rejects=True),
        Rule("quantity_negative", "quantity < 0", rejects=True),
        Rule("single_piece", "quantity = 1", info=True),
    ),
)
NATIONS = TableSpec("nations_raw", "nations", {"N_NationKey": "nation_key"})
STAR = StarSpec(
    key="order_key", dim_source="orders", dim_target="dim_order",
    dim_columns=("order_key", "status", "entry_date", "exit_date", "price_eur"),
    fact_source="lines", fact_target="fact_line", fact_columns=("order_key", "quantity", "extended_price"),
    measures=("quantity", "extended_price"), fact_order=LINE_PLACE,
    pass_through={"nations": "nation"},
)
FLOW_FEATURES = FeatureSpec(
    key="order_key", features=("quantity", "extended_price", "order_year", "order_day"),
    measures=("quantity", "extended_price"), status="status", start="entry_date", end="exit_date",
    limit_days=365, on_time=ON_TIME, late=LATE, label="label", training_status="F", inference_status="O",
    derived=(("order_year", "year(entry_date)"), ("order_day", "datediff(entry_date, DATE'1995-01-01')")),
    denied=("entry_date", "exit_date", "status", "price_eur"),
)


def raw_orders(spark, d):
    rows = table(spark, d, "orders").join(fact(spark, d).select(KEY, "l_shipdate"), KEY, "left")
    return rows.select(
        F.col(KEY).cast("string").alias(" Order Key"),
        F.concat(F.lit(" "), F.lower("o_orderstatus"), F.lit("  ")).alias("Status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Entry Date"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Exit Date"),
        F.col("o_totalprice").cast("string").alias("Price (EUR)"),
    )


def raw_lines(spark, d):
    """All line items as text."""
    return table(spark, d, "lineitem").select(*[F.col(c).cast("string").alias(raw) for raw, c in LINE_COLUMNS.items()])


def silver_layer(spark, d):
    """Raw tables stored and standardised in fresh layers."""
    names = Layers(*scratch_layers(spark))
    replace_table(raw_orders(spark, d), f"{names.bronze}.orders_raw")
    replace_table(raw_lines(spark, d), f"{names.bronze}.lines_raw")
    replace_table(table(spark, d, "nation"), f"{names.bronze}.nations_raw")
    return names, layer_plans.standardize_layer(spark, (ORDERS, LINES, NATIONS), names)


# ------------------------------------------------------------------------------ Q: composite reports

_OVERLAP_SQL = """
  SELECT 'key_overlap' AS subject, unnest(['left_keys', 'right_keys', 'right_only', 'left_only', 'both']) AS metric,
    unnest([(SELECT count(*) FROM a), (SELECT count(*) FROM b),
            (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)),
            (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)),
            (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b))])::BIGINT AS value
  FROM (SELECT 1)"""


@check("q1_quality_report", using("joined", f"""
  , summary AS ({SUMMARY_SQL}),
  a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
  SELECT "table" AS subject, unnest(['initial', 'valid', 'invalid', 'excluded']) AS metric,
         unnest([initial, valid, invalid, excluded])::BIGINT AS value FROM summary
  UNION ALL {_OVERLAP_SQL}""").replace(")\n\n  , summary", "),\n summary"))
def quality_report(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", KEY)
    return layer_plans.quality_report(quality_summaries(spark, d), table(spark, d, "orders"), lines, KEY)


_STAR_NAMES = ("dim_total dim_distinct dim_duplicate dim_null_key fact_total fact_distinct fact_duplicate fact_null_key "
               "fact_null_{0} fact_null_{1} orphan_fact dim_without_fact join_total matched non_matched row_multiplication")


def star_sql(dims: str, facts: str, key: str, a: str, b: str) -> str:
    """The sixteen star figures as rows, joins done the plain way."""
    one = f"""(SELECT dt AS dim_total, dd AS dim_distinct, dt - dd AS dim_duplicate, dn AS dim_null_key,
      ft AS fact_total, fd AS fact_distinct, ft - fd AS fact_duplicate, fn AS fact_null_key,
      fa AS fact_null_{a}, fb AS fact_null_{b}, orphan AS orphan_fact, lone AS dim_without_fact,
      jt AS join_total, jm AS matched, jt - jm AS non_matched, jt - dt AS row_multiplication
      FROM (SELECT count(*) AS dt, count(DISTINCT {key}) + coalesce(max(({key} IS NULL)::INTEGER), 0) AS dd,
                   count(*) FILTER ({key} IS NULL) AS dn FROM {dims}),
           (SELECT count(*) AS ft, count(DISTINCT {key}) + coalesce(max(({key} IS NULL)::INTEGER), 0) AS fd,
                   count(*) FILTER ({key} IS NULL) AS fn, count(*) - count({a}) AS fa, count(*) - count({b}) AS fb
            FROM {facts}),
           (SELECT count(*) AS orphan FROM {facts} f
            WHERE NOT EXISTS (SELECT 1 FROM {dims} d WHERE d.{key} = f.{key})),
           (SELECT count(*) AS lone FROM {dims} d
            WHERE NOT EXISTS (SELECT 1 FROM {facts} f WHERE d.{key} = f.{key})),
           (SELECT count(*) AS jt, count(f.{a}) AS jm FROM {dims} d LEFT JOIN {facts} f ON d.{key} = f.{key}))"""
    return pivot_metrics(one, _STAR_NAMES.format(a, b), "star")


@check("q2_star_metrics", """
  WITH dims AS (SELECT * REPLACE (nullif(o_orderkey, 7) AS o_orderkey) FROM orders WHERE o_orderstatus <> 'P'),
  lines AS (SELECT nullif(l_orderkey, 7) AS o_orderkey, l_quantity, l_extendedprice FROM lineitem)
  """ + star_sql("dims", "lines", "o_orderkey", "l_quantity", "l_extendedprice"))
def star_metrics(spark, d):
    return melt(star_ops.star_metrics(
        open_orders(spark, d), keyed_lines(spark, d), KEY, ["l_quantity", "l_extendedprice"]), "star")


@check("q2_star_gates", """
  SELECT gate, passed FROM (
    SELECT unnest(['dim_grain', 'fact_grain', 'grain', 'referential_integrity', 'join']) AS gate,
           unnest([dim, fact, dim AND fact, orphan = 0, NOT EXISTS (SELECT 1 FROM lineitem l JOIN orders USING_KEY)]) AS passed
    FROM (SELECT count(*) = count(DISTINCT o_orderkey) AS dim FROM orders),
         (SELECT count(*) = count(DISTINCT l_orderkey) AS fact FROM lineitem),
         (SELECT count(*) AS orphan FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)))""".replace(
    "JOIN orders USING_KEY", "JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY l_orderkey HAVING count(*) > 1"))
def star_gates(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", KEY)
    return star_ops.star_gates(star_ops.star_metrics(
        table(spark, d, "orders"), lines, KEY, ["l_quantity", "l_extendedprice"]))


_FEATURE_REPORT_SQL = """
  SELECT 'training' AS subject, m AS metric, v::BIGINT AS value FROM (
    SELECT unnest(['initial', 'valid', 'duplicate_rows', 'without_measures', 'incomplete', 'label_on_time',
                   'label_late', 'days_unknown', 'written', 'null_features', 'duplicate_keys']) AS m,
           unnest([a.n, t.n, 0, a.bare, a.n - t.n, a.on_time, a.n - a.on_time, a.unknown, t.n, 0, 0]) AS v
    FROM (SELECT count(*) AS n, count(*) FILTER (l_quantity IS NULL OR l_extendedprice IS NULL) AS bare,
                 count(*) FILTER (label = 'On time') AS on_time, count(*) FILTER (days IS NULL) AS unknown
          FROM labelled) a, (SELECT count(*) AS n FROM train) t)
  UNION ALL
  SELECT 'inference', m, v::BIGINT FROM (
    SELECT unnest(['initial', 'valid', 'duplicate_rows', 'without_measures', 'incomplete', 'written',
                   'null_features', 'duplicate_keys']) AS m,
           unnest([a.n, t.n, 0, a.bare, a.n - t.n, t.n, 0, 0]) AS v
    FROM (SELECT count(*) AS n, count(*) FILTER (l_quantity IS NULL OR l_extendedprice IS NULL) AS bare
          FROM star WHERE o_orderstatus = 'O') a, (SELECT count(*) AS n FROM infer) t)"""


@check("q3_feature_report", using("train infer", _FEATURE_REPORT_SQL))
def feature_report(spark, d):
    joined = stage(star(spark, d), "star")
    return layer_plans.feature_report(joined, *layer_plans.feature_sets(joined, SPEC), SPEC)


_PREDICTION_GATES = "['row_count', 'unique_key', 'no_nulls', 'coverage', 'no_denied_columns', 'grain']"


@check("q4_prediction_gates", using("predicted infer", f"""
  SELECT unnest({_PREDICTION_GATES}) AS gate, unnest([p.n = i.n, p.n = p.keys, p.n = p.filled, p.n = i.n AND p.keys = i.n,
         true, p.n = p.keys]) AS passed
  FROM (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, count(prediction) AS filled FROM predicted) p,
       (SELECT count(*) AS n FROM infer) i"""))
def prediction_gates(spark, d):
    rows, inputs = populations(spark, d)
    rows = scoring.batch_predictions(inputs, gnb.fit(rows, FEATURES, LABEL), KEY, "v2", "plain")
    facts = scoring.prediction_facts(rows, inputs, KEY, [KEY, *FEATURES, "prediction", "model_variant"], SPEC.denied)
    return scoring.prediction_gates(facts)


@check("q4_prediction_gates_catch", """
  SELECT unnest(['row_count', 'unique_key', 'no_nulls', 'coverage', 'no_denied_columns', 'grain']) AS gate,
         unnest([l.n = o.n, l.n = l.keys, l.n = l.filled, l.n = o.n AND l.missing = 0, false, l.n = l.keys]) AS passed
  FROM (SELECT count(*) AS n, count(DISTINCT l_orderkey) AS keys, count(nullif(l_linestatus, 'O')) AS filled,
               (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS missing
        FROM lineitem) l, (SELECT count(*) AS n FROM orders) o""")
def prediction_gates_catch(spark, d):
    """Unfit predictions: several per key, without label, inputs uncovered, a denied column."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias(KEY), F.nullif("l_linestatus", F.lit("O")).alias("prediction"), "l_shipdate")
    facts = scoring.prediction_facts(lines, table(spark, d, "orders"), KEY, [KEY, "prediction"], SPEC.denied)
    return scoring.prediction_gates(facts)


@check("q5_table_gates", """
  SELECT unnest(['row_count', 'unique_key', 'no_nulls', 'schema']) AS gate,
         unnest([n = (SELECT count(*) FROM orders), n = keys, n = filled, false]) AS passed
  FROM (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, count(nullif(o_orderstatus, 'P')) AS filled FROM orders)""")
def table_gates(spark, d):
    orders = table(spark, d, "orders")
    stored = stage(orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))), "stored")
    return scoring.table_gates(scoring.table_facts(stored, KEY, [KEY, "o_orderstatus", "o_comment"], orders.count()))


@check("q5_truncated_table", """
  SELECT unnest(['row_count', 'unique_key', 'no_nulls', 'schema']) AS gate,
         unnest([left_over = n, left_over = keys, left_over = filled, true]) AS passed
  FROM (SELECT count(*) AS n FROM orders),
       (SELECT count(*) AS left_over, count(DISTINCT o_orderkey) AS keys, count(o_orderstatus) AS filled
        FROM orders WHERE o_orderstatus <> 'P')""")
def truncated_table(spark, d):
    """The stored part lacks orders that the source has: its row count must fail."""
    orders = table(spark, d, "orders").select(KEY, "o_orderstatus")
    stored = stage(orders.filter("o_orderstatus <> 'P'"), "truncated")
    return scoring.table_gates(scoring.table_facts(stored, KEY, [KEY, "o_orderstatus"], F.lit(orders.count())))


@check("q6_input_gates", using("infer", """
  SELECT unnest(['features_present', 'no_extra_columns', 'features_filled', 'key_filled', 'key_unique', 'grain']) AS gate,
         unnest([true, true, n = filled, n = keyed, n = keys, n = keys]) AS passed
  FROM (SELECT count(*) AS n, count(l_quantity) AS filled, count(o_orderkey) AS keyed,
               count(DISTINCT o_orderkey) AS keys FROM infer)"""))
def input_gates(spark, d):
    rows = inference(spark, d)
    return scoring.input_gates(scoring.input_facts(rows, KEY, FEATURES), rows.columns, KEY, FEATURES)


# ----------------------------------------------------------------------------------- X: whole flows

_RAW_SUMMARY_SQL = """
  SELECT 'orders' AS "table", count(*)::BIGINT AS initial, count(*) FILTER (days IS NULL OR days >= 0)::BIGINT AS valid,
         (count(*) FILTER (days < 0) + count(*) FILTER (o_orderstatus NOT IN ('F', 'O')))::BIGINT AS invalid,
         count(*) FILTER (days < 0)::BIGINT AS excluded FROM joined
  UNION ALL SELECT 'lines', count(*), count(*), count(*) - count(DISTINCT l_orderkey), 0 FROM lineitem"""


@check("x1_standardized_tables", using("joined", _RAW_SUMMARY_SQL))
def standardized_tables(spark, d):
    return standardize(raw_orders(spark, d), ORDERS).summary.unionByName(
        standardize(raw_lines(spark, d), LINES).summary)


@check("x1_one_pass_summary", using("joined", _RAW_SUMMARY_SQL))
def one_pass_summary(spark, d):
    """The same figures, taken while the typed rows are written."""
    return standardize_once(raw_orders(spark, d), ORDERS, stage).summary.unionByName(
        standardize_once(raw_lines(spark, d), LINES, stage).summary)


@check("x1_rejected_rows", using("joined", """
  SELECT o_orderkey::VARCHAR AS key, 'exit_before_entry' AS reason FROM joined WHERE days < 0"""))
def rejected_rows(spark, d):
    return standardize(raw_orders(spark, d), ORDERS).rejected


@check("x1_one_pass_rejected", using("joined", """
  SELECT 'rejected' AS kind, o_orderkey::VARCHAR AS key, 'exit_before_entry' AS reason FROM joined WHERE days < 0
  UNION ALL SELECT 'kept', o_orderkey::VARCHAR, NULL FROM joined WHERE days IS NULL OR days >= 0"""))
def one_pass_rejected(spark, d):
    """Rejected and accepted rows of one pass: every raw row is one or the other."""
    done = standardize_once(raw_orders(spark, d), ORDERS, stage)
    return done.rejected.select(F.lit("rejected").alias("kind"), F.col("key").cast("string").alias("key"), "reason").unionByName(
        done.rows.select(F.lit("kept").alias("kind"), F.col(ORDERS.key).cast("string").alias("key"), F.lit(None).cast("string").alias("reason")))


@check("x2_star_layer", using("star", star_sql("star", "fact", "o_orderkey", "l_quantity", "l_extendedprice")).replace(
    "'fact_null_l_quantity'", "'fact_null_quantity'").replace("'fact_null_l_extendedprice'", "'fact_null_extended_price'"))
def star_layer(spark, d):
    names, _ = silver_layer(spark, d)
    return melt(layer_plans.star_layer(spark, STAR, names)["metrics"], "star")


@check("x3_feature_layer", using("train infer", _FEATURE_REPORT_SQL))
def feature_layer(spark, d):
    names = Layers(*scratch_layers(spark))
    dim = standardize(raw_orders(spark, d), ORDERS).rows
    replace_table(star_ops.one_row_per_key(dim, STAR.key, STAR.dim_columns), f"{names.gold}.{STAR.dim_target}")
    lines = standardize(raw_lines(spark, d), LINES).rows
    replace_table(star_ops.one_row_per_key(lines, STAR.key, STAR.fact_columns, STAR.fact_order),
                  f"{names.gold}.{STAR.fact_target}")
    return layer_plans.feature_layer(spark, STAR, FLOW_FEATURES, names)["report"]


MODEL = ModelSpec(key=KEY, features=FEATURES, label=LABEL, positive=ON_TIME, name="delivery", version="v2")
_TRAINING_GATES = [
    "dataset_read", "feature_schema", "label_schema", "no_leakage", "holdout_share", "folds_complete", "cv_metrics",
    "holdout_scored", "confusion_matrix", "final_model", "model_saved", "model_loaded", "smoke_test", "no_scaler",
]


@check("m21_training_gates", using("train", f"""
  SELECT variant, gate, count(*) > 0 AS passed
  FROM (SELECT unnest(['without_smote', 'with_smote']) AS variant), (SELECT unnest({_TRAINING_GATES}) AS gate), train
  GROUP BY 1, 2"""))
def training_gates(spark, d):
    return modelling.train_variants(spark, training(spark, d), MODEL, new_path(spark, "registry"))["gates"]


@check("m21_spoilt_training", using("train", """
  SELECT unnest(['dataset_read', 'feature_schema', 'label_schema', 'no_leakage', 'holdout_share', 'folds_complete', 'cv_metrics',
                 'holdout_scored', 'confusion_matrix', 'final_model', 'model_saved', 'model_loaded', 'smoke_test', 'no_scaler']) AS gate,
         unnest([n > 0, true, true, false, ceil(0.3 * n) = ceil(0.2 * n), folds = 10, true,
                 true, false, on_time = n, true, true, true, true]) AS passed
  FROM (SELECT count(*) AS n, count(*) FILTER (label = 'On time') AS on_time, least(count(*), 5) AS folds FROM train)"""))
def spoilt_training(spark, d):
    """A run that held out too much in too few folds, lost a class's predictions, was refitted on one class and saw a date."""
    rows = training(spark, d)
    split = stratified_split(rows, KEY, LABEL, test_share=0.3, folds=5)
    used = star(spark, d).select("o_orderdate", *rows.columns[:1])
    leaks = [c for c, v in column_verdicts(used.schema, model_roles(FEATURES, KEY, [LABEL])) if v == "unexpected"]
    parts = split.with_part(rows)
    held_out, on_time = F.col("part") == "test", F.col(LABEL) == ON_TIME
    facts = parts.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(held_out).alias("test_rows"), F.count_if(held_out & ~on_time).alias("confusion_total"),
        F.count_if(on_time).alias("final_rows")).crossJoin(split.with_fold(rows).agg(F.count_distinct("fold").cast("int").alias("folds")))
    known = {"features_match": True, "label_matches": True, "leaking_columns": len(leaks), "cv_metrics": len(evaluate.METRICS),
             "holdout_accuracy": 0.5, "saved": True, "loaded": True, "smoke_ok": True, "has_scaler": False}
    return evaluate.training_gates(facts.select("*", *(F.lit(v).alias(k) for k, v in known.items())), 10, 0.2)


@check("x4_two_variants", using("fold_metrics smote_fold_metrics", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(a, 6) AS without_smote, round(b, 6) AS with_smote, "
    f"CASE WHEN a > b THEN 'without_smote' WHEN b > a THEN 'with_smote' ELSE 'seri' END AS winner "
    f"FROM (SELECT (SELECT avg({m}) FROM fold_metrics) AS a, (SELECT avg({m}) FROM smote_fold_metrics) AS b)"
    for m in evaluate.METRICS)))
def two_variants(spark, d):
    result = modelling.train_variants(spark, training(spark, d), MODEL, new_path(spark, "registry"))
    return rounded(result["cross_validation"], "without_smote", "with_smote")


@check("x5_inference_run", using("compared", AGREEMENT_SQL.replace(
    "SELECT count(*)", "SELECT 'SUCCESS' AS status, count(*)", 1) + "compared"))
def inference_run(spark, d):
    root, (rows, inputs) = new_path(spark, "registry"), populations(spark, d)
    for variant, oversample in modelling.VARIANTS:
        registry.save_model(spark, root, MODEL.model_id(variant), fit_variant(rows, KEY, FEATURES, LABEL, oversample))
    result = modelling.run_inference(spark, inputs, MODEL, root, new_path(spark, "predictions"), SPEC.denied)
    return result["agreement"].select(F.lit(result["status"]).alias("status"), "*")


@check("x5_written_distribution", using("predicted smote_predicted", """
  SELECT subject, label, count(*)::BIGINT AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY subject), 6) AS percent
  FROM (SELECT 'without_smote' AS subject, prediction AS label FROM predicted
        UNION ALL SELECT 'with_smote', prediction FROM smote_predicted) GROUP BY 1, 2"""))
def written_distribution(spark, d):
    """The label counts of an inference run, from the report that it has written."""
    root, output, (rows, inputs) = new_path(spark, "registry"), new_path(spark, "predictions"), populations(spark, d)
    for variant, oversample in modelling.VARIANTS:
        registry.save_model(spark, root, MODEL.model_id(variant), fit_variant(rows, KEY, FEATURES, LABEL, oversample))
    modelling.run_inference(spark, inputs, MODEL, root, output, SPEC.denied)
    written = spark.read.schema("subject string, label string, n bigint, percent double").json(f"{output}/reports/distribution")
    return rounded(written, "percent")


@check("x6_end_to_end", using("train infer", _FEATURE_REPORT_SQL + """
  UNION ALL SELECT 'manifest', 'order_data', count(*) FROM orders
  UNION ALL SELECT 'manifest', 'line_data', count(*) FROM lineitem
  UNION ALL SELECT 'gates', 'passed', 5 - (EXISTS (SELECT 1 FROM joined WHERE days < 0))::INTEGER"""))
def end_to_end(spark, d):
    sources = {}
    for name, frame in (("Order Data", raw_orders(spark, d)), ("Line-Data", raw_lines(spark, d))):
        sources[name] = new_path(spark, "landing")
        frame.write.option("header", True).csv(sources[name])
    known = {"Order Data": "orders_raw", "Line-Data": "lines_raw"}
    spec = flow.FlowSpec((ORDERS, LINES, NATIONS), STAR, FLOW_FEATURES, known, Layers(*scratch_layers(spark)))
    reports = flow.run(spark, spec, sources, reports=new_path(spark, "reports"))
    manifest = reports["manifest"].select(
        F.lit("manifest").alias("subject"),
        F.translate(F.lower("source"), " -", "__").alias("metric"), F.col("rows").alias("value"))
    passed = gate_status(reports["star_gates"]).select(
        F.lit("gates").alias("subject"), F.lit("passed").alias("metric"), F.col("passed").alias("value"))
    return union_all([reports["features"], manifest, passed])
