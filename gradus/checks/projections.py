"""Projections, filters, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.casts import lenient_cast
from ..functions.names import clean_name_expr
from ..operators import features, quality, scoring, standardize, star as star_ops
from ..operators.features import FeatureSpec
from ..operators.metrics import count_where
from ..operators.profile import value_probes
from ..operators.quality import Rule
from .bindings import FEATURES, KEY, LABEL, SPEC, inference, joined, star, table, training
from .registry import check
from .sql import using


@check("p1_rename_by_spec", """
  SELECT c_custkey AS customer_id, c_name AS name_of_customer, c_nationkey, c_acctbal AS acct_bal_eur, c_mktsegment
  FROM customer""")
def rename_by_spec(spark, d):
    raw = table(spark, d, "customer").toDF(" C CustKey ", "c_name", "C_NationKey", "Acct-Bal (EUR)", "c/mktsegment")
    return standardize.rename_columns(raw, {"c custkey": "customer_id", "C_NAME": "name_of_customer"})


@check("p2_clean_names", """
  SELECT DISTINCT p_brand || '/' || p_type || ' (x)' AS source,
         regexp_replace(translate(lower(trim(p_brand || '/' || p_type || ' (x)')), ' -/()', '___'),
                        '[^A-Za-z0-9_]', '', 'g') AS clean
  FROM part""")
def clean_names(spark, d):
    source = F.concat("p_brand", F.lit("/"), "p_type", F.lit(" (x)"))
    return table(spark, d, "part").select(source.alias("source")).distinct().withColumn(
        "clean", clean_name_expr(F.col("source")))


@check("p3_trim_strings", """
  SELECT c_custkey, c_name, c_mktsegment || chr(9) AS c_mktsegment FROM customer""")
def trim_strings(spark, d):
    padded = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"),
        F.concat(F.lit(" "), "c_mktsegment", F.lit("\t")).alias("c_mktsegment"))
    return standardize.trim_strings(padded)


@check("p4_drop_empty_rows", """
  SELECT count(*)::BIGINT AS rows, count(segment)::BIGINT AS segments, count(nation)::BIGINT AS nations
  FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS segment, nullif(c_nationkey, 3) AS nation FROM customer)
  WHERE segment IS NOT NULL OR nation IS NOT NULL""")
def drop_empty_rows(spark, d):
    rows = table(spark, d, "customer").select(
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.nullif("c_nationkey", F.lit(3)).alias("nation"))
    return standardize.drop_empty_rows(rows).agg(
        F.count(F.lit(1)).alias("rows"), F.count("segment").alias("segments"), F.count("nation").alias("nations"))


@check("p5_lenient_casts", """
  SELECT o_orderkey, trunc(o_totalprice)::INTEGER AS price, o_orderkey::DOUBLE AS as_double,
         strftime(o_orderdate, '%Y-%m-%d') AS day, (o_orderstatus = 'F')::INTEGER AS readable
  FROM orders""")
def lenient_casts(spark, d):
    raw = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderkey").cast("string").alias("as_double"),
        F.col("o_orderdate").cast("string").alias("day"),
        F.when(F.col("o_orderstatus") == "F", F.lit("7.9")).otherwise(F.col("o_orderpriority")).alias("mixed"))
    typed = standardize.apply_casts(raw, {"price": "int", "as_double": "double", "day": "date"})
    return typed.select(
        "o_orderkey", "price", "as_double", F.col("day").cast("string").alias("day"),
        lenient_cast(F.col("mixed"), "int").isNotNull().cast("int").alias("readable"))


@check("p6_normalized_status", """
  SELECT o_orderstatus AS status_normalized, count(*)::BIGINT AS n FROM orders GROUP BY 1""")
def normalized_status(spark, d):
    messy = table(spark, d, "orders").select(F.concat(F.lit("  "), F.lower("o_orderstatus"), F.lit(" ")).alias("status"))
    return quality.group_counts(standardize.add_normalized(messy, "status"), "status_normalized")


@check("p7_required_field", using("joined", "SELECT o_orderkey FROM joined WHERE l_shipdate IS NOT NULL"))
def required_field(spark, d):
    rule = Rule("no_ship_date", "l_shipdate IS NULL", rejects=True)
    return quality.accepted_rows(joined(spark, d), [rule]).select(KEY)


@check("p8_date_order", using("star", "SELECT o_orderkey, o_orderstatus FROM star"))
def date_order(spark, d):
    rule = Rule("shipped_before_order", "l_shipdate < o_orderdate", rejects=True)
    return quality.accepted_rows(joined(spark, d), [rule]).select(KEY, "o_orderstatus")


@check("p9_range_null_passes", """
  SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal END AS b FROM customer)
  WHERE b IS NULL OR b BETWEEN 0 AND 5000""")
def range_null_passes(spark, d):
    rows = table(spark, d, "customer").withColumn(
        "b", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal")))
    return quality.accepted_rows(rows, [Rule("out_of_range", "b < 0 OR b > 5000", rejects=True)]).select("c_custkey")


LINE_RULES = (
    Rule("null_key", "l_orderkey IS NULL", rejects=True),
    Rule("null_discount", "discount IS NULL", rejects=True),
    Rule("discount_above", "discount > 0.08", rejects=True),
    Rule("tax_negative", "l_tax < 0", rejects=True),
    Rule("quantity_above", "l_quantity > 45", rejects=True),
    Rule("discount_zero", "discount = 0", info=True),
    Rule("tax_zero", "l_tax = 0", info=True),
)


def lines_with_gaps(spark, d):
    """Line items where shipped lines of flag R have lost their discount."""
    return table(spark, d, "lineitem").withColumn(
        "discount", F.when(F.col("l_returnflag") != "R", F.col("l_discount")))


@check("p10_composite_validity", """
  SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem
  WHERE l_returnflag <> 'R' AND l_discount <= 0.08 AND l_tax >= 0 AND l_quantity <= 45 GROUP BY 1""")
def composite_validity(spark, d):
    kept = quality.accepted_rows(lines_with_gaps(spark, d), LINE_RULES)
    return kept.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@check("p11_outside_domain", """
  SELECT count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW'))::BIGINT AS unknown,
         count(*) FILTER (o_orderpriority = '5-LOW')::BIGINT AS without_value FROM orders""")
def outside_domain(spark, d):
    rows = table(spark, d, "orders").select(
        F.lower(F.nullif("o_orderpriority", F.lit("5-LOW"))).alias("priority"))
    unknown = standardize.outside_domain("priority", ["1-URGENT", "2-HIGH", "5-LOW"])
    return rows.agg(count_where(F.expr(unknown)).alias("unknown"),
                    count_where(F.col("priority").isNull()).alias("without_value"))


@check("p12_fixed_projection", """
  SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def fixed_projection(spark, d):
    return star_ops.one_row_per_key(table(spark, d, "customer"), "c_custkey", ["c_custkey", "c_name", "c_mktsegment"])


@check("p13_drop_helper", """
  SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'""")
def drop_helper(spark, d):
    rows = standardize.add_normalized(table(spark, d, "orders").select(KEY, "o_orderstatus"), "o_orderstatus")
    return rows.filter("o_orderstatus_normalized = 'P'").drop("o_orderstatus_normalized")


@check("p14_population", """
  SELECT o_orderkey, 'finished' AS population FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, 'open' FROM orders WHERE o_orderstatus = 'O'""")
def population(spark, d):
    rows = table(spark, d, "orders").withColumn("status", F.concat(F.lit(" "), F.lower("o_orderstatus")))
    finished, still_open = (features.in_population("status", s) for s in ("F", "O"))
    return rows.filter(finished | still_open).select(
        KEY, F.when(finished, "finished").otherwise("open").alias("population"))


@check("p15_entry_year", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS order_year FROM orders")
def entry_year(spark, d):
    return SPEC.with_derived(table(spark, d, "orders")).select(KEY, "order_year")


@check("p16_days_between", using("joined", "SELECT o_orderkey, days FROM joined WHERE days IS NOT NULL"))
def days_between(spark, d):
    return joined(spark, d).select(
        KEY, features.days_between("o_orderdate", "l_shipdate").alias("days")).filter("days IS NOT NULL")


@check("p17_threshold_label", using("labelled", "SELECT o_orderkey, label FROM labelled"))
def threshold_label(spark, d):
    return features.labelled_population(star(spark, d), SPEC).select(KEY, LABEL)


@check("p18_complete_rows", """
  SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_discount <> 0.05""")
def complete_rows(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.when(F.col("l_quantity") > 10, F.col("l_tax")).otherwise(F.lit(float("nan"))).alias("a"),
        F.nullif("l_discount", F.lit(0.05)).alias("b"))
    return features.complete_rows(rows, ["a", "b"]).select("l_orderkey", "l_linenumber", "l_quantity")


@check("p19_missing_measures", using("labelled", """
  SELECT o_orderkey AS key, 'missing_l_quantity' AS reason FROM labelled WHERE l_quantity IS NULL
  UNION ALL SELECT o_orderkey, 'missing_l_extendedprice' FROM labelled WHERE l_extendedprice IS NULL"""))
def missing_measures(spark, d):
    return features.excluded_rows(star(spark, d), SPEC)


@check("p20_quarantine", using("joined", """
  SELECT o_orderkey AS key, 'no_ship_date' AS reason FROM joined WHERE l_shipdate IS NULL
  UNION ALL SELECT o_orderkey, 'shipped_before_order' FROM joined WHERE l_shipdate < o_orderdate"""))
def quarantine(spark, d):
    return quality.quarantine(joined(spark, d), KEY, (
        Rule("no_ship_date", "l_shipdate IS NULL", rejects=True),
        Rule("shipped_before_order", "l_shipdate < o_orderdate", rejects=True),
        Rule("cheap", "o_totalprice < 1000")))


def leak_rows(df, spec: FeatureSpec, labels=()):
    """``(column, verdict, filled)`` for every column that must not reach the model."""
    roles = features.model_roles(spec.features, spec.key, labels)
    verdicts = [v for v in features.column_verdicts(df.schema, roles, spec.denied) if v[1] in ("denied", "unexpected")]
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in dict.fromkeys(c for c, _ in verdicts)])
    found = [F.struct(F.lit(c).alias("column"), F.lit(v).alias("verdict"), F.col(c).alias("filled")) for c, v in verdicts]
    clean = F.struct(F.lit("").alias("column"), F.lit("clean").alias("verdict"), F.col("__rows").alias("filled"))
    return row.select(F.inline(F.array(*(found or [clean]))))


@check("p21_leakage_guard", using("star", """
  SELECT c AS "column", v AS verdict, n AS filled FROM (
    SELECT unnest(['l_shipdate', 'o_orderdate', 'o_orderstatus', 'days', 'o_totalprice']) AS c,
           'denied' AS v, unnest([count(l_shipdate), count(*), count(*), count(days), count(*)]) AS n FROM star
    UNION ALL
    SELECT unnest(['o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority', 'l_shipdate', 'days']),
           'unexpected',
           unnest([count(*), count(*), count(*), count(*), count(*), count(l_shipdate), count(days)]) FROM star)"""))
def leakage_guard(spark, d):
    return leak_rows(SPEC.with_derived(star(spark, d)), SPEC)


@check("p22_training_guard", using("train", """
  SELECT '' AS "column", 'clean' AS verdict, count(*)::BIGINT AS filled FROM train"""))
def training_guard(spark, d):
    rows = training(spark, d, stored=False)
    features.check_leakage(rows, FEATURES, KEY, labels=[LABEL])
    return leak_rows(rows, SPEC, [LABEL])


@check("p23_schema_contract", """
  SELECT 'o_custkey' AS "column", 'extra' AS verdict, count(*)::BIGINT AS rows FROM orders
  UNION ALL SELECT 'o_comment', 'missing', count(*) FROM orders""")
def schema_contract(spark, d):
    orders = table(spark, d, "orders")
    declared = [c for c in orders.columns if c != "o_custkey"] + ["o_comment"]
    named = {"unexpected": "extra", "missing": "missing"}
    verdicts = features.column_verdicts(orders.schema, dict.fromkeys(declared, "declared"))
    pairs = [(c, named[v]) for c, v in verdicts if v in named]
    return orders.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(v).alias("verdict"), F.col("rows").alias("rows")) for c, v in pairs])))


@check("p24_constant_columns", using("infer", """
  SELECT o_orderkey, 'v2' AS model_version, 'plain' AS model_variant FROM infer"""))
def constant_columns(spark, d):
    return scoring.constant_columns(inference(spark, d).select(KEY), {"model_version": "v2", "model_variant": "plain"})


@check("p25_optional_column", """
  SELECT c_name, c_custkey, 'with' AS kind FROM customer
  UNION ALL SELECT '' AS c_name, s_suppkey, 'without' FROM supplier""")
def optional_column(spark, d):
    with_name = scoring.with_optional(table(spark, d, "customer"), ["c_custkey"], "c_name")
    without = scoring.with_optional(table(spark, d, "supplier"), [F.col("s_suppkey").alias("c_custkey")], "c_name")
    return with_name.withColumn("kind", F.lit("with")).unionByName(
        without.withColumn("c_name", F.lit("")).withColumn("kind", F.lit("without")))


@check("p26_feature_doubles", using("train", """
  SELECT o_orderkey, l_quantity, l_extendedprice, order_year::DOUBLE AS order_year, order_day::DOUBLE AS order_day
  FROM train"""))
def feature_doubles(spark, d):
    return features.as_doubles(training(spark, d, stored=False), FEATURES, KEY)


@check("p27_value_probes", """
  SELECT 'probe' AS subject, m AS metric, v::BIGINT AS value FROM (
    SELECT unnest(['upper', 'lower', 'empty']) AS m,
           unnest([count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'f'),
                   count(*) FILTER (o_orderstatus = 'P')]) AS v FROM orders)""")
def probes(spark, d):
    rows = table(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return value_probes(rows, {"upper": "status = 'F'", "lower": "status = 'f'", "empty": "status IS NULL"})


