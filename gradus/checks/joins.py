"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring, star as star_ops
from ..operators.gnb import fit
from ..operators.split import stratified_split
from ..sources import publish
from .bindings import FEATURES, KEY, LABEL, fact, populations, table
from .registry import check
from .sql import using


@check("j1_left_join", using("joined", """
  SELECT o_orderkey, o_orderstatus, coalesce(l_quantity, -1) AS l_quantity FROM joined"""))
def left_join(spark, d):
    rows = star_ops.guarded_left_join(table(spark, d, "orders"), fact(spark, d), KEY)
    return rows.select(KEY, "o_orderstatus", F.coalesce("l_quantity", F.lit(-1.0)).alias("l_quantity"))


def open_orders(spark, d):
    """Orders that are not pending; order 7 has lost its key."""
    return table(spark, d, "orders").filter("o_orderstatus <> 'P'").withColumn(KEY, F.nullif(KEY, F.lit(7)))


def keyed_lines(spark, d):
    """All line items; those of order 7 have lost their key."""
    return table(spark, d, "lineitem").select(
        F.nullif("l_orderkey", F.lit(7)).alias(KEY), "l_quantity", "l_extendedprice")


_SIDES = """WITH dims AS (SELECT * REPLACE (nullif(o_orderkey, 7) AS o_orderkey) FROM orders WHERE o_orderstatus <> 'P'),
  lines AS (SELECT nullif(l_orderkey, 7) AS o_orderkey, l_quantity, l_extendedprice FROM lineitem)"""


@check("j2_orphan_facts", f"""{_SIDES}
  SELECT coalesce(o_orderkey, -1) AS key, count(*)::BIGINT AS n FROM lines l
  WHERE NOT EXISTS (SELECT 1 FROM dims d WHERE d.o_orderkey = l.o_orderkey) GROUP BY 1""")
def orphan_facts(spark, d):
    orphans = star_ops.rows_without_match(keyed_lines(spark, d), open_orders(spark, d), KEY)
    return orphans.groupBy(F.coalesce(KEY, F.lit(-1)).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@check("j3_dimension_without_fact", f"""{_SIDES}
  SELECT coalesce(o_orderkey, -1) AS key FROM dims d
  WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE d.o_orderkey = l.o_orderkey)""")
def dimension_without_fact(spark, d):
    rows = star_ops.rows_without_match(open_orders(spark, d), keyed_lines(spark, d), KEY)
    return rows.select(F.coalesce(KEY, F.lit(-1)).alias("key"))


@check("j4_row_multiplication", f"""{_SIDES}
  SELECT count(*)::BIGINT AS join_total,
         (count(DISTINCT d.o_orderkey) + max((d.o_orderkey IS NULL)::INTEGER))::BIGINT AS join_distinct,
         (count(*) - count(DISTINCT d.o_orderkey) - max((d.o_orderkey IS NULL)::INTEGER))::BIGINT AS row_multiplication
  FROM dims d LEFT JOIN lines l ON d.o_orderkey = l.o_orderkey""")
def row_multiplication(spark, d):
    return star_ops.join_multiplication(open_orders(spark, d), keyed_lines(spark, d), KEY)


@check("j5_match_coverage", f"""{_SIDES}
  SELECT count(*)::BIGINT AS join_total, count(l_quantity)::BIGINT AS matched,
         (count(*) - count(l_quantity))::BIGINT AS non_matched,
         (count(*) - (SELECT count(*) FROM dims))::BIGINT AS row_multiplication
  FROM dims d LEFT JOIN lines l ON d.o_orderkey = l.o_orderkey""")
def match_coverage(spark, d):
    return star_ops.star_metrics(
        open_orders(spark, d), keyed_lines(spark, d), KEY, ["l_quantity", "l_extendedprice"]
    ).select("join_total", "matched", "non_matched", "row_multiplication")


def two_predictions(spark, d):
    """The open orders scored by the model of all rows and by the model of the training part."""
    rows, open_rows = populations(spark, d)
    parts = stratified_split(rows, KEY, LABEL).with_part(rows)
    full, dev = fit(rows, FEATURES, LABEL), fit(parts.filter("part = 'train'"), FEATURES, LABEL)
    return [scoring.batch_predictions(open_rows, m, KEY, "v1", v) for m, v in ((full, "full"), (dev, "dev"))]


@check("j6_inner_join", using("compared_dev", "SELECT * FROM compared_dev"))
def inner_join(spark, d):
    return scoring.comparison_table(*two_predictions(spark, d), KEY)


@check("j7_regression_gate", using("compared_dev", """
  SELECT count(*)::BIGINT AS total, count(*) FILTER (label_a = label_b)::BIGINT AS agreement,
         round(count(*) FILTER (label_a = label_b) * 100.0 / count(*), 4) AS agreement_rate,
         count(*) = count(*) FILTER (label_a = label_b) AS passed FROM compared_dev"""))
def regression_gate(spark, d):
    return scoring.regression_gate(*two_predictions(spark, d), KEY)


def customers_and_buyers(spark, d):
    """Keys of well-funded customers and of the customers who placed orders; key 3 is NULL on both."""
    rich = table(spark, d, "customer").filter("c_acctbal > 2000").select(F.nullif("c_custkey", F.lit(3)).alias("k"))
    buyers = table(spark, d, "orders").select(F.nullif("o_custkey", F.lit(3)).alias("k"))
    return rich, buyers


_KEYS = """WITH rich AS (SELECT DISTINCT nullif(c_custkey, 3) AS k FROM customer WHERE c_acctbal > 2000),
  buyers AS (SELECT DISTINCT nullif(o_custkey, 3) AS k FROM orders)"""


@check("u1_keys_only_in_right", f"""{_KEYS}
  SELECT coalesce(k, -1) AS k FROM (SELECT k FROM buyers EXCEPT SELECT k FROM rich)""")
def only_in_right(spark, d):
    rich, buyers = customers_and_buyers(spark, d)
    return star_ops.keys_only_in(buyers, rich, "k").select(F.coalesce("k", F.lit(-1)).alias("k"))


@check("u2_keys_only_in_left", f"""{_KEYS}
  SELECT coalesce(k, -1) AS k FROM (SELECT k FROM rich EXCEPT SELECT k FROM buyers)""")
def only_in_left(spark, d):
    return star_ops.keys_only_in(*customers_and_buyers(spark, d), "k").select(F.coalesce("k", F.lit(-1)).alias("k"))


@check("u3_keys_in_both", f"""{_KEYS}
  SELECT coalesce(k, -1) AS k FROM (SELECT k FROM rich INTERSECT SELECT k FROM buyers)""")
def in_both(spark, d):
    return star_ops.keys_in_both(*customers_and_buyers(spark, d), "k").select(F.coalesce("k", F.lit(-1)).alias("k"))


@check("u4_key_overlap", f"""{_KEYS}
  SELECT (SELECT count(*) FROM rich)::BIGINT AS left_keys, (SELECT count(*) FROM buyers)::BIGINT AS right_keys,
         (SELECT count(*) FROM (SELECT k FROM buyers EXCEPT SELECT k FROM rich))::BIGINT AS right_only,
         (SELECT count(*) FROM (SELECT k FROM rich EXCEPT SELECT k FROM buyers))::BIGINT AS left_only,
         (SELECT count(*) FROM (SELECT k FROM rich INTERSECT SELECT k FROM buyers))::BIGINT AS both""")
def key_overlap(spark, d):
    return star_ops.key_overlap(*customers_and_buyers(spark, d), "k")


@check("u5_union_of_slices", """
  SELECT o_orderpriority, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'new' ELSE 'old' END AS version
  FROM orders""")
def union_of_slices(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", KEY, F.lit("old").alias("version"))
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(
        KEY, "o_orderpriority", F.lit("new").alias("version"))
    return publish.replace_slice(rows, urgent, "o_orderpriority", "1-URGENT")
