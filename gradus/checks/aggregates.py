"""Aggregations, dedup, sort and limit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, evaluate, features, profile, quality, scoring
from ..operators.metrics import melt
from ..operators.model_selection import cross_validate
from ..operators.split import stratified_split
from ..sources import catalog
from .bindings import FEATURES, KEY, LABEL, LINE_ORDER, MEASURES, ON_TIME, SPEC, fact, joined, star, table, training
from .joins import two_predictions
from .projections import LINE_RULES, lines_with_gaps
from .registry import check
from .sql import pivot_metrics, using


@check("a1_row_count", "SELECT count(*)::BIGINT AS rows FROM lineitem")
def row_count(spark, d):
    return catalog.row_count(table(spark, d, "lineitem"))


@check("a2_duplicate_keys", """
  SELECT count(*)::BIGINT AS rows, (count(DISTINCT k) + max((k IS NULL)::INTEGER))::BIGINT AS distinct_keys,
         (count(*) - count(DISTINCT k) - max((k IS NULL)::INTEGER))::BIGINT AS duplicate_keys
  FROM (SELECT nullif(l_orderkey, 7) AS k FROM lineitem)""")
def duplicate_keys(spark, d):
    return quality.key_counts(table(spark, d, "lineitem").select(F.nullif("l_orderkey", F.lit(7)).alias("k")), "k")


@check("a3_null_counts", using("joined", pivot_metrics(
    "(SELECT count(*) - count(o_orderkey) AS o_orderkey, count(*) - count(l_quantity) AS l_quantity,"
    " count(*) - count(l_shipdate) AS l_shipdate FROM joined)", "o_orderkey l_quantity l_shipdate", "nulls")))
def null_counts(spark, d):
    return quality.null_counts(joined(spark, d), [KEY, "l_quantity", "l_shipdate"])


STAR_RULES = (
    quality.Rule("null_key", "o_orderkey IS NULL"),
    quality.Rule("no_entry_date", "o_orderdate IS NULL", rejects=True),
    quality.Rule("exit_before_entry", "l_shipdate < o_orderdate", rejects=True),
    quality.Rule("price_out_of_range", "o_totalprice < 0 OR o_totalprice > 400000", rejects=True),
    quality.Rule("price_null", "o_totalprice IS NULL"),
    quality.Rule("quantity_small", "l_quantity < 5"),
    quality.Rule("extended_small", "l_extendedprice < 2000"),
    quality.Rule("status_unknown", "upper(trim(o_orderstatus)) NOT IN ('F', 'O')"),
)
_STAR_COUNTS = """(SELECT count(*) AS initial,
   count(*) FILTER (NOT coalesce(l_shipdate < o_orderdate, false) AND o_totalprice BETWEEN 0 AND 400000) AS valid,
   count(*) - count(DISTINCT o_orderkey) AS duplicate_key, 0 AS null_key, 0 AS no_entry_date,
   count(*) FILTER (l_shipdate < o_orderdate) AS exit_before_entry,
   count(*) FILTER (o_totalprice < 0 OR o_totalprice > 400000) AS price_out_of_range, 0 AS price_null,
   count(*) FILTER (l_quantity < 5) AS quantity_small, count(*) FILTER (l_extendedprice < 2000) AS extended_small,
   count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS status_unknown FROM joined)"""
_STAR_NAMES = ("initial valid duplicate_key null_key no_entry_date exit_before_entry price_out_of_range price_null "
               "quantity_small extended_small status_unknown")
_LINE_COUNTS = """(SELECT count(*) AS initial,
   count(*) FILTER (l_returnflag <> 'R' AND l_discount <= 0.08 AND l_tax >= 0 AND l_quantity <= 45) AS valid,
   count(*) - count(DISTINCT l_orderkey) AS duplicate_key, 0 AS null_key,
   count(*) FILTER (l_returnflag = 'R') AS null_discount,
   count(*) FILTER (l_returnflag <> 'R' AND l_discount > 0.08) AS discount_above,
   count(*) FILTER (l_tax < 0) AS tax_negative, count(*) FILTER (l_quantity > 45) AS quantity_above,
   count(*) FILTER (l_returnflag <> 'R' AND l_discount = 0) AS discount_zero,
   count(*) FILTER (l_tax = 0) AS tax_zero FROM lineitem)"""
_LINE_NAMES = ("initial valid duplicate_key null_key null_discount discount_above tax_negative quantity_above "
               "discount_zero tax_zero")


@check("a4_dimension_rule_counts", using("joined", pivot_metrics(_STAR_COUNTS, _STAR_NAMES, "orders")))
def dimension_rule_counts(spark, d):
    return melt(quality.rule_counts(joined(spark, d), KEY, STAR_RULES), "orders")


@check("a5_fact_rule_counts", pivot_metrics(_LINE_COUNTS, _LINE_NAMES, "lines"))
def fact_rule_counts(spark, d):
    return melt(quality.rule_counts(lines_with_gaps(spark, d), "l_orderkey", LINE_RULES), "lines")


@check("a6_kept_and_excluded", f"""
  SELECT initial::BIGINT AS initial, valid::BIGINT AS valid, (initial - valid)::BIGINT AS excluded FROM {_LINE_COUNTS}""")
def kept_and_excluded(spark, d):
    counts = quality.rule_counts(lines_with_gaps(spark, d), "l_orderkey", LINE_RULES)
    return quality.quality_summary(counts, "lines", LINE_RULES).select("initial", "valid", "excluded")


SUMMARY_SQL = f"""
  SELECT 'orders' AS "table", initial::BIGINT AS initial, valid::BIGINT AS valid,
         (duplicate_key + exit_before_entry + price_out_of_range + quantity_small + extended_small
          + status_unknown)::BIGINT AS invalid, (initial - valid)::BIGINT AS excluded FROM {_STAR_COUNTS}
  UNION ALL SELECT 'lines', initial, valid,
         duplicate_key + null_discount + discount_above + tax_negative + quantity_above, initial - valid
  FROM {_LINE_COUNTS}
  UNION ALL SELECT 'nation', count(*), count(*), 0, 0 FROM nation"""


def quality_summaries(spark, d):
    orders = quality.rule_counts(joined(spark, d), KEY, STAR_RULES)
    lines = quality.rule_counts(lines_with_gaps(spark, d), "l_orderkey", LINE_RULES)
    return quality.quality_summary(orders, "orders", STAR_RULES).unionByName(
        quality.quality_summary(lines, "lines", LINE_RULES)
    ).unionByName(quality.plain_summary(table(spark, d, "nation"), "nation"))


@check("a7_quality_summary", using("joined", SUMMARY_SQL))
def quality_summary(spark, d):
    return quality_summaries(spark, d)


@check("a8_group_counts", using("labelled", "SELECT label, count(*)::BIGINT AS n FROM labelled GROUP BY 1"))
def group_counts(spark, d):
    return quality.group_counts(features.labelled_population(star(spark, d), SPEC), LABEL)


@check("a9_distribution_percent", """
  SELECT o_orderpriority, count(*)::BIGINT AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
  FROM orders GROUP BY 1""")
def distribution_percent(spark, d):
    return scoring.distribution(table(spark, d, "orders"), "o_orderpriority").withColumn("percent", F.round("percent", 6))


@check("a10_mismatch_patterns", using("compared_dev", """
  SELECT label_a, label_b, count(*)::BIGINT AS n FROM compared_dev WHERE label_a <> label_b GROUP BY 1, 2"""))
def mismatch_patterns(spark, d):
    both = scoring.comparison_table(*two_predictions(spark, d), KEY)
    return scoring.mismatch_patterns(both, "label_a", "label_b")


AGREEMENT_SQL = """
  SELECT count(*)::BIGINT AS total, count(*) FILTER (label_a = label_b)::BIGINT AS agreement,
         count(*) FILTER (label_a <> label_b)::BIGINT AS disagreement,
         round(count(*) FILTER (label_a = label_b) * 100.0 / count(*), 4) AS agreement_rate,
         round(100.0 - count(*) FILTER (label_a = label_b) * 100.0 / count(*), 4) AS disagreement_rate FROM """


@check("a11_agreement", using("compared_dev", AGREEMENT_SQL + "compared_dev"))
def agreement(spark, d):
    return scoring.agreement(scoring.comparison_table(*two_predictions(spark, d), KEY), "label_a", "label_b")


@check("a12_probability_stats", using("predicted", """
  SELECT round(min(probability), 6) AS min, round(max(probability), 6) AS max, round(avg(probability), 6) AS mean
  FROM predicted"""))
def probability_stats(spark, d):
    stats = scoring.probability_stats(two_predictions(spark, d)[0])
    return stats.select(*[F.round(c, 6).alias(c) for c in stats.columns])


_DESCRIBED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
DESCRIBE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c})::BIGINT AS n, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS stddev, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem"
    for c in _DESCRIBED)


@check("a13_describe_numeric", DESCRIBE_SQL)
def describe_numeric(spark, d):
    stats = profile.describe_numeric(table(spark, d, "lineitem"), [*_DESCRIBED, "not_a_column"])
    return stats.withColumn("mean", F.round("mean", 6)).withColumn("stddev", F.round("stddev", 6))


@check("a14_fold_summary", using("fold_metrics", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std FROM fold_metrics"
    for m in evaluate.METRICS)))
def fold_summary(spark, d):
    rows = training(spark, d)
    per_fold = cross_validate(rows, stratified_split(rows, KEY, LABEL), FEATURES, ON_TIME, oversample=False)
    return evaluate.fold_summary(per_fold).select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_STATS_SQL = """SELECT event_type, count(value)::BIGINT AS runs, round(avg(value), 9) AS mean_sec,
   round(median(value), 9) AS median_sec, round(min(value), 9) AS min_sec, round(max(value), 9) AS max_sec,
   round(coalesce(stddev_samp(value), 0), 9) AS std_sec FROM events GROUP BY 1"""


@check("a15_group_stats", _STATS_SQL)
def group_stats(spark, d):
    return profile.group_stats(table(spark, d, "events"), ["event_type"], "value")


@check("a16_throughput", f"""
  SELECT event_type, runs, mean_sec, round(runs / mean_sec, 6) AS rows_per_sec,
         round(mean_sec / runs * 1e9, 3) AS ns_per_row FROM ({_STATS_SQL})""")
def throughput(spark, d):
    stats = profile.group_stats(table(spark, d, "events"), ["event_type"], "value")
    return profile.throughput(stats, "runs").select(
        "event_type", "runs", "mean_sec", F.round("rows_per_sec", 6).alias("rows_per_sec"),
        F.round("ns_per_row", 3).alias("ns_per_row"))


@check("a17_dataset_validation", using("train", pivot_metrics(
    "(SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS distinct_keys,"
    " count(*) - count(DISTINCT o_orderkey) AS duplicate_keys, count(*) - count(l_quantity) AS null_l_quantity,"
    " count(*) - count(l_extendedprice) AS null_l_extendedprice, count(*) - count(order_year) AS null_order_year,"
    " count(*) - count(order_day) AS null_order_day, count(*) - count(label) AS null_label FROM train)",
    "rows distinct_keys duplicate_keys null_l_quantity null_l_extendedprice null_order_year null_order_day null_label",
    "training")))
def dataset_validation(spark, d):
    return melt(quality.validate_labelled(training(spark, d, stored=False), KEY, FEATURES, LABEL), "training")


@check("l1_first_per_key", using("fact", "SELECT o_orderkey, l_quantity, l_extendedprice FROM fact"))
def first_per_key(spark, d):
    return fact(spark, d).drop("l_shipdate")


@check("l1_hot_key", f"""
  SELECT l_returnflag, l_orderkey, l_quantity, l_extendedprice FROM (
    SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, {', '.join(LINE_ORDER)}) AS rn
    FROM lineitem) WHERE rn = 1""")
def hot_key(spark, d):
    """Three keys, each holding a third of all rows."""
    return dedup.first_per_key(
        table(spark, d, "lineitem"), ["l_returnflag"], ["l_orderkey", *LINE_ORDER],
        ["l_returnflag", "l_orderkey", *MEASURES])


@check("l2_unique_feature_rows", """
  SELECT c_mktsegment, min(c_acctbal) AS c_acctbal FROM customer GROUP BY 1""")
def unique_feature_rows(spark, d):
    return dedup.first_per_key(table(spark, d, "customer").select("c_mktsegment", "c_acctbal"), ["c_mktsegment"])


@check("l3_distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(spark, d):
    return dedup.distinct_values(table(spark, d, "orders"), "o_orderpriority")


@check("l4_counts_descending", """
  SELECT p_brand, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand""")
def counts_descending(spark, d):
    return profile.value_counts(table(spark, d, "part"), "p_brand")


@check("l5_counts_by_label", "SELECT p_type, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY 1")
def counts_by_label(spark, d):
    return profile.counts_by_label(table(spark, d, "part"), "p_type")


@check("l6_ordered_head", using("compared_dev", """
  SELECT o_orderkey FROM compared_dev WHERE label_a <> label_b ORDER BY 1 LIMIT 10"""))
def ordered_head(spark, d):
    both = scoring.comparison_table(*two_predictions(spark, d), KEY)
    return scoring.disagreeing_keys(both, KEY, "label_a", "label_b")
