"""The test tables in the roles the operators expect.

orders is the dimension, lineitem the fact (first line per order), the order status selects the
training (F) and inference (O) populations, and "On time" means shipped within a year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import first_per_key
from ..operators.features import FeatureSpec, inference_set, training_set
from ..sources.staging import stage

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
KEY, LABEL, ON_TIME, LATE = "o_orderkey", "label", "On time", "Late"
LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
MEASURES = ("l_quantity", "l_extendedprice")
FEATURES = ("l_quantity", "l_extendedprice", "order_year", "order_day")

SPEC = FeatureSpec(
    key=KEY, features=FEATURES, measures=MEASURES, status="o_orderstatus",
    start="o_orderdate", end="l_shipdate", limit_days=365, on_time=ON_TIME, late=LATE, label=LABEL,
    training_status="F", inference_status="O",
    derived=(("order_year", "year(o_orderdate)"),
             ("order_day", "datediff(o_orderdate, DATE'1995-01-01')")),
    denied=("l_shipdate", "o_orderdate", "o_orderstatus", "days", "o_totalprice"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fact(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", KEY)
    return first_per_key(lines, [KEY], LINE_ORDER, [KEY, *MEASURES, "l_shipdate"])


def joined(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their first line, where there is one."""
    return table(spark, folder, "orders").join(fact(spark, folder), KEY, "left")


def star(spark: SparkSession, folder: str) -> DataFrame:
    """The joined rows without those shipped before they were ordered."""
    days = F.datediff("l_shipdate", "o_orderdate")
    return joined(spark, folder).withColumn("days", days).filter("days IS NULL OR days >= 0")


def training(spark: SparkSession, folder: str, stored: bool = True) -> DataFrame:
    """Labelled rows; stored, because fitting and splitting read them several times."""
    rows = training_set(star(spark, folder), SPEC, unique=True)
    return stage(rows, "training") if stored else rows


def populations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Training and inference rows from one stored pass over the tables."""
    wanted = star(spark, folder).filter(F.col("o_orderstatus").isin("F", "O")).select(
        KEY, "o_orderstatus", "o_orderdate", *MEASURES, "l_shipdate")
    rows = stage(wanted, "star")
    return training_set(rows, SPEC, unique=True), inference_set(rows, SPEC, unique=True)


def inference(spark: SparkSession, folder: str) -> DataFrame:
    return inference_set(star(spark, folder), SPEC, unique=True)
