"""Tables in the catalog: create, replace, describe, list and count."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import union_all

LAYERS = ("bronze", "silver", "gold", "feature_store")

# stored type per frame type; everything else is stored as text
_STORED_TYPES = (
    (T.LongType, "bigint"), (T.IntegerType, "int"), (T.DoubleType, "double"),
    (T.FloatType, "double"), (T.BooleanType, "boolean"),
)


def create_layers(spark: SparkSession, layers: Sequence[str] = LAYERS, location: str | None = None) -> None:
    """Namespaces of the layers, under ``location`` if given (else where the catalog puts them)."""
    for layer in layers:
        where = f" LOCATION '{location.rstrip('/')}/{layer}'" if location else ""
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {layer}{where}")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def stored_ddl(schema: T.StructType) -> str:
    def stored(data_type: T.DataType) -> str:
        return next((name for cls, name in _STORED_TYPES if isinstance(data_type, cls)), "string")

    return ", ".join(f"`{f.name}` {stored(f.dataType)}" for f in schema.fields)


def create_if_missing(df: DataFrame, name: str, provider: str = "parquet") -> None:
    """Empty table shaped like ``df``; an existing table stays as it is."""
    df.sparkSession.sql(f"CREATE TABLE IF NOT EXISTS {name} ({stored_ddl(df.schema)}) USING {provider}")


def _is_session_catalog(spark: SparkSession, name: str) -> bool:
    parts = name.replace("`", "").split(".")
    catalog = parts[0] if len(parts) > 2 else spark.catalog.currentCatalog()
    return catalog == "spark_catalog" and not spark.conf.get("spark.sql.catalog.spark_catalog", "")


def replace_table(df: DataFrame, name: str, comment: str | None = None, provider: str = "parquet") -> None:
    """Full replace. A V2 catalog swaps atomically. The built-in session catalog cannot, so there the
    new content is written completely under another name and renamed; readers never see half a table,
    and a table may be replaced by a query over itself. If the new table cannot take the name, the old one
    gets it back. Without a ``comment`` the old one stays. (Renaming copies the data on an object store:
    the session catalog is for tests and small landings.)"""
    spark = df.sparkSession
    if comment is None and table_exists(spark, name):
        comment = table_comment(spark, name)
    if not _is_session_catalog(spark, name):
        df.writeTo(name).using(provider).createOrReplace()
    else:
        suffix = uuid.uuid4().hex[:8]
        fresh, old = f"{name}__new_{suffix}", f"{name}__old_{suffix}"
        df.write.format(provider).saveAsTable(fresh)
        had_one = table_exists(spark, name)
        if had_one:
            spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
        try:
            spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
        except PySparkException:
            if had_one:
                spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
            spark.sql(f"DROP TABLE IF EXISTS {fresh}")
            raise
        if had_one:
            spark.sql(f"DROP TABLE {old}")
    if comment:
        comment_table(spark, name, comment)


def comment_table(spark: SparkSession, name: str, comment: str) -> None:
    """Document a table's grain and keys on the table itself."""
    text = comment.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"COMMENT ON TABLE {name} IS '{text}'")


def table_comment(spark: SparkSession, name: str) -> str | None:
    return spark.catalog.getTable(name).description


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def layer_inventory(spark: SparkSession, layers: Sequence[str] = LAYERS) -> DataFrame:
    """``(layer, table, rows, error)`` for every table; a table that cannot be read keeps its error text."""
    parts, failed = [], []
    for layer in layers:
        for table in sorted(spark.catalog.listTables(layer), key=lambda t: t.name):
            if table.isTemporary:
                continue
            try:
                parts.append(row_count(spark.table(f"{layer}.{table.name}")).select(
                    F.lit(layer).alias("layer"), F.lit(table.name).alias("table"), "rows",
                    F.lit(None).cast("string").alias("error")))
            except PySparkException as error:
                failed.append((layer, table.name, None, str(error)))
    if failed or not parts:
        parts.append(spark.createDataFrame(failed, "layer string, table string, rows bigint, error string"))
    return union_all(parts)


def reconcile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(step, layer, rows, lost)``: row counts along the layers and what each step dropped."""
    counts = union_all([
        row_count(df).select(F.lit(i).alias("step"), F.lit(name).alias("layer"), "rows")
        for i, (name, df) in enumerate(tables.items())
    ])
    before = counts.select((F.col("step") + 1).alias("step"), F.col("rows").alias("__before"))
    return counts.join(before, "step", "left").select(
        "step", "layer", "rows", (F.col("__before") - F.col("rows")).alias("lost"))


def reload_check(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """``(table, rows, columns)``, columns sorted."""
    return union_all([
        row_count(spark.table(n)).select(
            F.lit(n).alias("table"), "rows", F.lit(",".join(sorted(spark.table(n).columns))).alias("columns"))
        for n in names
    ])


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> list[str]:
    """A view per dataset for SQL users; registering again replaces, never duplicates."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return list(tables)


def register_catalog_views(spark: SparkSession, database: str, tables: Sequence[str]) -> list[str]:
    """Permanent views over catalog tables, one per listed ``layer.table``."""
    names = []
    for table in tables:
        name = f"{database}.{table.split('.')[-1]}"
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {table}")
        names.append(name)
    return names
