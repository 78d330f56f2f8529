"""Raw table -> typed, trimmed, rule-checked table, driven by a declarative spec."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import lenient_cast, normalized
from ..functions.names import target_names
from ..sources.staging import observed, stage
from . import quality
from .metrics import distinct_with_null, local_frame
from .quality import Rule

_BROKEN, _REJECTED, _KEYS = "__broken", "__rejected", "__keys"


@dataclass(frozen=True)
class TableSpec:
    """How one raw table becomes a standard one."""

    source: str
    target: str
    columns: Mapping[str, str] = field(default_factory=dict)
    casts: Mapping[str, str] = field(default_factory=dict)
    key: str | None = None
    rules: tuple[Rule, ...] = ()


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.toDF(*target_names(df.columns, mapping))


def trim_strings(df: DataFrame) -> DataFrame:
    """Spaces (only spaces) off both ends of every string column."""
    return df.select(*[
        F.trim(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all")


def apply_casts(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    return df.select(*[
        lenient_cast(F.col(c), casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns
    ])


def add_normalized(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{column}_normalized", normalized(F.col(column)))


def typed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rename, trim, drop rows without any value, cast: one projection and one filter."""
    return apply_casts(drop_empty_rows(trim_strings(rename_columns(df, spec.columns))), spec.casts)


@dataclass(frozen=True)
class Standardized:
    """Lazy results of :func:`standardize`; nothing runs until one is used."""

    rows: DataFrame
    rejected: DataFrame | None
    counts: DataFrame | None
    summary: DataFrame


def standardize(df: DataFrame, spec: TableSpec) -> Standardized:
    table = typed(df, spec)
    if spec.key is None:
        return Standardized(table, None, None, quality.plain_summary(table, spec.target))
    counts = quality.rule_counts(table, spec.key, spec.rules)
    return Standardized(
        rows=quality.accepted_rows(table, spec.rules),
        rejected=quality.quarantine(table, spec.key, spec.rules),
        counts=counts,
        summary=quality.quality_summary(counts, spec.target, spec.rules),
    )


def standardize_once(df: DataFrame, spec: TableSpec, write: Callable[[DataFrame], DataFrame]) -> Standardized:
    """:func:`standardize` with one pass over ``df``; ``write`` stores the accepted rows and returns their reader.

    Figures are taken while rows are written. Where no rule rejects, that is the way into the table itself. Else the
    typed rows are stored first, with the rules they break and the rejected ones in a folder of their own, from where the
    table is written and the rejected rows are read. Distinct keys are counted in what is stored.
    """
    spark, table = df.sparkSession, typed(df, spec)
    flagged, figures, flags = quality.with_flags(table, spec.rules)
    watched, observation = observed(flagged, figures)
    if any(rule.rejects for rule in spec.rules):
        marked = watched.withColumn(_BROKEN, quality.broken_rules(spec.rules)).withColumn(_REJECTED, ~F.col("__valid"))
        stored = stage(marked.drop(*flags), "typed", [_REJECTED])
        rows = write(stored.filter(~F.col(_REJECTED)).select(*table.columns))
    else:
        stored = rows = write(watched.drop(*flags))
    seen = observation.get
    known = local_frame(spark, [tuple(seen[n] for n in figures)], ", ".join(f"`{n}` bigint" for n in figures))
    if spec.key is None:
        zero = F.lit(0).cast("bigint")
        return Standardized(rows, None, None, known.select(
            F.lit(spec.target).alias("table"), "initial", "valid", zero.alias("invalid"), zero.alias("excluded")))
    keys = stored.agg(distinct_with_null(F.col(spec.key)).alias(_KEYS))
    counts = known.crossJoin(keys).select(  # one row each
        "initial", "valid", (F.col("initial") - F.col(_KEYS)).alias(quality.DUPLICATE_KEY), *[r.name for r in spec.rules])
    if stored is rows:
        kind = table.schema[spec.key].dataType.simpleString()
        rejected = local_frame(spark, [], f"key {kind}, reason string")
    else:
        rejected = stored.filter(_REJECTED).select(F.col(spec.key).alias("key"), F.explode(_BROKEN).alias("reason"))
    return Standardized(rows, rejected, counts, quality.quality_summary(counts, spec.target, spec.rules))


def outside_domain(column: str, valid: Sequence[str]) -> str:
    """Rule condition: the normalised value is none of ``valid`` (a NULL value is not reported)."""
    values = ", ".join("'" + v.replace("'", "\\'") + "'" for v in valid)
    return f"upper(trim({column})) NOT IN ({values})"
