"""Feature sets: populations, derived columns, labels, leakage and schema guards."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import normalized
from .dedup import first_per_key
from .metrics import count_where, is_missing
from .quality import missing_measures


class LeakageError(ValueError):
    """A column that must not reach the model is present."""


class SchemaError(ValueError):
    """A frame does not have the declared columns or types."""


def in_population(column: str, value: str) -> Column:
    return normalized(F.col(column)) == F.lit(value)


def days_between(start: str, end: str) -> Column:
    return F.datediff(F.col(end), F.col(start))


def within_limit_label(days: Column, limit: int, on_time: str, late: str) -> Column:
    """``on_time`` up to and including ``limit`` days, else ``late``; unknown days are ``late``."""
    return F.when(days <= limit, F.lit(on_time)).otherwise(F.lit(late))


def complete_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with a value (neither NULL nor NaN) in every feature; nothing is imputed."""
    return df.dropna(subset=list(features))


def column_verdicts(
    schema: T.StructType, roles: Mapping[str, str], denied: Iterable[str] = (), types: Mapping[str, T.DataType] | None = None,
) -> list[tuple[str, str]]:
    """``(column, verdict)`` of every column of a schema against the roles that a contract gives.

    A column in its place gets its role as verdict; else it is ``unexpected``, of ``wrong type``, or ``missing``.
    ``denied`` comes on top, for columns that must not reach a model in any other role than the label.
    """
    kept_out = set(denied)
    found = [(f.name, "denied") for f in schema if f.name in kept_out and roles.get(f.name) != "label"]
    for field in schema:
        role = roles.get(field.name, "unexpected")
        mistyped = role != "unexpected" and types is not None and types[field.name] != field.dataType
        found.append((field.name, "wrong type" if mistyped else role))
    return found + [(name, "missing") for name in roles if name not in schema.names]


def model_roles(features: Sequence[str], key: str, labels: Iterable[str] = ()) -> dict[str, str]:
    return {key: "key"} | dict.fromkeys(features, "feature") | dict.fromkeys(labels, "label")


def _refuse(error: type[ValueError], found: Iterable[tuple[str, str]], *verdicts: str) -> None:
    wrong = [f"{column}: {verdict}" for column, verdict in found if verdict in verdicts]
    if wrong:
        raise error("; ".join(wrong))


def check_leakage(
    df: DataFrame, features: Sequence[str], key: str,
    denied: Iterable[str] = (), labels: Iterable[str] = (),
) -> None:
    """Nothing but key, features and labels may be there."""
    _refuse(LeakageError, column_verdicts(df.schema, model_roles(features, key, labels), denied), "denied", "unexpected")


def check_schema(df: DataFrame, declared: T.StructType, types: bool = False) -> None:
    """Exactly the declared columns must be there (and, if asked, with the declared types)."""
    kinds = {f.name: f.dataType for f in declared} if types else None
    roles = dict.fromkeys(declared.names, "declared")
    _refuse(SchemaError, column_verdicts(df.schema, roles, types=kinds), "missing", "unexpected", "wrong type")


def as_doubles(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """Features as doubles in model order, after the ``keep`` columns."""
    return df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])


@dataclass(frozen=True)
class FeatureSpec:
    """What makes a training or inference row out of a joined dimension/fact row."""

    key: str
    features: tuple[str, ...]
    measures: tuple[str, ...]
    status: str
    start: str
    end: str
    limit_days: int
    on_time: str
    late: str
    label: str
    training_status: str
    inference_status: str
    derived: tuple[tuple[str, str], ...] = ()
    denied: tuple[str, ...] = ()

    def with_derived(self, joined: DataFrame) -> DataFrame:
        """The derived features, each a SQL expression over the joined columns."""
        for name, expression in self.derived:
            joined = joined.withColumn(name, F.expr(expression))
        return joined

    def label_column(self) -> Column:
        return within_limit_label(days_between(self.start, self.end), self.limit_days, self.on_time, self.late)


def labelled_population(joined: DataFrame, spec: FeatureSpec) -> DataFrame:
    finished = spec.with_derived(joined).filter(in_population(spec.status, spec.training_status))
    return finished.withColumn(spec.label, spec.label_column())


def open_population(joined: DataFrame, spec: FeatureSpec) -> DataFrame:
    return spec.with_derived(joined).filter(in_population(spec.status, spec.inference_status))


def training_set(joined: DataFrame, spec: FeatureSpec, unique: bool = False) -> DataFrame:
    """Finished rows with label and all features, one per key.

    ``unique=True`` states that the guarded join already made keys unique and saves the shuffle.
    """
    columns = [spec.key, *spec.features, spec.label]
    rows = complete_rows(labelled_population(joined, spec), spec.features).select(*columns)
    result = rows if unique else first_per_key(rows, [spec.key])
    check_leakage(result, spec.features, spec.key, spec.denied, [spec.label])
    return result


def inference_set(joined: DataFrame, spec: FeatureSpec, unique: bool = False) -> DataFrame:
    columns = [spec.key, *spec.features]
    rows = complete_rows(open_population(joined, spec), spec.features).select(*columns)
    result = rows if unique else first_per_key(rows, [spec.key])
    check_leakage(result, spec.features, spec.key, spec.denied)
    return result


def excluded_rows(joined: DataFrame, spec: FeatureSpec, training: bool = True) -> DataFrame:
    """Quarantine of population rows without a measure: ``(key, reason)``."""
    population = labelled_population if training else open_population
    return missing_measures(population(joined, spec), spec.key, spec.measures)


def feature_report(joined: DataFrame, spec: FeatureSpec, training: bool = True) -> DataFrame:
    """One row of counts for a feature set, in one aggregate over its population."""
    population = labelled_population(joined, spec) if training else open_population(joined, spec)
    complete = F.lit(True)
    for f in spec.features:
        complete = complete & ~is_missing(population, f)
    unmeasured = F.lit(False)
    for m in spec.measures:
        unmeasured = unmeasured | is_missing(population, m)
    labels = [
        count_where(F.col(spec.label) == spec.on_time).alias("label_on_time"),
        count_where(F.col(spec.label) == spec.late).alias("label_late"),
        count_where(days_between(spec.start, spec.end).isNull()).alias("days_unknown"),
    ] if training else []
    # a struct is never NULL itself, so a NULL key still counts as one distinct key
    kept_key = F.when(complete, F.struct(F.col(spec.key)))
    return population.agg(
        F.count(F.lit(1)).alias("initial"),
        F.count_distinct(kept_key).alias("valid"),
        (count_where(complete) - F.count_distinct(kept_key)).alias("duplicate_rows"),
        count_where(unmeasured).alias("without_measures"),
        count_where(~complete).alias("incomplete"),
        *labels,
    )
