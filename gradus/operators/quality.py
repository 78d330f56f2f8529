"""Data-quality rules: all counts of a table in one aggregate, rejected rows in a quarantine."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import count_where, distinct_with_null, duplicate_count, is_missing, melt, total_of

DUPLICATE_KEY = "duplicate_key"


@dataclass(frozen=True)
class Rule:
    """A condition that holds on bad rows; a NULL condition means "not bad".

    ``rejects``  the row leaves the table and enters the quarantine
    ``info``     counted and shown, but not part of the invalid total
    """

    name: str
    bad_when: str
    rejects: bool = False
    info: bool = False

    @property
    def violated(self) -> Column:
        return F.coalesce(F.expr(self.bad_when), F.lit(False))


def _rejected(rules: Sequence[Rule]) -> Column:
    broken = F.lit(False)
    for rule in rules:
        if rule.rejects:
            broken = broken | rule.violated
    return broken


def accepted_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.filter(~_rejected(rules))


def quarantine(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """``(key, reason)``: one row per rejected row and rejecting rule it breaks."""
    return df.filter(_rejected(rules)).select(F.col(key).alias("key"), F.explode(broken_rules(rules)).alias("reason"))


def broken_rules(rules: Sequence[Rule]) -> Column:
    """Names of the rejecting rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(r.violated, F.lit(r.name)) for r in rules if r.rejects]).cast("array<string>"))


def with_flags(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """``df`` with a flag for each rule, the counts of :func:`rule_counts` that need no shuffle, and the flags' names.

    Counts that are observed while rows are written are not compiled; over flags they cost next to nothing, as the rules
    themselves are then evaluated in the compiled projection below.
    """
    flags = {"__valid": ~_rejected(rules), **{f"__bad_{i}": r.violated for i, r in enumerate(rules)}}
    figures = {"initial": F.count(F.lit(1)), "valid": F.count_if(F.col("__valid")),
               **{r.name: F.count_if(F.col(f"__bad_{i}")) for i, r in enumerate(rules)}}
    return df.select("*", *(c.alias(name) for name, c in flags.items())), figures, list(flags)


def rule_counts(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """One row, one scan, one shuffle of partial counts: rows, accepted rows, duplicate keys and the
    violations of every rule."""
    return df.agg(
        F.count(F.lit(1)).alias("initial"),
        count_where(~_rejected(rules)).alias("valid"),
        duplicate_count(F.col(key)).alias(DUPLICATE_KEY),
        *[count_where(r.violated).alias(r.name) for r in rules],
    )


def quality_summary(counts: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """``(table, initial, valid, invalid, excluded)`` from :func:`rule_counts`.

    The invalid total adds rule counts and duplicates; a row breaking two rules counts twice.
    """
    invalid = total_of([F.col(DUPLICATE_KEY), *[F.col(r.name) for r in rules if not r.info]])
    return counts.select(
        F.lit(table).alias("table"),
        "initial",
        "valid",
        invalid.alias("invalid"),
        (F.col("initial") - F.col("valid")).alias("excluded"),
    )


def plain_summary(df: DataFrame, table: str) -> DataFrame:
    """Summary row of a table that has no rules."""
    zero = F.lit(0).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("initial")).select(
        F.lit(table).alias("table"), "initial", F.col("initial").alias("valid"),
        zero.alias("invalid"), zero.alias("excluded"),
    )


def null_counts(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """``(subject='nulls', metric=column, value)``, all columns in one aggregate."""
    columns = list(columns if columns is not None else df.columns)
    return melt(df.agg(*[count_where(F.col(c).isNull()).alias(c) for c in columns]), "nulls")


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        distinct_with_null(F.col(key)).alias("distinct_keys"),
        duplicate_count(F.col(key)).alias("duplicate_keys"),
    )


def missing_measures(df: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """``(key, reason)`` for every row and measure without a value."""
    reasons = F.array_compact(
        F.array(*[F.when(F.col(m).isNull(), F.lit(f"missing_{m}")) for m in measures])
    )
    return df.select(F.col(key).alias("key"), F.explode(reasons).alias("reason"))


def group_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def validate_labelled(df: DataFrame, key: str, features: Sequence[str], label: str) -> DataFrame:
    """Counts that decide whether a labelled set is fit for training, in one aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(key).alias("distinct_keys"),
        duplicate_count(F.col(key)).alias("duplicate_keys"),
        *[count_where(is_missing(df, c)).alias(f"null_{c}") for c in [*features, label]],
    )


class InvalidDataset(ValueError):
    """A dataset breaks a condition that later steps rely on."""


def require_unique_key(df: DataFrame, key: str) -> None:
    duplicates = df.agg(duplicate_count(F.col(key)).alias("n")).first()["n"]
    if duplicates:
        raise InvalidDataset(f"{duplicates} duplicate values of {key}")


def require_filled(df: DataFrame, columns: Sequence[str]) -> None:
    """Every column must have a value, and a number where it is a floating-point one, in every row."""
    counts = df.agg(*[count_where(is_missing(df, c)).alias(c) for c in columns]).first().asDict()
    missing = {c: n for c, n in counts.items() if n}
    if missing:
        raise InvalidDataset(f"rows without a value: {missing}")
