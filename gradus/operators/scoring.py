"""Bulk scoring, prediction tables, their gates, and comparison of two prediction sets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gnb
from .dedup import head
from .features import check_leakage
from .gnb import GaussianNB
from .metrics import count_where, distinct_with_null, duplicate_count, gates, is_missing, local_frame
from .quality import InvalidDataset, group_counts


def constant_columns(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    return df.select("*", *[F.lit(v).alias(name) for name, v in constants.items()])


def now_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def with_optional(df: DataFrame, columns: Sequence, optional: str) -> DataFrame:
    """Select ``columns``, led by ``optional`` where the frame has it."""
    return df.select(*([optional] if optional in df.columns else []), *columns)


def batch_predictions(
    df: DataFrame, model: GaussianNB, key: str, version: str, variant: str,
    label_name: str = "prediction", probability_name: str = "probability",
    timestamp: Column | None = None,
) -> DataFrame:
    """Prediction table: key, features, label, probability of that label, time, version, variant.

    One narrow projection over the input: it streams at scan speed whatever the row count.
    """
    scored = gnb.with_scores(df, model)
    return scored.select(
        key, *model.features,
        F.col("prediction").alias(label_name),
        gnb.predicted_probability().alias(probability_name),
        (timestamp if timestamp is not None else now_text()).alias("prediction_timestamp"),
        F.lit(version).alias("model_version"),
        F.lit(variant).alias("model_variant"),
    )


def joint_predictions(
    df: DataFrame, models: Mapping[str, GaussianNB], key: str, version: str, timestamp: Column | None = None
) -> DataFrame:
    """Key, features, time, version, and of every variant ``label:<variant>`` and ``probability:<variant>``.

    One projection scores all models, so the input is read once however many there are.
    """
    features = next(iter(models.values())).features
    scored = df.select(key, *features)
    for variant, model in models.items():
        scored = gnb.with_scores(scored, model).withColumn(f"probability:{variant}", gnb.predicted_probability()).withColumnRenamed(
            "prediction", f"label:{variant}").drop("prediction_index", "probabilities")
    return scored.withColumn("prediction_timestamp", timestamp if timestamp is not None else now_text()).withColumn(
        "model_version", F.lit(version))


def variant_predictions(
    joint: DataFrame, features: Sequence[str], key: str, variant: str,
    label_name: str = "prediction", probability_name: str = "probability",
) -> DataFrame:
    """The prediction table of one variant out of :func:`joint_predictions`."""
    return joint.select(
        key, *features, F.col(f"`label:{variant}`").alias(label_name), F.col(f"`probability:{variant}`").alias(probability_name),
        "prediction_timestamp", "model_version", F.lit(variant).alias("model_variant"))


def key_figures(key: str) -> dict[str, Column]:
    """Row count and a sum of key hashes: two sets of rows that agree in both hold the same keys equally often."""
    return {"rows": F.count(F.lit(1)), "key_sum": F.coalesce(F.sum(F.xxhash64(key).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))}


def null_figures(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Rows without a value for each column."""
    return {f"null_{c}": count_where(is_missing(df, c)) for c in columns}


def smoke_predictions(df: DataFrame, model: GaussianNB, key: str, n: int | None = 5) -> DataFrame:
    """Predictions of the first ``n`` rows by key, for a look before a full run; writes nothing."""
    few = head(df, n if n and n > 0 else 5, [key])
    return gnb.with_scores(few, model).select(key, "prediction", gnb.predicted_probability().alias("probability"))


def probability_stats(predictions: DataFrame, probability: str = "probability") -> DataFrame:
    return predictions.agg(
        F.min(probability).alias("min"), F.max(probability).alias("max"), F.avg(probability).alias("mean"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """``(value, n, percent)``, percent of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return group_counts(df, column).select(column, "n", (F.col("n") * 100.0 / total).alias("percent"))


def label_distribution(df: DataFrame, column: str, subject: str) -> DataFrame:
    """``(subject, label, n, percent)``: how often each label occurs, as text."""
    return distribution(df, column).select(
        F.lit(subject).alias("subject"), F.col(column).cast("string").alias("label"), "n", "percent")


# -------------------------------------------------------------------------------- comparing two sets

def comparison_table(
    a: DataFrame, b: DataFrame, key: str, label: str = "prediction", names: tuple[str, str] = ("label_a", "label_b")
) -> DataFrame:
    """``(key, label of a, label of b)`` for keys present in both."""
    left = a.select(key, F.col(label).alias(names[0]))
    return left.join(b.select(key, F.col(label).alias(names[1])), key, "inner")


def agreement(comparison: DataFrame, first: str, second: str) -> DataFrame:
    """Counts and percentages (4 decimals) of equal and different labels; 0 when there are no rows."""
    same = count_where(F.col(first) == F.col(second))
    return _rates(comparison.agg(F.count(F.lit(1)).alias("total"), same.alias("agreement")))


def _rates(row: DataFrame) -> DataFrame:
    rate = F.when(F.col("total") > 0, F.col("agreement") * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    return row.select(
        "total", "agreement",
        (F.col("total") - F.col("agreement")).alias("disagreement"),
        F.round(rate, 4).alias("agreement_rate"),
        F.round(100.0 - rate, 4).alias("disagreement_rate"),
    )


def mismatch_patterns(comparison: DataFrame, first: str, second: str) -> DataFrame:
    return group_counts(comparison.filter(F.col(first) != F.col(second)), first, second)


def disagreeing_keys(comparison: DataFrame, key: str, first: str, second: str, n: int = 10) -> DataFrame:
    return head(comparison.filter(F.col(first) != F.col(second)).select(key), n, [key])


def label_pairs(joint: DataFrame, variants: Sequence[str]) -> list[tuple]:
    """``(label of a, label of b, n)``, a row for each pair that occurs: as many as the models' labels give at most."""
    return [tuple(r) for r in group_counts(joint, *(f"`label:{v}`" for v in variants)).collect()]


def pair_reports(spark: SparkSession, joint: DataFrame, variants: Sequence[str], names: tuple[str, str]) -> dict[str, DataFrame]:
    """``agreement``, ``mismatches`` and ``distribution`` of two variants, all from one count of their label pairs."""
    kind = joint.schema[f"label:{variants[0]}"].dataType.simpleString()
    pairs = label_pairs(joint, variants)
    total, same = sum(n for *_, n in pairs), sum(n for a, b, n in pairs if a == b and a is not None)
    given = [Counter(), Counter()]
    for *labels, n in pairs:
        for counts, label in zip(given, labels):
            counts[None if label is None else str(label)] += n
    return {
        "agreement": _rates(local_frame(spark, [(total, same)], "total bigint, agreement bigint")),
        "mismatches": local_frame(
            spark, [p for p in pairs if None not in p and p[0] != p[1]], f"`{names[0]}` {kind}, `{names[1]}` {kind}, n bigint"),
        "distribution": local_frame(
            spark, [(v, label, n, n * 100.0 / total) for v, counts in zip(variants, given) for label, n in counts.items()],
            "subject string, label string, n bigint, percent double"),
    }


def regression_gate(new: DataFrame, stored: DataFrame, key: str, label: str = "prediction") -> DataFrame:
    """Agreement of new with stored predictions; passes only at 100 percent of all shared keys."""
    both = comparison_table(new, stored, key, label, (f"{label}_new", f"{label}_stored"))
    return agreement(both, f"{label}_new", f"{label}_stored").select(
        "total", "agreement", "agreement_rate",
        ((F.col("total") > 0) & (F.col("total") == F.col("agreement"))).alias("passed"))


# ------------------------------------------------------------------------------------------- gates

def prediction_facts(
    predictions: DataFrame, inputs: DataFrame, key: str, required: Sequence[str], denied: Iterable[str] = ()
) -> DataFrame:
    """One row: counts over predictions and inputs in one aggregate, plus the schema check.

    Coverage is decided on keys, not just on row counts: keys of each side missing on the other.
    """
    sides = predictions.select(
        F.lit(True).alias("__p"), F.col(key).alias("__key"), *[F.col(c) for c in required if c != key]
    ).unionByName(
        inputs.select(F.lit(False).alias("__p"), F.col(key).alias("__key")), allowMissingColumns=True
    )
    is_prediction = F.col("__p")
    nulls = [
        count_where(is_prediction & is_missing(sides, "__key" if c == key else c)).alias(f"null_{c}") for c in required
    ]
    per_key = sides.groupBy("__key").agg(
        F.count_if(is_prediction).alias("__np"), F.count_if(~is_prediction).alias("__ni"), *nulls
    )
    legacy = [c for c in predictions.columns if c in set(denied)]
    return per_key.agg(
        F.coalesce(F.sum("__ni"), F.lit(0)).alias("input_rows"),
        F.coalesce(F.sum("__np"), F.lit(0)).alias("rows"),
        F.count_if(F.col("__np") > 0).alias("distinct_keys"),
        F.count_if((F.col("__ni") > 0) & (F.col("__np") == 0)).alias("inputs_without_prediction"),
        F.count_if((F.col("__ni") == 0) & (F.col("__np") > 0)).alias("predictions_without_input"),
        *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in required],
    ).select(
        "*",
        _sum_of([f"null_{c}" for c in required]).alias("total_null"),
        F.lit(len(legacy)).cast("bigint").alias("denied_columns"),
    )


def written_facts(
    spark: SparkSession, written: Mapping[str, object], scored: Mapping[str, object], distinct_keys: int, columns: Iterable[str],
    required: Sequence[str], denied: Iterable[str] = (),
) -> DataFrame:
    """The row of :func:`prediction_facts` from figures taken while inputs were scored and predictions written.

    Holds only where :func:`key_figures` of both agree: then the predictions are those of the input's keys.
    """
    nulls = {f"null_{c}": int(written[f"null_{c}"]) for c in required}
    row = {
        "input_rows": int(scored["rows"]), "rows": int(written["rows"]), "distinct_keys": distinct_keys,
        "inputs_without_prediction": 0, "predictions_without_input": 0, **nulls, "total_null": sum(nulls.values()),
        "denied_columns": len(set(columns) & set(denied))}
    return local_frame(spark, [tuple(row.values())], ", ".join(f"`{name}` bigint" for name in row))


def _sum_of(names: Sequence[str]) -> Column:
    total = F.lit(0).cast("bigint")
    for n in names:
        total = total + F.col(n)
    return total


def prediction_gates(facts: DataFrame) -> DataFrame:
    return gates(facts, {
        "row_count": F.col("rows") == F.col("input_rows"),
        "unique_key": F.col("rows") == F.col("distinct_keys"),
        "no_nulls": F.col("total_null") == 0,
        "coverage": (F.col("inputs_without_prediction") == 0) & (F.col("predictions_without_input") == 0)
        & (F.col("rows") == F.col("input_rows")),
        "no_denied_columns": F.col("denied_columns") == 0,
        "grain": F.col("distinct_keys") == F.col("rows"),
    })


def table_facts(table: DataFrame, key: str, required: Sequence[str], expected_rows: int | Column) -> DataFrame:
    """One row of counts that decide whether a promoted table equals its source."""
    missing = [c for c in required if c not in table.columns]
    present = [c for c in required if c in table.columns]
    expected = expected_rows if isinstance(expected_rows, Column) else F.lit(int(expected_rows))
    return table.agg(
        F.count(F.lit(1)).alias("rows"),
        distinct_with_null(F.col(key)).alias("distinct_keys"),
        *[count_where(F.col(c).isNull()).alias(f"null_{c}") for c in present],
    ).select(
        expected.cast("bigint").alias("expected_rows"), "*",
        _sum_of([f"null_{c}" for c in present]).alias("total_null"),
        F.lit(len(missing)).cast("bigint").alias("missing_columns"),
    )


def table_gates(facts: DataFrame) -> DataFrame:
    return gates(facts, {
        "row_count": F.col("rows") == F.col("expected_rows"),
        "unique_key": F.col("distinct_keys") == F.col("rows"),
        "no_nulls": F.col("total_null") == 0,
        "schema": F.col("missing_columns") == 0,
    })


def input_facts(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """One row of counts over an inference input."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(key).alias("distinct_keys"),
        duplicate_count(F.col(key)).alias("duplicate_keys"),
        count_where(F.col(key).isNull()).alias("null_key"),
        *[count_where(is_missing(df, f)).alias(f"null_{f}") for f in features],
    )


def counted_input(
    spark: SparkSession, scored: Mapping[str, object], distinct_keys: int, key: str, features: Sequence[str]
) -> DataFrame:
    """The row of :func:`input_facts` from figures taken while the input was scored."""
    null_key = int(scored[f"null_{key}"])
    row = {
        "rows": int(scored["rows"]), "distinct_keys": distinct_keys, "duplicate_keys": int(scored["rows"]) - distinct_keys - min(null_key, 1),
        "null_key": null_key, **{f"null_{f}": int(scored[f"null_{f}"]) for f in features}}
    return local_frame(spark, [tuple(row.values())], ", ".join(f"`{name}` bigint" for name in row))


def input_gates(facts: DataFrame, columns: Sequence[str], key: str, features: Sequence[str]) -> DataFrame:
    return gates(facts, {
        "features_present": F.lit(all(f in columns for f in features)),
        "no_extra_columns": F.lit(set(columns) <= {key, *features}),
        "features_filled": _sum_of([f"null_{f}" for f in features]) == 0,
        "key_filled": F.col("null_key") == 0,
        "key_unique": F.col("duplicate_keys") == 0,
        "grain": F.col("rows") == F.col("distinct_keys"),
    })


def require_columns(df: DataFrame, key: str, features: Sequence[str]) -> None:
    """Stop when a feature is missing or anything but key and features is there; looks at the schema only."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise InvalidDataset(f"features missing from the input: {missing}")
    check_leakage(df, features, key)


def require_scorable(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Stop before scoring when the input is unfit; returns the gate rows otherwise."""
    require_columns(df, key, features)
    return require_passed(input_gates(input_facts(df, key, features), df.columns, key, features))


def require_passed(rows: DataFrame) -> DataFrame:
    """The gate rows of an inference input, if all have passed."""
    failed = [r["gate"] for r in rows.collect() if not r["passed"]]
    if failed:
        raise InvalidDataset(f"inference input failed {failed}")
    return rows


# --------------------------------------------------------------- index and vector columns of Spark ML

def label_of_index(index: Column, labels: Sequence[str], default: str) -> Column:
    """Label at a (truncated) index; ``default`` when it is NULL, NaN or out of range. A negative index
    counts from the end."""
    i = index.cast("double").try_cast("int")
    wrapped = F.when(i < 0, i + len(labels)).otherwise(i)
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in labels]), wrapped), F.lit(default))


def vector_values(vector: Column) -> Column:
    """Elements of a Spark ML vector as an array; empty for NULL."""
    from pyspark.ml.functions import vector_to_array

    empty = F.array().cast(T.ArrayType(T.DoubleType()))
    return F.when(vector.isNotNull(), vector_to_array(vector)).otherwise(empty)
