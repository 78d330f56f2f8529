"""Gaussian Naive Bayes from distributed moments; scoring as column arithmetic.

Fitting is one aggregate of (count, mean, variance) per class -- or per class and fold -- whose
result has as many rows as there are classes and folds. Everything after that (merging folds,
priors, smoothing) is arithmetic on those few rows. Scoring puts the parameters into the plan as
literals, so it runs inside the scan's generated code without join, shuffle or Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from math import log, pi

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import InvalidDataset

VAR_SMOOTHING = 1e-9


@dataclass(frozen=True)
class Moments:
    """Count, means and sums of squared deviations of a set of rows."""

    n: int
    mean: tuple[float, ...]
    m2: tuple[float, ...]

    def __add__(self, other: "Moments") -> "Moments":
        """Moments of the union (pairwise update; avoids the cancellation of raw square sums)."""
        if self.n == 0 or other.n == 0:
            return other if self.n == 0 else self
        n = self.n + other.n
        delta = [b - a for a, b in zip(self.mean, other.mean)]
        return Moments(
            n,
            tuple(a + d * other.n / n for a, d in zip(self.mean, delta)),
            tuple(p + q + d * d * self.n * other.n / n for p, q, d in zip(self.m2, other.m2, delta)),
        )

    @property
    def var(self) -> tuple[float, ...]:
        return tuple(s / self.n for s in self.m2)


def merge(parts: Iterable[Moments]) -> Moments:
    total = Moments(0, (), ())
    for p in parts:
        total = total + p
    return total


def moments(df: DataFrame, features: Sequence[str], groups: Sequence[str]) -> dict[tuple, Moments]:
    """Moments per group value tuple. Groups are classes and folds, so the result is small."""
    stats = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.avg(F.col(f).cast("double")).alias(f"__mean_{i}") for i, f in enumerate(features)],
        *[F.var_pop(F.col(f).cast("double")).alias(f"__var_{i}") for i, f in enumerate(features)],
    )
    k = range(len(features))
    return {
        tuple(r[g] for g in groups): Moments(
            r["__n"],
            tuple(r[f"__mean_{i}"] for i in k),
            tuple(r[f"__var_{i}"] * r["__n"] for i in k),
        )
        for r in stats.collect()
    }


@dataclass(frozen=True)
class GaussianNB:
    """Fitted parameters. ``labels`` are sorted; a class index is a position in them."""

    labels: tuple
    features: tuple[str, ...]
    count: tuple[int, ...]
    prior: tuple[float, ...]
    mean: tuple[tuple[float, ...], ...]
    var: tuple[tuple[float, ...], ...]

    @classmethod
    def from_moments(cls, by_label: Mapping[object, Moments], features: Sequence[str]) -> "GaussianNB":
        present = {c: m for c, m in by_label.items() if m.n}
        if not present:
            raise InvalidDataset("no rows to fit on")
        labels = sorted(present)
        everything = merge(present.values())
        if not max(everything.var) > 0:
            raise InvalidDataset("no feature varies")
        epsilon = VAR_SMOOTHING * max(everything.var)
        return cls(
            labels=tuple(labels),
            features=tuple(features),
            count=tuple(present[c].n for c in labels),
            prior=tuple(present[c].n / everything.n for c in labels),
            mean=tuple(present[c].mean for c in labels),
            var=tuple(tuple(v + epsilon for v in present[c].var) for c in labels),
        )

    def class_mapping(self) -> dict:
        return {label: i for i, label in enumerate(self.labels)}

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """Parameter table, one row per class and feature; labels keep their type."""
        kind = spark.createDataFrame([(label,) for label in self.labels], ["label"]).schema["label"].dataType
        schema = T.StructType([
            T.StructField("label", kind), T.StructField("label_index", T.IntegerType()),
            T.StructField("feature", T.StringType()), T.StructField("feature_index", T.IntegerType()),
            T.StructField("n", T.LongType()), T.StructField("prior", T.DoubleType()),
            T.StructField("mean", T.DoubleType()), T.StructField("var", T.DoubleType()),
        ])
        rows = [
            (label, i, feature, j, self.count[i], self.prior[i], self.mean[i][j], self.var[i][j])
            for i, label in enumerate(self.labels) for j, feature in enumerate(self.features)
        ]
        return spark.createDataFrame(rows, schema)

    @classmethod
    def from_frame(cls, params: DataFrame) -> "GaussianNB":
        return cls.from_rows(params.collect())

    @classmethod
    def from_rows(cls, rows: Iterable[Row]) -> "GaussianNB":
        """From the collected rows of :meth:`to_frame`."""
        rows = sorted(rows, key=lambda r: (r["label_index"], r["feature_index"]))
        labels = list(dict.fromkeys(r["label"] for r in rows))
        per = {c: [r for r in rows if r["label"] == c] for c in labels}
        return cls(
            labels=tuple(labels),
            features=tuple(r["feature"] for r in per[labels[0]]),
            count=tuple(per[c][0]["n"] for c in labels),
            prior=tuple(per[c][0]["prior"] for c in labels),
            mean=tuple(tuple(r["mean"] for r in per[c]) for c in labels),
            var=tuple(tuple(r["var"] for r in per[c]) for c in labels),
        )


def fit(df: DataFrame, features: Sequence[str], label: str) -> GaussianNB:
    stats = moments(df, features, [label])
    if any(k[0] is None for k in stats):
        raise InvalidDataset(f"{label} has NULL values")
    return GaussianNB.from_moments({k[0]: m for k, m in stats.items()}, features)


def fit_folds(
    stats: Mapping[tuple, Moments], folds: Iterable[int], features: Sequence[str],
    extra: Mapping[tuple, Moments] | None = None,
) -> dict[int, GaussianNB]:
    """One model per held-out fold from ``{(fold, label): moments}``: every model merges the other folds.

    ``extra`` adds rows that belong to a fold's training part only (synthetic rows), keyed alike.
    """
    labels = sorted({label for _, label in stats})
    models = {}
    for held_out in folds:
        by_label = {
            c: merge([m for (f, label), m in stats.items() if f != held_out and label == c]
                     + ([extra[(held_out, c)]] if extra and (held_out, c) in extra else []))
            for c in labels
        }
        models[held_out] = GaussianNB.from_moments(by_label, features)
    return models


# ---------------------------------------------------------------------------------------- scoring

def _parameters(models: Mapping[int, GaussianNB], fold: Column | None):
    """Accessor turning a per-model number into a literal, or a literal array indexed by fold."""
    if fold is None:
        only = next(iter(models.values()))
        return lambda pick: F.lit(float(pick(only)))
    size = max(models) + 1
    return lambda pick: F.get(F.lit([float(pick(models[f])) if f in models else float("nan") for f in range(size)]), fold)


def _log_scores(models: Mapping[int, GaussianNB], fold: Column | None) -> list[Column]:
    first = next(iter(models.values()))
    if any(m.labels != first.labels for m in models.values()):
        raise InvalidDataset("fold models disagree on the classes")
    p = _parameters(models, fold)
    scores = []
    for c in range(len(first.labels)):
        constant = p(lambda m: log(m.prior[c]) - 0.5 * sum(log(2.0 * pi * v) for v in m.var[c]))
        quadratic = None
        for j, f in enumerate(first.features):
            gap = F.col(f).cast("double") - p(lambda m, j=j: m.mean[c][j])
            term = gap * gap / p(lambda m, j=j: m.var[c][j])
            quadratic = term if quadratic is None else quadratic + term
        scores.append(constant - F.lit(0.5) * quadratic)
    return scores


def with_scores(df: DataFrame, model: GaussianNB | Mapping[int, GaussianNB], fold: str | None = None) -> DataFrame:
    """Adds ``prediction_index`` (highest joint log-likelihood, ties to the lowest index), ``prediction``
    and ``probabilities``."""
    models = {0: model} if isinstance(model, GaussianNB) else dict(model)
    labels = next(iter(models.values())).labels
    scored = df.withColumn("__scores", F.array(*_log_scores(models, F.col(fold) if fold else None)))
    best = F.array_max("__scores")
    weights = [F.exp(F.get("__scores", F.lit(i)) - best) for i in range(len(labels))]
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    index = (F.array_position("__scores", best) - 1).cast("int")
    return (
        scored.withColumn("prediction_index", index)
        .withColumn("prediction", F.get(F.array(*[F.lit(c) for c in labels]), F.col("prediction_index")))
        .withColumn("probabilities", F.array(*[w / total for w in weights]))
        .drop("__scores")
    )


def predicted_probability(index: str = "prediction_index", probabilities: str = "probabilities") -> Column:
    return F.get(F.col(probabilities), F.col(index))


def target_encoding(labels: Iterable) -> dict:
    """Class index by position in sorted order."""
    return {label: i for i, label in enumerate(sorted(labels))}


def encode(df: DataFrame, label: str, mapping: Mapping, name: str = "label_index") -> DataFrame:
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(int(v)))]
    return df.withColumn(name, F.element_at(F.create_map(*pairs), F.col(label)))


def decode(df: DataFrame, index: str, mapping: Mapping, name: str = "prediction") -> DataFrame:
    """Label of a class index from the stored mapping; an unknown index fails the job."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(int(v)), F.lit(k))]
    found = F.try_element_at(F.create_map(*pairs), F.col(index).cast("int"))
    return df.withColumn(name, F.when(found.isNull(), F.raise_error(F.concat(
        F.lit("unknown class index "), F.coalesce(F.col(index).cast("string"), F.lit("NULL"))
    ))).otherwise(found))
