"""Holdout evaluation, cross-validation and final fit of the two variants (plain, oversampled)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.staging import stage
from . import evaluate, gnb
from .gnb import GaussianNB
from .resample import balanced, copy_ranks, shortfalls, smote, smote_folds
from .split import StratifiedSplit, stratified_split


def fit_variant(
    df: DataFrame, key: str, features: Sequence[str], label: str, oversample: bool, k: int = 5, seed: int = 42,
    counts: Mapping | None = None, cuts: Mapping | None = None,
) -> GaussianNB:
    """Fit on all rows of a stored table, after oversampling if asked."""
    if not oversample:
        return gnb.fit(df, features, label)
    synthetic = smote(df, key, label, features, k, seed, counts, cuts)
    return gnb.fit(balanced(df, synthetic, features, label), features, label)


def split_for(
    df: DataFrame, key: str, label: str, test_share: float = 0.2, folds: int = 10, seed: int = 42, k: int = 5
) -> StratifiedSplit:
    """A split that also knows where the extra copies of oversampling end, found on the same passes."""
    return stratified_split(df, key, label, test_share, folds, seed, lambda *sizes: copy_ranks(*sizes, k))


def _cuts_for(split: StratifiedSplit, sizes: Mapping, k: int) -> Mapping | None:
    """The split's cuts if they cover oversampling to these class sizes."""
    known = all(n % sizes[c] == 0 or (c, n % sizes[c]) in split.cuts for c, n in shortfalls(sizes, k).items())
    return split.cuts if known else None


def holdout(
    df: DataFrame, split: StratifiedSplit, features: Sequence[str], oversample: bool, k: int = 5
) -> tuple[GaussianNB, DataFrame]:
    """Model of the training part, and the scored test part."""
    order = split.order
    parts = split.with_part(df)
    cuts = _cuts_for(split, split.train, k) if oversample else None
    model = fit_variant(
        parts.filter("part = 'train'").drop("part"), order.key, features, order.label, oversample, k, order.seed,
        split.train, cuts)
    return model, gnb.with_scores(parts.filter("part = 'test'").drop("part"), model)


def cross_validate(
    df: DataFrame, split: StratifiedSplit, features: Sequence[str], positive, oversample: bool, k: int = 5
) -> DataFrame:
    """``(fold, accuracy, precision, recall, f1)`` over the folds of the training part.

    One aggregate gives the moments of every fold; a round's model merges the other folds' moments.
    All rounds are scored in one pass, each row by the model that did not see it. The folds are assigned once and
    stored with the columns that the passes read.
    """
    label = split.order.label
    narrow = df.select(split.order.key, label, *features)
    folded = stage(split.with_fold(narrow).filter("fold IS NOT NULL"), "folded")
    stats = gnb.moments(folded, features, ["fold", label])
    extra = None
    if oversample:
        synthetic = smote_folds(folded, split, features, k)
        extra = gnb.moments(synthetic, features, ["held_out", label])
    rounds = sorted({f for f, _ in stats})
    models = gnb.fit_folds(stats, rounds, features, extra)
    labels = models[rounds[0]].labels
    cells = evaluate.confusion_cells(
        gnb.with_scores(folded, models, "fold"), label, "prediction", labels, ["fold"])
    return evaluate.binary_metrics(cells, labels, positive, ["fold"])


@dataclass(frozen=True)
class TrainedVariant:
    """Everything known about a trained variant; frames are small and lazy."""

    variant: str
    oversample: bool
    split: StratifiedSplit
    features: tuple[str, ...]
    label: str
    positive: object
    cv: DataFrame
    cv_summary: DataFrame
    dev_model: GaussianNB
    scored_test: DataFrame
    holdout: DataFrame
    report: DataFrame
    confusion: DataFrame
    model: GaussianNB


def train_variant(
    df: DataFrame, key: str, features: Sequence[str], label: str, positive,
    variant: str, oversample: bool, test_share: float = 0.2, folds: int = 10, k: int = 5, seed: int = 42,
    split: StratifiedSplit | None = None,
) -> TrainedVariant:
    """Split, cross-validate inside the training part, evaluate on the holdout, refit on all rows."""
    if split is None:
        split = split_for(df, key, label, test_share, folds, seed, k) if oversample else stratified_split(
            df, key, label, test_share, folds, seed)
    cv = cross_validate(df, split, features, positive, oversample, k)
    dev_model, scored = holdout(df, split, features, oversample, k)
    cells = evaluate.confusion_cells(scored, label, "prediction", dev_model.labels)
    return TrainedVariant(
        variant=variant, oversample=oversample, split=split, features=tuple(features), label=label,
        positive=positive, cv=cv, cv_summary=evaluate.fold_summary(cv), dev_model=dev_model,
        scored_test=scored, holdout=evaluate.binary_metrics(cells, dev_model.labels, positive),
        report=evaluate.classification_report(cells, dev_model.labels),
        confusion=evaluate.confusion_matrix(scored, label, "prediction", dev_model.labels),
        model=fit_variant(
            df, key, features, label, oversample, k, seed, split.counts,
            _cuts_for(split, split.counts, k) if oversample else None),
    )
