"""SMOTE: bring every class to the size of the largest with points between near neighbours.

Each row of a smaller class is the origin of an equal number of synthetic rows; what does not divide
evenly goes to the first rows in hash order. Neighbour choice and position are hashes of (seed,
origin, copy number), so the same rows appear on every run and every cluster. Only the smaller
classes are ever searched for neighbours; the largest class is just counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import key_hash, uniform
from .metrics import union_all
from .neighbors import nearest_neighbors, outside_fold
from .quality import InvalidDataset
from .split import HashOrder, StratifiedSplit, counts_of_prefixes, prefix_counts, rank_cuts


_COPY_BLOCK = 4096


def shortfalls(counts: Mapping[object, int], k: int) -> dict:
    """Rows to add per smaller class; a class needs more than ``k`` rows to have k neighbours."""
    largest = max(counts.values())
    missing = {c: largest - n for c, n in counts.items() if n < largest}
    small = {c: counts[c] for c in missing if counts[c] <= k}
    if small:
        raise InvalidDataset(f"{k} neighbours need more than {k} rows per class: {small}")
    return missing


def _synthesize(rows: DataFrame, order: HashOrder, features: Sequence[str], k: int, *salt: str) -> DataFrame:
    """One synthetic row per copy from rows that carry ``neighbors`` and ``copies``."""
    # numbers come in blocks: no array holds more than a block, or more than the count of blocks
    blocks = rows.filter(F.col("copies") > 0).withColumn(
        "__first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1, F.lit(_COPY_BLOCK).cast("long"))))
    last = F.least(F.col("copies").cast("long"), F.col("__first") + _COPY_BLOCK)
    kind = rows.schema["copies"].dataType.simpleString()
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.col("__first") + 1, last).cast(f"array<{kind}>"))).drop("__first")
    parts = [*[F.col(s) for s in salt], F.col(order.key), F.col("copy")]
    pick = F.floor(uniform(key_hash(f"{order.seed}:pick", *parts)) * k).cast("int")
    drawn = copies.withColumn("__other", F.get("neighbors", pick)).withColumn(
        "gap", uniform(key_hash(f"{order.seed}:gap", *parts))
    )
    return drawn.select(
        *salt,
        F.col(order.key).alias("origin"),
        F.col("__other.key").alias("neighbor"),
        "copy", "gap",
        *[
            (F.col(f) + F.col("gap") * (F.get("__other.x", F.lit(j)) - F.col(f))).alias(f)
            for j, f in enumerate(features)
        ],
        order.label,
    )


def _copies(order: HashOrder, label, total: int, rows: int, cut_rank: int, cuts: Mapping) -> Column:
    each, extra = divmod(total, rows)
    if not extra:
        return F.lit(each)
    first = order.up_to(cuts[(label, cut_rank)], order.digest)
    return F.lit(each) + F.when(first, 1).otherwise(0)


def smote(
    df: DataFrame, key: str, label: str, features: Sequence[str], k: int = 5, seed: int = 42,
    counts: Mapping[object, int] | None = None, cuts: Mapping | None = None,
) -> DataFrame:
    """The synthetic rows ``(origin, neighbor, copy, gap, features..., label)`` for a stored table.

    ``counts`` and ``cuts`` may be handed in where a split of the same rows has them already.
    """
    order = HashOrder(key, label, seed)
    prefixes = prefix_counts(df, order) if counts is None or cuts is None else None
    if counts is None:
        counts = counts_of_prefixes(prefixes, label)
    missing = shortfalls(counts, k)
    ranks = {c: [n % counts[c]] for c, n in missing.items()}
    if cuts is None:
        cuts = rank_cuts(df, order, ranks, prefixes)
    parts = []
    for c, n in missing.items():
        near = nearest_neighbors(df.filter(F.col(label) == F.lit(c)), key, features, k, total=counts[c])
        copies = _copies(order, c, n, counts[c], ranks[c][0], cuts)
        parts.append(_synthesize(
            near.withColumn(label, F.lit(c)).withColumn("copies", copies), order, features, k))
    if not parts:  # balanced already: nothing to add, same columns
        empty = df.limit(0).withColumn("copies", F.lit(0)).withColumn("neighbors", F.array(F.struct(
            F.lit(0.0).alias("d2"), F.col(key).alias("key"), F.lit(-1).alias("fold"),
            F.array(F.lit(0.0)).alias("x"))))
        return _synthesize(empty, order, features, k)
    return union_all(parts)


def balanced(df: DataFrame, synthetic: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Original and synthetic rows together, reduced to features and label."""
    columns = [*[F.col(f).cast("double").alias(f) for f in features], label]
    return df.select(*columns).unionByName(synthetic.select(*columns))


def round_counts(train: Mapping[object, int], folds: Mapping[object, Sequence[int]], held_out: int) -> dict:
    """Class sizes of the training part without one fold."""
    return {c: train[c] - folds[c][held_out] for c in train}


def _round_rank(c, train: Mapping, folds: Mapping, held_out: int, missing: int) -> int:
    """Rank in the class of the last row with an extra copy, stepping over the held-out fold."""
    extra = missing % round_counts(train, folds, held_out)[c]
    before = sum(folds[c][:held_out])
    return extra if extra <= before else extra + folds[c][held_out]


def copy_ranks(counts: Mapping, train: Mapping, folds: Mapping, k: int = 5) -> dict:
    """All ranks at which extra copies end: for the whole table, the training part and every round."""
    ranks: dict = {}
    for sizes in (counts, train):
        for c, n in shortfalls(sizes, k).items():
            ranks.setdefault(c, []).append(n % sizes[c])
    for f in range(len(next(iter(folds.values())))):
        for c, n in shortfalls(round_counts(train, folds, f), k).items():
            ranks.setdefault(c, []).append(_round_rank(c, train, folds, f, n))
    return ranks


def smote_folds(
    folded: DataFrame, split: StratifiedSplit, features: Sequence[str], k: int = 5, fold: str = "fold"
) -> DataFrame:
    """Synthetic rows of all cross-validation rounds, with the round in ``held_out``.

    Each round resamples its own training folds only. The neighbour search runs once: it returns
    enough neighbours that k remain when any one fold is taken away.
    """
    order = split.order
    rounds = range(len(next(iter(split.folds.values()))))
    sizes = {f: round_counts(split.train, split.folds, f) for f in rounds}
    missing = {f: shortfalls(sizes[f], k) for f in rounds}
    classes = sorted({c for m in missing.values() for c in m})
    ranks = {(c, f): _round_rank(c, split.train, split.folds, f, n) for f in rounds for c, n in missing[f].items()}
    cuts = dict(split.cuts)
    unknown = {c: [r for (d, _), r in ranks.items() if d == c and r and (c, r) not in cuts] for c in classes}
    cuts.update(rank_cuts(folded, order, {c: rs for c, rs in unknown.items() if rs}))
    parts = []
    for c in classes:
        near = nearest_neighbors(
            folded.filter(F.col(order.label) == F.lit(c)), order.key, features, k, fold=fold, total=split.train[c])
        plan = F.array(*[
            F.struct(
                F.lit(f).alias("held_out"),
                _copies(order, c, missing[f][c], sizes[f][c], ranks[(c, f)], cuts).alias("copies"),
            )
            for f in rounds if c in missing[f]
        ])
        each_round = near.withColumn(order.label, F.lit(c)).select("*", F.inline(plan)).filter(
            F.col("held_out") != F.col(fold)
        )
        near_now = outside_fold(F.col("neighbors"), F.col("held_out"), k)
        parts.append(_synthesize(each_round.withColumn("neighbors", near_now), order, features, k, "held_out"))
    if not parts:
        raise InvalidDataset("every round is balanced already; resampling has nothing to do")
    return union_all(parts)
