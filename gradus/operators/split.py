"""Stratified holdout and folds with exact class proportions, without sorting the data.

Inside a class, rows are ordered by the hash of their key. A part of the split is a range of hash
ranks, so all that is needed per class are the hashes at the range ends. They are found from counts
per hash prefix (one map-combined aggregate) and a ranking of only those prefixes that contain a
range end. Assigning rows is then a plain column expression over arrays with a place for each class: no
shuffle of the data, no task per class, no branch per class, same result on any partitioning.

Up to ``MOST_CLASSES`` classes the ends are constants of the plan. Beyond, counts, sizes and ends stay a stored
table with a row for each class, which rows meet by class: no class ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.hashing import key_hash, uniform
from ..sources.staging import stage
from .quality import InvalidDataset
from .ranks import running

_PREFIX_DIGITS = 4
_BROADCAST_CUTS = 1_000_000  # range ends that go to every task, about 50 bytes each; more of them are joined
MOST_CLASSES = 1000  # whose range ends are constants of the plan; more of them are a table


@dataclass(frozen=True)
class HashOrder:
    """The order of rows inside a class: hash of ``seed:key``, then the key."""

    key: str
    label: str
    seed: int = 42

    @property
    def digest(self) -> Column:
        return key_hash(self.seed, F.col(self.key))

    def up_to(self, cut: "Cut", digest: Column) -> Column:
        """Whether a row of the cut's class is at or before the cut."""
        return (digest < cut.digest) | ((digest == cut.digest) & (F.col(self.key) <= F.lit(cut.key)))


@dataclass(frozen=True)
class Cut:
    """Hash and key of the row at one rank of one class."""

    digest: str
    key: object


def _sorted_counts(rows: DataFrame, label: str) -> dict:
    """``{label: n}`` in label order, one row per class."""
    found = rows.collect()
    if any(r[label] is None for r in found):
        raise InvalidDataset(f"{label} has NULL values")
    return {r[label]: r["n"] for r in sorted(found, key=lambda r: r[label])}


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class in label order."""
    return _sorted_counts(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label)


def _with_prefix(df: DataFrame, order: HashOrder) -> DataFrame:
    return df.select(order.label, order.key, order.digest.alias("__digest")).withColumn(
        "__prefix", F.substring("__digest", 1, _PREFIX_DIGITS))


def prefix_counts(df: DataFrame, order: HashOrder) -> DataFrame:
    """Stored counts per class and hash prefix: at most 65,536 rows per class, from one pass over the data."""
    counts = _with_prefix(df, order).groupBy(order.label, "__prefix").agg(F.count(F.lit(1)).alias("__n"))
    return stage(counts, "prefix-counts")


def counts_of_prefixes(prefixes: DataFrame, label: str) -> dict:
    """Rows per class in label order, from :func:`prefix_counts`."""
    return _sorted_counts(prefixes.groupBy(label).agg(F.sum("__n").alias("n")), label)


def _small(df: DataFrame, ends: int) -> DataFrame:
    return F.broadcast(df) if ends <= _BROADCAST_CUTS else df


def rank_cuts(
    df: DataFrame, order: HashOrder, ranks: Mapping[object, Sequence[int]], prefixes: DataFrame | None = None
) -> dict:
    """``{(class, rank): Cut}`` for 1-based ranks inside each class."""
    wanted = [(label, rank) for label, rs in ranks.items() for rank in sorted(set(rs)) if rank > 0]
    if not wanted:
        return {}
    targets = df.sparkSession.createDataFrame(
        [(c, sorted({r for r in rs if r > 0})) for c, rs in ranks.items()],
        T.StructType([T.StructField(order.label, df.schema[order.label].dataType), T.StructField("__ranks", T.ArrayType(T.LongType()))]))
    counts = prefix_counts(df, order) if prefixes is None else prefixes
    hits = rows_at_ranks(df, order, _small(targets, len(wanted)), counts, len(wanted))
    return {(r[0], r[1]): Cut(r[2], r[3]) for r in hits.collect()}  # one row per requested rank


def rows_at_ranks(df: DataFrame, order: HashOrder, targets: DataFrame, prefixes: DataFrame, ends: int | None = None) -> DataFrame:
    """``(label, rank, __digest, key)`` of the rows at the ``__ranks`` that ``targets`` gives for each class.

    ``ends`` is the number of ranks where it is known; else Spark decides how to join by what it finds.
    """
    label = order.label
    running_count = Window.partitionBy(label).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, 0)
    upto, before = F.col("__upto"), F.col("__upto") - F.col("__n")
    inside = F.filter("__ranks", lambda r: (r > before) & (r <= upto))
    # prefixes that hold a range end, with the places of the ends: no more of them than ranks asked for
    holding = prefixes.withColumn("__upto", F.sum("__n").over(running_count)).join(targets, label).select(
        label, "__prefix", F.transform(inside, lambda r: F.struct((r - before).alias("at"), r.alias("rank"))).alias("__ends")
    ).filter(F.size("__ends") > 0)
    at = Window.partitionBy(label, "__prefix").orderBy("__digest", order.key)
    ranked = _with_prefix(df, order).join(holding if ends is None else _small(holding, ends), [label, "__prefix"]).withColumn(
        "__at", F.row_number().over(at))
    hit = F.get(F.filter("__ends", lambda e: e["at"] == F.col("__at")), F.lit(0))
    return ranked.withColumn("__hit", hit).filter(F.col("__hit").isNotNull()).select(label, "__hit.rank", "__digest", order.key)


def train_sizes(counts: Mapping[object, int], test_share: float) -> dict:
    """Training rows per class: test = ceil(share * n); the rest shared out in proportion, floor first,
    then by largest remainder (ties in class order)."""
    n = sum(counts.values())
    n_train = n - ceil(test_share * n)
    exact = {c: n_train * k / n for c, k in counts.items()}
    sizes = {c: floor(x) for c, x in exact.items()}
    spare = n_train - sum(sizes.values())
    for c in sorted(exact, key=lambda c: -(exact[c] - sizes[c]))[:spare]:
        sizes[c] += 1
    return sizes


def fold_sizes(counts: Mapping[object, int], folds: int) -> dict:
    """Rows per class and fold when classes are laid end to end and dealt out round-robin: every fold
    gets the floor or the ceiling of its class share, and folds differ by one row in total at most."""
    sizes, offset = {}, 0
    for c, n in counts.items():
        sizes[c] = [len(range((f - offset) % folds, n, folds)) for f in range(folds)]
        offset += n
    return sizes


def _range_number(ends: Column, order: HashOrder, parts: int) -> Column:
    """Number of the first of ``parts`` ranges that a row lies in, from the ends (digest, key) of its class's ranges:
    how many ends come before the row. An end without a digest closes an empty range at the start."""
    passed = F.filter(ends, lambda e: e["digest"].isNull() | (e["digest"] < F.col("__digest")) | (
        (e["digest"] == F.col("__digest")) & (e["key"] < F.col(order.key))))
    number = F.when(ends.isNotNull(), F.size(passed))
    return F.when(number < parts, number)


@dataclass(frozen=True)
class StratifiedSplit:
    """A holdout split with folds inside its training part, as column expressions."""

    order: HashOrder
    counts: Mapping[object, int]
    train: Mapping[object, int]
    folds: Mapping[object, Sequence[int]]
    cuts: Mapping[tuple, Cut]

    def fold_ends(self, label) -> list[int]:
        """Cumulative training rows of a class after each fold."""
        ends, total = [], 0
        for size in self.folds[label]:
            total += size
            ends.append(total)
        return ends

    def _assign(self, df: DataFrame, name: str, parts: int, ends_of) -> DataFrame:
        """Number of the range that a row's hash lies in; the ends of all classes are constants of the plan, those of
        a row's class are found by one look-up."""
        order = self.order
        cuts = [[self.cuts[(c, end)] if end else Cut(None, None) for end in ends_of(c)] for c in self.counts]

        def constants(field: str, kind: T.DataType) -> Column:
            own = F.lit([[getattr(cut, field) for cut in row] for row in cuts]).cast(T.ArrayType(T.ArrayType(kind)))
            return F.get(own, F.col("__place")).alias(field)

        labels = F.lit(list(self.counts)).cast(T.ArrayType(df.schema[order.label].dataType))
        placed = df.withColumn("__digest", order.digest).withColumn(
            "__place", F.nullif(F.array_position(labels, F.col(order.label)).cast("int") - 1, F.lit(-1)))
        ends = F.arrays_zip(constants("digest", T.StringType()), constants("key", df.schema[order.key].dataType))
        return placed.withColumn(name, _range_number(ends, order, parts)).drop("__digest", "__place")

    def with_fold(self, df: DataFrame, name: str = "fold") -> DataFrame:
        """Fold number of training rows, NULL for test rows."""
        return self._assign(df, name, len(next(iter(self.folds.values()))), self.fold_ends)

    def with_part(self, df: DataFrame, name: str = "part") -> DataFrame:
        """``train`` or ``test``."""
        assigned = self._assign(df, name, 1, lambda c: [self.train[c]])
        return assigned.withColumn(name, F.when(F.col(name) == 0, F.lit("train")).otherwise(F.lit("test")))


@dataclass(frozen=True)
class ClassTableSplit:
    """The same split for any number of classes: ``classes`` has a row for each, stored.

    Its columns are the label, ``n``, ``train`` (training rows), ``sizes`` (rows of each fold) and ``ends``, the hash and
    key of the last row of each fold.
    """

    order: HashOrder
    folds: int
    classes: DataFrame

    def _assign(self, df: DataFrame, name: str, parts: int, ends: Column) -> DataFrame:
        known = self.classes.select(F.col(self.order.label).alias("__label"), ends.alias("__ends"))
        met = df.withColumn("__digest", self.order.digest).join(known, F.col(self.order.label) == F.col("__label"), "left")
        return met.withColumn(name, _range_number(F.col("__ends"), self.order, parts)).drop("__digest", "__label", "__ends")

    def with_fold(self, df: DataFrame, name: str = "fold") -> DataFrame:
        """Fold number of training rows, NULL for test rows."""
        return self._assign(df, name, self.folds, F.col("ends"))

    def with_part(self, df: DataFrame, name: str = "part") -> DataFrame:
        """``train`` or ``test``."""
        assigned = self._assign(df, name, 1, F.slice("ends", -1, 1))
        return assigned.withColumn(name, F.when(F.col(name) == 0, F.lit("train")).otherwise(F.lit("test")))


def class_table_split(
    df: DataFrame, order: HashOrder, test_share: float = 0.2, folds: int = 10, prefixes: DataFrame | None = None
) -> ClassTableSplit:
    """Sizes by :func:`train_sizes` and :func:`fold_sizes`, and the range ends, all as columns of a table of classes."""
    label = order.label
    prefixes = prefix_counts(df, order) if prefixes is None else prefixes
    counts = stage(prefixes.groupBy(label).agg(F.sum("__n").alias("n")), "classes")
    whole = counts.agg(F.sum("n").alias("n"), F.count_if(F.col("n") < 2).alias("single"), F.count_if(F.col(label).isNull()).alias("unnamed")).first()
    if whole["unnamed"]:
        raise InvalidDataset(f"{label} has NULL values")
    if whole["n"] is None or whole["single"]:
        raise InvalidDataset(f"every class needs at least two rows; {whole['single']} have one")
    n_train = whole["n"] - ceil(test_share * whole["n"])
    exact = F.lit(n_train) * F.col("n") / F.lit(whole["n"])
    shared = counts.withColumn("__floor", F.floor(exact)).withColumn("__rest", exact - F.floor(exact))
    spare = n_train - shared.agg(F.sum("__floor").alias("n")).first()["n"]
    ranked = running(shared, [F.desc("__rest"), F.col(label)], "__rank")
    sized = ranked.select(label, "n", (F.col("__floor") + F.when(F.col("__rank") < spare, 1).otherwise(0)).alias("train"))
    laid = running(sized, [F.col(label)], "__rank", {"__offset": "train"})
    first = [F.pmod(F.lit(f) - F.col("__offset"), F.lit(folds)) for f in range(folds)]
    sizes = F.array(*(F.greatest(F.lit(0), F.floor((F.col("train") - s + folds - 1) / folds)).cast("long") for s in first))
    upto = F.transform("sizes", lambda x, i: F.aggregate(F.slice("sizes", 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    planned = stage(laid.withColumn("sizes", sizes).withColumn("__upto", upto).select(label, "n", "train", "sizes", "__upto"), "sizes")
    targets = planned.select(label, F.array_distinct(F.filter("__upto", lambda r: r > 0)).alias("__ranks"))
    hits = rows_at_ranks(df, order, targets, prefixes).groupBy(label).agg(F.map_from_entries(F.collect_list(F.struct(
        "rank", F.struct(F.col("__digest").alias("digest"), F.col(order.key).alias("key"))))).alias("__at"))
    empty = F.lit(None).cast(T.StructType([T.StructField("digest", T.StringType()), T.StructField("key", df.schema[order.key].dataType)]))
    ends = F.transform("__upto", lambda r: F.coalesce(F.try_element_at("__at", r), F.struct(empty["digest"].alias("digest"), empty["key"].alias("key"))))
    classes = planned.join(hits, label, "left").select(label, "n", "train", "sizes", ends.alias("ends"))
    return ClassTableSplit(order, folds, stage(classes, "class-ends"))


def stratified_split(
    df: DataFrame, key: str, label: str, test_share: float = 0.2, folds: int = 10, seed: int = 42,
    more_ranks: Callable[[Mapping, Mapping, Mapping], Mapping] | None = None,
) -> StratifiedSplit | ClassTableSplit:
    """Exact stratified holdout plus stratified folds inside the training part.

    ``df`` is read twice (counts per hash prefix, rows of the few boundary prefixes), so hand in a stored
    table. ``more_ranks(counts, train, folds)`` names further ranks per class to look up on the same
    passes. Without it, a table of more than ``MOST_CLASSES`` classes gives a :class:`ClassTableSplit`.
    """
    order = HashOrder(key, label, seed)
    prefixes = prefix_counts(df, order)
    if more_ranks is None and len(prefixes.select(label).distinct().limit(MOST_CLASSES + 1).collect()) > MOST_CLASSES:
        return class_table_split(df, order, test_share, folds, prefixes)
    counts = counts_of_prefixes(prefixes, label)
    if len(counts) == 0 or min(counts.values()) < 2:
        raise InvalidDataset(f"every class needs at least two rows: {counts}")
    train = train_sizes(counts, test_share)
    sizes = fold_sizes(train, folds)
    ranks = {c: sorted({sum(sizes[c][: i + 1]) for i in range(folds)} | {train[c]}) for c in counts}
    more = more_ranks(counts, train, sizes) if more_ranks else {}
    ranks = {c: [*r, *more.get(c, ())] for c, r in ranks.items()}
    return StratifiedSplit(order, counts, train, sizes, rank_cuts(df, order, ranks, prefixes))


def random_split(df: DataFrame, key: str, shares: Sequence[float], seed: int = 42, name: str = "part") -> DataFrame:
    """Unstratified split by the key's hash: shares hold on average, membership never changes."""
    u = uniform(key_hash(seed, F.col(key)))
    total, upto, part = float(sum(shares)), 0.0, None
    for i, share in enumerate(shares[:-1]):
        upto += share / total
        part = F.when(u < upto, F.lit(i)) if part is None else part.when(u < upto, F.lit(i))
    last = F.lit(len(shares) - 1)
    return df.withColumn(name, last if part is None else part.otherwise(last))
