"""Splits whose classes are a table: the same as with constants, and any number of classes."""

import hashlib
from collections import Counter, defaultdict

import pytest
from gradus.operators import split as splits
from gradus.operators.quality import InvalidDataset
from gradus.operators.ranks import positions, running


def test_running_places_and_sums(spark):
    rows = [(i * 7919 % 1000, i % 13) for i in range(1000)]
    got = running(spark.createDataFrame(rows, "k long, v long").repartition(5), ["k"], "place", {"before": "v"}).collect()
    before, expected = 0, {}
    for place, (k, v) in enumerate(sorted(rows)):
        expected[k] = (place, before)
        before += v
    assert {r.k: (r.place, r.before) for r in got} == expected


def test_positions_equal_a_sort_inside_each_group(spark):
    rows = [(g, (i * 7919) % 3000 - 1500, i) for g in "ab" for i in range(2500)] + [("c", 5, 1)]
    got = positions(spark.createDataFrame(rows, "g string, b long, i long"), "g", "b", ["i"], "place", "total").collect()
    expected = {}
    for g in "abc":
        own = sorted((b, i) for h, b, i in rows if h == g)
        expected |= {(g, b, i): (place, len(own)) for place, (b, i) in enumerate(own)}
    assert {(r.g, r.b, r.i): (r.place, r.total) for r in got} == expected


def _assigned(df, split):
    folds = split.with_fold(df).collect()
    parts = {r.key: r.part for r in split.with_part(df).collect()}
    return {r.key: (r.fold, parts[r.key]) for r in folds}


@pytest.mark.parametrize("folds", [3, 10])
def test_class_table_equals_constants(spark, monkeypatch, folds):
    rows = [(i, f"c{i % 7 if i % 3 else 0}") for i in range(700)] + [(1000, "rare"), (1001, "rare")]
    df = spark.createDataFrame(rows, "key long, label string").cache()
    constants = splits.stratified_split(df, "key", "label", folds=folds)
    assert isinstance(constants, splits.StratifiedSplit)
    monkeypatch.setattr(splits, "MOST_CLASSES", 3)
    table = splits.stratified_split(df, "key", "label", folds=folds)
    assert isinstance(table, splits.ClassTableSplit)
    assert _assigned(df, table) == _assigned(df, constants)
    assert {r.label: (r.n, r.train, list(r.sizes)) for r in table.classes.collect()} == {
        c: (n, constants.train[c], list(constants.folds[c])) for c, n in constants.counts.items()}


def test_class_table_refuses_what_constants_refuse(spark, monkeypatch):
    monkeypatch.setattr(splits, "MOST_CLASSES", 0)
    for rows in ([(1, "a"), (2, "a"), (3, "b")], [(1, None), (2, None), (3, "b"), (4, "b")]):
        with pytest.raises(InvalidDataset):
            splits.stratified_split(spark.createDataFrame(rows, "key long, label string"), "key", "label")


def test_a_hundred_thousand_classes(spark):
    """Every class has its exact share, the hot one too."""
    classes, hot = 100_000, 50_000
    df = spark.range(2 * classes + hot).selectExpr("id AS key", f"IF(id < {hot}, -1, (id - {hot}) % {classes}) AS label")
    split = splits.stratified_split(df, "key", "label", folds=2)
    assert isinstance(split, splits.ClassTableSplit)
    counts = {-1: hot} | dict.fromkeys(range(classes), 2)
    train = splits.train_sizes(counts, 0.2)
    sizes = splits.fold_sizes(train, 2)
    got = defaultdict(Counter)
    for r in split.with_fold(df).groupBy("label", "fold").count().collect():
        got[r.label][r.fold] = r["count"]
    assert all([got[c][0], got[c][1]] == sizes[c] and got[c][None] == n - train[c] for c, n in counts.items())
    digest = {i: hashlib.md5(f"42:{i}".encode()).hexdigest() for i in range(hot)}
    first = sorted(range(hot), key=lambda i: (digest[i], i))[:sizes[-1][0]]
    assert {r.key for r in split.with_fold(df).filter("label = -1 AND fold = 0").collect()} == set(first)
