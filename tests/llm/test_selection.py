"""Sharding, whitening and importance resampling against brute force, on the small tables and on odd rows."""

import hashlib
import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from gradus.llm import importance, sharding, whitening
from gradus.operators import ranks

WORDS = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# -- ranks -------------------------------------------------------------------------------------------------------

def test_positions_equal_a_sort_over_many_runs(spark):
    rows = [(g, (i * 7919) % 5000 - 2500, i) for g in "ab" for i in range(4000)] + [("c", 5, 1)]
    got = ranks.positions(spark.createDataFrame(rows, "g string, b long, i long"), "g", "b", ["i"], "p", "n").collect()
    expected = {}
    for g in "abc":
        own = sorted((b, i) for h, b, i in rows if h == g)
        expected |= {(g, b, i): (p, len(own)) for p, (b, i) in enumerate(own)}
    assert {(r.g, r.b, r.i): (r.p, r.n) for r in got} == expected


# -- op11 --------------------------------------------------------------------------------------------------------

def _check_shards(rows, shards, source):
    """Counts at most one apart, slots gapless, and each source spread as its share asks, but for rounding."""
    sizes = Counter(r.shard for r in rows)
    counts = [sizes[k] for k in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1 and set(sizes) <= set(range(shards))
    for shard in sizes:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sizes[shard]))
    of = Counter(map(source, rows))
    held = Counter((source(r), r.shard) for r in rows)
    for s, n in of.items():
        for shard in range(shards):
            assert abs(held[s, shard] - n / shards) < 2 + len(of) * n / len(rows)


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_shards_match_the_mixture(documents, shards):
    rows = sharding.interleave(documents, shards).collect()
    _check_shards(rows, shards, lambda r: r.source)
    assert {(r.doc_id, r.text, r.lang) for r in rows} == {(r.doc_id, r.text, r.lang) for r in documents.collect()}


def test_a_hot_source_is_spread_and_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 8)
    rows = [(i, "hot" if i % 3 else f"s{i % 60}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = sharding.interleave(df, 24).collect()
    _check_shards(got, 24, lambda r: r.source)
    again = sharding.interleave(df.repartition(13), 24).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}
    other = sharding.interleave(df, 24, seed=7).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} != {(r.doc_id, r.shard, r.slot) for r in other}


def test_shards_of_odd_rows(spark, odd_documents):
    names = ["row", "__row", "__rank", "group", "place", "total", "bucket", "__n", "__at"]
    df = odd_documents.select("*", *(odd_documents["n_chars"].alias(c) for c in names))
    rows = sharding.interleave(df, 5).collect()
    _check_shards(rows, 5, lambda r: r.source)
    assert Counter(str(tuple(r)[:-2]) for r in rows) == Counter(str(tuple(r)) for r in df.collect())
    assert sharding.interleave(df.limit(0)).count() == 0
    assert len(sharding.interleave(df.limit(2), 24).collect()) == 2
    with pytest.raises(ValueError, match="slot"):
        sharding.interleave(df.withColumnRenamed("part", "Slot"))
    nameless = spark.createDataFrame([(None, "a", 1)] * 50, "doc_id long, source string, slots int")
    _check_shards(sharding.interleave(nameless, 6).collect(), 6, lambda r: r.source)


def test_written_shards_hold_whole_texts_in_slot_order(spark, documents, tmp_path):
    out = sharding.write_shards(documents, str(tmp_path / "shards"), 4, files=2)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(r.doc_id, r.text) for r in documents.collect()}
    folder = tmp_path / "shards" / "shard=2"
    slots = [r.slot for f in sorted(os.listdir(folder)) if f.endswith(".parquet") for r in spark.read.parquet(str(folder / f)).collect()]
    assert slots == list(range(50))


# -- op12 --------------------------------------------------------------------------------------------------------

def _check_whitening(df, got, components=4):
    source = [(r.vec_id, r.embedding) for r in df.collect()]
    usable = [(i, np.floor(256 * np.array(e, np.float64)).astype(np.int64)) for i, e in source
              if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    x = np.array([v for _, v in usable])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    gap = fit - s / n
    values, vectors = np.linalg.eigh(gap.T @ gap / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert {r.n for r in got} == {n}
    expected = Counter((i, k + 1, int(((n * v - s).astype(object) ** 2).sum())) for i, v in usable for k in range(components))
    assert Counter((r.vec_id, r.component, r.deviation) for r in got) == expected
    for k in range(components):
        own = sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == k + 1)
        z = sorted((str(i), int(((n * v - s).astype(object) ** 2).sum()), float((v - s / n) @ vectors[:, k] / math.sqrt(values[k]))) for i, v in usable)
        flip = 1 if abs(own[0][2] - z[0][2]) < abs(own[0][2] + z[0][2]) else -1
        assert max(abs(a[2] - flip * b[2]) for a, b in zip(own, z)) < 1e-8
        assert {round(r.explained - values[k] / values.sum(), 9) for r in got if r.component == k + 1} == {0}
    assert {r.identity_error < 1e-9 for r in got} == {True}


@pytest.mark.parametrize("rows", [1024, 7])
def test_whitening_agrees_with_numpy(spark, sf, monkeypatch, rows):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", rows)
    monkeypatch.setattr(whitening, "TASK_BLOCKS", 3)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    _check_whitening(df, whitening.whiten(df).collect())


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    plain = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(30)]
    rows = plain + plain[:4] + [(100 + i, plain[0][1]) for i in range(40)] + [
        (None, plain[1][1]), (200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [math.nan] * 5), (203, [math.inf, 0.0, 0.0, 0.0, 0.0]), (204, [1e300] + [0.0] * 4)]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "vec_id long, embedding array<double>, h1 string, block int")
    _check_whitening(df.filter("vec_id IS NULL OR vec_id <> 204"), whitening.whiten(df).collect())
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(ValueError, match="length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))


def test_whitening_without_variance(spark):
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r)[2:] for r in same] == [(1, 0, None, None, None)] * 4
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(3)], "vec_id long, embedding array<float>")).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)} and max(r.identity_error for r in line) < 1e-9


def test_deviations_beyond_a_long_are_null(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1e8]), (3, [1e16])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(df).collect()}
    x = [0, int(256e8), int(256e16)]
    assert got == {i + 1: v if (v := (3 * a - sum(x)) ** 2) < 1 << 63 else None for i, a in enumerate(x)}


# -- op13 --------------------------------------------------------------------------------------------------------

def slow_features(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def test_feature_sums_of_odd_texts():
    texts = ["", None, "One", "one two", "a" * 63 + " " + "b" * 64 + " " + "c" * 65 + " d", "x" * 5000 + " yy " + "z" * 777, "Éa 漢字\tß-1 A_B\nÄ", "one two three four"]
    memo = importance.Words()
    n_words, owner, sums = importance.feature_sums(texts, importance.Shift(), memo)
    for k, text in enumerate(texts):
        n, expected = slow_features(text)
        assert (n_words[k], Counter(sums[owner == k].tolist())) == (n, Counter(expected))


def test_bit_planes_weigh_like_plain_sums():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 3, (40, 100)) * rng.integers(0, 2000, (40, 100)) // 1500
    counts[3] = 0
    counts[4, 99] = 1 << 20
    gains = rng.integers(-9000, 9000, 100).tolist()
    assert importance.weigh(importance.to_planes(counts), importance.gain_planes(gains), 100) == (counts @ np.array(gains)).tolist()
    assert importance.weigh([b"", b""], importance.gain_planes(gains), 100) == [0, 0]


def slow_resample(docs, target, percent=5, least=20):
    found = [(i, *slow_features(t)) for i, t in docs]
    own, wanted = Counter(), Counter()
    for _, _, f in found:
        own.update(x % 10000 for x in f)
    for t in target:
        wanted.update(x % 10000 for x in slow_features(t)[1])
    s, t = sum(own.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log(((wanted[b] + 1) * (s + 10000)) / ((own[b] + 1) * (t + 10000)))) for b in range(10000)]
    scored = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x % 10000] for x in f)
        scored.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[:percent * len(fit) // 100])}
    return Counter((r[0], *r[2:], rank.get(id(r))) for r in scored)


@pytest.mark.parametrize("percent", [5, 50])
def test_resampling_agrees_with_brute_force(spark, sf, documents, percent):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = importance.resample(documents, benchmark, percent).collect()
    assert Counter(map(tuple, got)) == slow_resample([(r.doc_id, r.text) for r in documents.collect()], [r.text for r in benchmark.collect()], percent)


def test_resampling_of_odd_rows(spark, odd_documents):
    target = spark.createDataFrame([(1, None), (2, "word1 other2 word3")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    for goal in (target, target.limit(0)):
        got = importance.resample(odd_documents.withColumnRenamed("token", "score"), goal, percent=60, least_words=5).collect()
        assert Counter(map(tuple, got)) == slow_resample(docs, [r.text for r in goal.collect()], 60, 5)
    assert importance.resample(odd_documents.limit(0), target).count() == 0


# -- workers without the package ---------------------------------------------------------------------------------

def test_workers_need_not_find_the_package(tmp_path):
    """Started from another folder, with the package on the driver's path only."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from gradus.llm import importance, whitening
docs = spark.createDataFrame([(1, "some plain words")], "doc_id long, text string")
assert importance.resample(docs, docs).count() == 1
assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<float>")).count() == 4
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert ran.stdout.split()[-1:] == ["done"], ran.stderr[-2000:]
