"""Importance resampling towards a target: hashed n-gram buckets, bit-sliced sums of gains, Gumbel keys, exact ranks.

A document's features are its runs of one to three words; each falls in a bucket by its CRC-32. A document's bucket counts
are kept as bit planes: bit b of plane j is bit j of the count of bucket b. The gains of the buckets, whole numbers, are cut
into planes alike, positive and negative ones apart. A document's weight, the sum of counts times gains, is then
the sum over pairs of planes of 2^(i + j) times the number of bits that both have: AND, popcount, a power of two.

The planes are stored once; corpus counts and weights are both read from them, so texts are split once.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import positions
from ..sources.staging import stage
from .arrow import in_slices, over_batches

# the functions travel to the workers with their code, so no worker has to find this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MEMO_WORDS = 1 << 18
#: Documents whose counts are spread out over all buckets at a time: 64 rows of 10,000 counts are 2.5 MB.
_ROWS = 64


class Shift:
    """CRC-32 of two strings joined: the first one's, moved past as many bytes as the second has, XOR the second's.

    Moving past a byte is linear, so it is a look-up for each byte of the sum. There are tables for lengths up to 64;
    longer ones are put together from powers of two.
    """

    SHORT = 64

    def __init__(self) -> None:
        # a byte b that is followed by a zero byte: crc32 is affine, the constant part cancels in the XOR
        zero = zlib.crc32(bytes(1))
        one = np.array([[self._past(np.uint32(b << 8 * k), zero) for b in range(256)] for k in range(4)], np.uint32)
        tables = [np.array([[b << 8 * k for b in range(256)] for k in range(4)], np.uint32), one]
        while len(tables) <= self.SHORT:
            tables.append(self._look(one, tables[-1]))
        self.tables = np.stack(tables)
        self.powers = [one]  # past 2^i bytes
        while len(self.powers) < 40:
            self.powers.append(self._look(self.powers[-1], self.powers[-1]))

    @staticmethod
    def _past(crc: np.uint32, zero: int) -> int:
        return zlib.crc32(bytes(1), int(crc)) ^ zero

    @staticmethod
    def _look(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        short = np.minimum(length, self.SHORT)
        t = self.tables
        moved = t[short, 0, crc & 255] ^ t[short, 1, crc >> 8 & 255] ^ t[short, 2, crc >> 16 & 255] ^ t[short, 3, crc >> 24]
        for at in np.flatnonzero(length > self.SHORT):
            left, value = int(length[at]), crc[at:at + 1]
            for bit, table in enumerate(self.powers):
                if left >> bit & 1:
                    value = self._look(table, value)
            moved[at] = value[0]
        return moved


class Words(dict):
    """Numbers of words, and for each word its length and the sums of it without and with a blank after it."""

    def __init__(self) -> None:
        self.lengths, self.bare, self.blank = array("q"), array("I"), array("I")

    def __missing__(self, word: bytes) -> int:
        crc = zlib.crc32(word)
        self[word] = number = len(self.lengths)
        self.lengths.append(len(word))
        self.bare.append(crc)
        self.blank.append(zlib.crc32(b" ", crc))
        return number


def feature_sums(texts: list[str | None], shift: Shift, memo: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, number of the text of each feature, and CRC-32 of each feature."""
    found = [_WORD.findall((t or "").encode().translate(_LOWER)) for t in texts]
    n_words = np.array([len(f) for f in found], np.int64)
    numbers = np.fromiter(map(memo.__getitem__, chain.from_iterable(found)), np.int64, int(n_words.sum()))
    lengths, bare, blank = (np.array(a, t) for a, t in ((memo.lengths, np.int64), (memo.bare, np.uint32), (memo.blank, np.uint32)))
    owner = np.repeat(np.arange(len(texts)), n_words)
    owners, sums = [owner], [bare[numbers]]
    heads = blank[numbers]  # a run and a blank after it, by its first word
    for k in (1, 2):
        last = numbers[k:]
        if not len(last):
            break
        same = owner[k:] == owner[:-k]
        heads = heads[:len(last)]
        joined = shift(heads, lengths[last]) ^ bare[last]
        owners.append(owner[k:][same])
        sums.append(joined[same])
        if k == 1:
            heads = shift(heads, lengths[last] + 1) ^ blank[last]
    return n_words, np.concatenate(owners), np.concatenate(sums)


def _bytes_of(buckets: int) -> int:
    return -(-buckets // 64) * 8


def to_planes(counts: np.ndarray) -> list[bytes]:
    """Bit planes of each row of counts, one after the other, each padded to whole 64-bit words."""
    rows, buckets = counts.shape
    most = counts.max(axis=1, initial=0)
    planes, level = [b""] * rows, 0
    live = np.flatnonzero(most)
    while len(live):
        bits = np.zeros((len(live), _bytes_of(buckets) * 8), bool)
        bits[:, :buckets] = counts[live] >> level & 1
        for row, packed in zip(live, np.packbits(bits, axis=1, bitorder="little")):
            planes[row] += packed.tobytes()
        level += 1
        live = live[most[live] >> level > 0]
    return planes


def bucket_planes(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` columns, n_words, n_features and the bit planes of the bucket counts of every whole text; one scan."""
    def run(source: Iterator) -> Iterator[dict]:
        shift, memo = Shift(), Words()
        for batch in source:
            for part in in_slices(batch, "__text"):
                if len(memo) > _MEMO_WORDS:
                    memo = Words()
                n_words, owner, sums = feature_sums(part.column("__text").to_pylist(), shift, memo)
                order = np.argsort(owner, kind="stable")
                owner, bucket = owner[order], (sums[order] % buckets).astype(np.int64)
                ends = np.searchsorted(owner, np.arange(0, part.num_rows + _ROWS, _ROWS))
                planes = []
                for first, a, b in zip(range(0, part.num_rows, _ROWS), ends, ends[1:]):
                    rows = min(_ROWS, part.num_rows - first)
                    counts = np.bincount((owner[a:b] - first) * buckets + bucket[a:b], minlength=rows * buckets)
                    planes += to_planes(counts.reshape(rows, buckets))
                n_features = np.bincount(owner, minlength=part.num_rows)
                yield {"n_words": n_words, "n_features": n_features, "planes": planes} | {c: part.column(f"c{i}") for i, c in enumerate(carry)}

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in carry)
    named = df.select(F.col(f"`{text_col}`").alias("__text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)))
    return over_batches(named, named.columns, run, f"{kinds}n_words long, n_features long, planes binary")


def bucket_counts(planes: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket: sums of planes in every task, then one row for each task and hundred buckets.

    What reaches the driver has ``buckets`` rows, whatever the input.
    """
    def run(source: Iterator) -> Iterator[dict]:
        total = np.zeros(buckets, np.int64)
        for batch in source:
            for packed in batch.column("planes").to_pylist():
                bits = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, _bytes_of(buckets)), axis=1, count=buckets, bitorder="little")
                for level, plane in enumerate(bits):
                    total += plane.astype(np.int64) << level
        yield {"bucket": np.arange(buckets), "n": total}

    sums = np.zeros(buckets, np.int64)
    for row in over_batches(planes, ["planes"], run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[row["bucket"]] = row["n"]
    return sums


def gains_of(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """Thousandths of the log ratio of target to corpus share of every bucket, smoothed by one, rounded down."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return [math.floor(1000 * math.log(((t + 1.0) * (s_all + n)) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())]


def gain_planes(gains: list[int]) -> list[tuple[int, np.ndarray]]:
    """``(signed power of two, plane as 64-bit words)`` of the positive and of the negative gains."""
    values = np.array(gains, np.int64)
    planes = []
    for sign in (1, -1):
        size = np.maximum(sign * values, 0)
        for level in range(int(size.max(initial=0)).bit_length()):
            bits = np.zeros(_bytes_of(len(gains)) * 8, bool)
            bits[:len(gains)] = size >> level & 1
            planes.append((sign << level, np.packbits(bits, bitorder="little").view(np.uint64)))
    return planes


def weigh(packed: list[bytes], sliced: list[tuple[int, np.ndarray]], buckets: int = BUCKETS) -> list[int]:
    """Exact sums of counts times gains of rows of bit planes."""
    words = _bytes_of(buckets) // 8
    levels = np.array([len(p) // (8 * words) for p in packed], np.int64)
    if not levels.sum():
        return [0] * len(packed)
    planes = np.frombuffer(b"".join(packed), np.uint64).reshape(-1, words)
    level = np.arange(len(planes)) - np.repeat(np.cumsum(levels) - levels, levels)
    sums = np.zeros(len(planes), np.int64)
    for power, plane in sliced:
        sums += power * np.bitwise_count(planes & plane).sum(axis=1, dtype=np.int64)
    sums <<= level
    edges = np.concatenate([[0], np.cumsum(sums)])
    ends = np.cumsum(levels)
    return (edges[ends] - edges[ends - levels]).tolist()


def importance_weights(planes: DataFrame, gains: list[int], carry: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """``carry`` columns and the weight of every row of bit planes."""
    sliced = gain_planes(gains)

    def run(source: Iterator) -> Iterator[dict]:
        for batch in source:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                yield {"weight": weigh(part.column("planes").to_pylist(), sliced, buckets)} | {c: part.column(c) for c in carry}

    kinds = "".join(f"`{c}` {planes.schema[c].dataType.simpleString()}, " for c in carry)
    return over_batches(planes, [*carry, "planes"], run, f"{kinds}weight long")


def resample(df: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 42,
             buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """For every row of ``df``: id, n_features, weight, score and rank; drawn are the rows that have a rank.

    score = weight + floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 32 bits of sha256(``seed``:id): drawing the
    highest scores is drawing without replacement with probabilities that follow the weights. Of the N rows with at least
    ``least_words`` words, floor(N * ``percent`` / 100) are drawn; equal scores go by id, nulls first.

    A null or wordless text has no features and weight 0; a null id counts as the empty string in the hash. Repeated rows
    are rows of their own, each counted and drawn by itself. An empty target makes all its counts 0, an empty ``df``
    gives no row. Only the id and the text of ``df`` are read, so other columns never clash. A text is held once, with
    some 100 bytes a word while it is split.
    """
    named = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    planes = stage(bucket_planes(named, "text", buckets, ("id",)), "planes")
    wanted = bucket_counts(bucket_planes(target.select(F.col(f"`{target_text_col}`").alias("text")), "text", buckets), buckets)
    gains = gains_of(bucket_counts(planes, buckets), wanted)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = stage(importance_weights(planes, gains, ("id", "n_words", "n_features"), buckets).withColumn("score", F.col("weight") + gumbel), "scored")
    fit = F.col("n_words") >= least_words
    ranked = positions(
        scored.filter(fit).select("id", "n_features", "weight", "score", F.lit(0).alias("all"), (-F.col("score")).alias("bucket")),
        "all", "bucket", ["id"], "place", "total")
    drawn = F.when(F.col("place") < F.floor(F.col("total") * percent / 100), F.col("place") + 1)
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    return ranked.select(*columns, drawn.cast("long").alias("rank")).unionByName(
        scored.filter(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))
