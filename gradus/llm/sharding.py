"""Shards of equal size that all hold the mixture of sources: proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash of their id and ranked. A row's fractional rank (2 * rank + 1) / (2 * rows
of its source) spreads each source evenly over [0, 1); all rows in the order of their fractional ranks are cut into shards
whose counts differ by one at most. Any run of this order, so each shard, holds of each source what its share
of the rows asks for, but for rounding.

Everything is DataFrame expressions. Both orders are ranked by buckets of some ``BUCKET_ROWS`` rows, so neither a hot
source nor the whole table is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import positions
from ..sources.staging import stage

BUCKET_ROWS = 256
_HASH_BITS = 32


def _group(column: Column) -> Column:
    """A name of a stratum that is never null: a null source is a stratum of its own, the first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def interleave(df: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard) appended.

    The law is ``rows``: shards hold the floor or the ceiling of rows / ``shards``. All columns of ``df`` are carried
    through two narrow shuffles, so hand in those that are wanted: digests of a text rather than the text. ``df`` is
    read once. The same rows, seed and number of shards give the same shards on any partitioning.

    Nulls: a null source is a stratum like others; a row without an id takes its row number in the stored copy for its
    name. Repeated rows are rows of their own, next to each other in their source's order. With fewer rows than shards
    some shards stay empty; an empty table gives no row. A column of ``df`` named shard or slot raises; helper names
    are chosen so that no column of ``df`` bears them.
    """
    clash = {"shard", "slot"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    mark = "__"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    row, group, digest, bucket, rank, of, fraction, place, total = (mark + c for c in (
        "row", "group", "digest", "bucket", "rank", "of", "fraction", "place", "total"))
    carried = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(row)) if df.columns else df
    key = F.col(f"{row}.`{id_col}`")
    name = F.coalesce(key.cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    rows = stage(carried.select(row, _group(F.col(f"{row}.`{source_col}`")).alias(group), F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")).alias(digest)), "shuffled")
    n = rows.count()
    bits = min(_HASH_BITS, max(0, (n // BUCKET_ROWS).bit_length()))
    top = F.conv(F.substring(F.col(digest), 1, _HASH_BITS // 4), 16, 10).cast("long")
    within = positions(rows.withColumn(bucket, F.shiftright(top, _HASH_BITS - bits)), group, bucket, [digest, key], rank, of)
    ranked = stage(within.withColumn(fraction, (2 * F.col(rank) + 1).cast("double") / (2 * F.col(of))).select(row, group, digest, fraction), "ranked")
    spread = ranked.withColumn(bucket, F.floor(F.col(fraction) * (1 << bits)).cast("long")).withColumn(rank, F.lit(0))
    placed = positions(spread, rank, bucket, [fraction, group, digest, key], place, total)
    shard = F.expr(f"{place} * {shards} div {total}")
    first = F.expr(f"({total} * ({place} * {shards} div {total}) + {shards - 1}) div {shards}")
    return placed.select(*(F.col(f"{row}.`{c}`").alias(c) for c in df.columns), shard.cast("int").alias("shard"), (F.col(place) - first).alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 24, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", files: int = 1) -> DataFrame:
    """Write the whole rows of ``df`` below ``path``, a folder ``shard=<n>`` for each shard, and return a reader of them.

    A shard is written as ``files`` files, each a run of slots in their order; ranges of (shard, slot) are dealt to
    tasks, so more files than shards make smaller tasks.
    """
    rows = interleave(df, shards, seed, id_col, source_col)
    rows.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)
