"""Remove lines that many sites share: sketches of distinct sites, and exact counts where a sketch is too near to call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

_BLANKS = " \t\n\x0b\f\r"
_LINE = ["_h1", "_h2"]
_ROW = ["_id", "_text_hash"]
#: log2 of the sketch's registers; at 12 the relative standard error is below 2 percent.
SKETCH_BITS = 12
NEAR = 0.1
#: A list of removed lines goes to every task, at about 50 bytes and 4 a place, up to so many documents and four times as
#: many places (50 MB); a longer one meets the documents in a sorted join.
BROADCAST_ROWS = 800_000


def _lines(df: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """A row for each line with a word: document, place, site and a 128-bit hash of the line without outer blanks."""
    exploded = df.select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("\0")).alias("_site"),
        F.posexplode(F.split(text_col, "\n", -1)).alias("_place", "_line")).withColumn("_line", F.btrim("_line", F.lit(_BLANKS)))
    return exploded.filter("_line != ''").select(
        *_ROW, "_site", "_place", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(1), "_line").alias("_h2"))


def shared_lines(df: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Occurrences of lines that occur at least ``min_sites`` times, and the lines among them that so many sites share.

    Counting occurrences comes first: a line that occurs less often cannot be on so many sites, so the sketches are kept
    for the few others only. Both results are stored, narrow tables.
    """
    lines = _lines(df, id_col, text_col, site_col)
    often = stage(lines.groupBy(*_LINE).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_sites).select(*_LINE), "often")
    occurrences = stage(lines.join(often, _LINE), "occurrences")
    spread = stage(occurrences.groupBy(*_LINE).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("_site", SKETCH_BITS)).alias("_sites"),
        F.min(F.struct(*_ROW, "_place")).alias("_first")), "spread")
    margin = max(1, round(min_sites * NEAR))
    near = spread.filter(F.abs(F.col("_sites") - min_sites) <= margin)
    exact = occurrences.join(near.select(*_LINE, "_first"), _LINE).groupBy(*_LINE).agg(
        F.count_distinct("_site").alias("_sites"), F.min("_first").alias("_first"))
    sure = spread.filter(F.col("_sites") > min_sites + margin)
    found = sure.unionByName(exact.filter(F.col("_sites") >= min_sites))
    return occurrences, stage(found.select(*_LINE, "_first"), "boilerplate")


def cleaned_rows(df: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``row`` (a struct of all columns of ``df``, the text without shared lines), n_lines and n_removed of every row.

    The caller's columns travel in one struct, so they may have any names; see :func:`drop_shared_lines` for the rest.
    """
    named = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{site_col}`").alias("site"))
    occurrences, boilerplate = shared_lines(named, min_sites, "id", "text", "site")
    removed = (occurrences.join(boilerplate, _LINE).filter(F.struct(*_ROW, "_place") != F.col("_first"))
               .groupBy(*_ROW).agg(F.sort_array(F.collect_set("_place")).alias("_removed")))
    removed = stage(removed, "removed")
    rows, places = removed.agg(F.count("*"), F.coalesce(F.sum(F.size("_removed")), F.lit(0))).first()
    side = F.broadcast(removed) if rows <= BROADCAST_ROWS and places <= 4 * BROADCAST_ROWS else removed
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")).withColumn("text", F.col(f"row.`{text_col}`"))
    joined = packed.withColumn("_hash", F.xxhash64("text")).join(
        side, F.col(f"row.`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text_hash")), "left")
    split = joined.withColumn("_all", F.split("text", "\n", -1))
    # what stands between two removed lines is one slice, so the work is in proportion to the lines
    bounds = split.withColumn("_cuts", F.when(F.col("_removed").isNotNull(), F.concat(F.array(F.lit(-1)), "_removed", F.array(F.size("_all")))))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_cuts") - 1), lambda i: F.slice(
        F.col("_all"), F.get("_cuts", i - 1) + 2, F.get("_cuts", i) - F.get("_cuts", i - 1) - 1)))
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(F.filter("_all", lambda x: F.btrim(x, F.lit(_BLANKS)) != "")), F.lit(0)).cast("long")
    return bounds.select(
        F.struct(*((text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in df.columns)).alias("row"),
        F.greatest(n_lines, F.lit(0)).alias("n_lines"),
        F.greatest(F.coalesce(F.size("_removed"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"))


def drop_shared_lines(df: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``df`` without the lines that at least ``min_sites`` sites share, and n_lines and n_removed appended.

    Of each such line the first occurrence stays, in the order of ids, text hashes and places, so nothing vanishes from
    the collection. Lines are compared without outer blanks; lines without a word are never removed. Documents that
    lose no line keep their text byte for byte; one that loses all has an empty text. A null text stays null and has no
    lines; a null site counts as one site; rows with equal id and text are treated alike. An empty table gives no row.
    Columns of ``df`` named n_lines or n_removed raise; other names are free.
    """
    clash = {"n_lines", "n_removed"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    return cleaned_rows(df, min_sites, id_col, text_col, site_col).select("row.*", "n_lines", "n_removed")
