"""From documents to training sequences: quality rules, line dedup, one document of each near-duplicate group, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import jaccard_join, line_dedup, packing, quality_rules
from gradus.llm.queries import BYTE_BPE
from gradus.sources.staging import stage

_BLANKS = " \t\n\x0b\f\r"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source."""
    return quality_rules.keep_good(docs)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten or more sources share; one that lost all its words goes.

    A column ``n_chars``, where there is one, follows the text.
    """
    cleaned = line_dedup.cleaned_rows(docs)
    text, lost = F.col("row.text"), F.col("n_removed") > 0
    emptied = F.coalesce(lost & (F.btrim(text, F.lit(_BLANKS)) == ""), F.lit(False))
    n_chars = F.when(lost, F.length(text)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    return cleaned.filter(~emptied).select(*((n_chars if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; of repeated rows one.

    Rows are named by id and text: one without id, or with an id that others have too, goes only if it is a copy itself.
    The names that go, fewer than those that stay, are broadcast up to a number of rows; beyond, the join sorts.
    """
    groups = stage(jaccard_join.first_of_groups(docs.select("doc_id", "text")), "groups")
    gone = stage(groups.filter("not is_first").select(F.col("key").alias("gone")).distinct(), "gone")
    repeated = stage(groups.filter("is_first").groupBy(F.col("key").alias("again")).count().filter("count > 1").select("again"), "repeated")
    sides = [F.broadcast(side) if side.count() <= jaccard_join.BROADCAST_IDS else side for side in (gone, repeated)]
    keyed = docs.select(jaccard_join.document_key("doc_id", "text").alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = keyed.join(sides[0], F.col("key") == F.col("gone"), "left_anti").join(sides[1], F.col("key") == F.col("again"), "left")
    marked = left.select("row", F.col("again").isNotNull().alias("several"), F.col("row.doc_id").alias("id"), F.col("row.text").alias("text"))
    once = marked.filter("several").dropDuplicates(["id", "text"])
    return marked.filter("not several").unionByName(once).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, BYTE_BPE)


STAGES = [("quality_rules", good_quality), ("line_dedup", without_shared_lines), ("jaccard_join", one_of_each_group), ("packing", packed)]

#: Tokenisation has no counterpart in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
