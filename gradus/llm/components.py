"""Connected components of a table of links, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage


def components(links: DataFrame) -> DataFrame:
    """node and label (its component's smallest node) of every node in ``links`` (a, b); stored.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so far ends of a
    chain meet in about as many rounds as its length has binary digits. Every round is a stored table.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnsRenamed({"node": "b", "label": "seen"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lowered = labels.join(seen, "node").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("low"))
        jumped = lowered.join(labels.withColumnsRenamed({"node": "low", "label": "further"}), "low").select(
            "node", "was", F.least("low", "further").alias("label"))
        after = stage(jumped, "labels")
        labels = after.select("node", "label")
        if after.filter("label < was").isEmpty():
            return labels
