"""Connected components of a link table, by the smallest label, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.common import save


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, component) for every node of links (a, b); component is its smallest node. Each step
    takes the smallest label next door and then follows that label's own label, so a chain
    shortens by half or more in a step. Labels are written after each step."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = save(both.distinct(), folder, f"{name}-edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
    labels = save(labels.select("node", F.least("node", "b").alias("label")), folder, f"{name}-0")
    step = 0
    while True:
        step += 1
        near = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        own = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = lower.join(own, "next", "left").select(
            "node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")
        )
        written = save(moved, folder, f"{name}-{step}")
        labels = written.select("node", "label")
        if not written.where("moved").limit(1).count():
            return labels.withColumnRenamed("label", "component")
