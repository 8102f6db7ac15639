"""Connected components of a link table: every node gets the smallest id it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from audira.llm.shared import settle


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (id, component) for every id that has a link.

    Each round a node takes the smallest label among its neighbours and its own, then the label of that label, so distances
    halve. A hub with very many links is only one key of a min(), which Spark combines before the shuffle. Empty links give
    an empty table; links from a node to itself are allowed.
    """
    both = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("lower"))
        roots = labels.select(F.col("id").alias("lower"), F.col("component").alias("root"))
        moved = settle(lower.join(roots, "lower").select("id", F.col("component").alias("before"), F.least("lower", "root").alias("component")))
        changed = moved.where("component < before").count()
        labels = moved.select("id", "component")
        if not changed:
            return labels
