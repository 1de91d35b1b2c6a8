"""Connected components over an edge table, by repeated minimum labels with pointer jumping in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellumen.llm.common import written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): component is the smallest id reachable. edges: a, b (longs, non-null). Only counts reach
    the driver; a hub with many neighbours is pre-aggregated by the partial minimum."""
    both = edges.select("a", "b").filter("a <> b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    label = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id")
    label = written(label, "cc-label")
    for _ in range(most_rounds):
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = label.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        # Pointer jumping: follow the label's own label.
        to = label.select(F.col("id").alias("next"), F.col("component").alias("jump"))
        step = step.join(to, "next", "left").select("id", F.least("next", F.coalesce("jump", "next")).alias("component"), F.col("component").alias("was"))
        step = written(step, "cc-label")
        label = step.select("id", "component")
        if step.filter("component <> was").isEmpty():
            return label
    raise RuntimeError(f"labels still changed after {most_rounds} rounds")
