"""Streams, an extension: daily aggregates under a watermark and scores from fixed thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellumen.operators.conformal import candidate


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """disk_id, ds, n_1, r_1, n_2, r_2 of an event stream; a day closes when the watermark has passed it."""
    df = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("_w"), F.col("user_id").alias("disk_id"))
    out = df.agg(F.count(F.lit(1)).cast("double").alias("n_1"), F.avg("value").alias("r_1"), F.max("value").alias("n_2"), F.sum((F.col("event_type") == "error").cast("int")).cast("double").alias("r_2"))
    return out.select("disk_id", F.to_date("_w.start").alias("ds"), "n_1", "r_1", "n_2", "r_2")


def online_sets(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Prediction sets of a score stream: thresholds (stage, q_h, q_f), a row per stage, is joined as a static table;
    a stage without a threshold gets both labels."""
    df = scored.join(F.broadcast(thresholds), "stage", "left")
    within = lambda k, q: F.coalesce(candidate("p", k) <= F.col(q), F.lit(True))
    return df.withColumns({"set_h": within(0, "q_h"), "set_f": within(1, "q_f")}).drop("q_h", "q_f")
