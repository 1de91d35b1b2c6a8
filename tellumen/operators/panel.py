"""Dense calendars, trailing windows and their flattenings, all as frames over one partitioning by drive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellumen.sources.fleet import KEY


def densify(labelled: DataFrame, features: list[str]) -> DataFrame:
    """One row per drive and calendar day; `present` is the share of features that were there, missing values are
    filled forward, then with 0; inserted days have label -1. The gap after each row is exploded, so the calendar
    needs no second scan and no join."""
    w = Window.partitionBy(*KEY).orderBy("ds")
    nxt = F.coalesce(F.lead("ds").over(w), F.date_add("ds", 1))
    held = [F.last(F.nanvl(F.col(c), F.lit(None)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in features]
    there = sum((~(F.col(c).isNull() | F.isnan(c))).cast("double") for c in features) / float(len(features))
    df = labelled.select(*KEY, "vendor", "ds", "label", there.alias("present"), nxt.alias("nxt"), *held)
    df = df.withColumn("day", F.explode(F.sequence("ds", F.date_sub("nxt", 1))))
    real = F.col("day") == F.col("ds")
    return df.select(*KEY, "vendor", F.col("day").alias("ds"), F.when(real, F.col("label")).otherwise(-1).alias("label"), F.when(real, F.col("present")).otherwise(0.0).alias("present"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in features])


def windows(dense: DataFrame, features: list[str], length: int = 30, stride: int = 1, positive_stride: int | None = None, least: float = 0.5) -> DataFrame:
    """One row per window end that is labelled, on stride and present enough, with mean, std, min, max, last, delta
    and slope of each feature over the trailing frame."""
    w = Window.partitionBy(*KEY).orderBy("ds")
    frame = w.rowsBetween(-(length - 1), 0)
    df = dense.withColumn("pos", F.row_number().over(w) - 1)
    out = {"presence": F.avg("present").over(frame)}
    for c in features:
        out |= {f"{c}_mean": F.avg(c).over(frame), f"{c}_std": F.stddev_pop(c).over(frame), f"{c}_min": F.min(c).over(frame), f"{c}_max": F.max(c).over(frame), f"{c}_last": F.col(c), f"{c}_delta": F.col(c) - F.first(c).over(frame), f"{c}_slope": F.regr_slope(F.col(c), F.col("pos").cast("double")).over(frame)}
    df = df.withColumns(out)
    step = F.when(F.col("label") == 1, positive_stride or stride).otherwise(stride)
    on = (F.col("pos") >= length - 1) & (F.col("label") >= 0) & (F.pmod(F.col("pos") - (length - 1), step) == 0) & (F.col("presence") >= least)
    return df.filter(on).withColumnsRenamed({"ds": "end_ds", "label": "y"}).drop("present", "pos", *features)
