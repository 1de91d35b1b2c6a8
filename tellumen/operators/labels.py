"""Failure-horizon labels and what counts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellumen.sources.fleet import KEY


def vendor(model: str = "model") -> Column:
    return F.substring(model, 2, 1)


def days_to_failure() -> Column:
    """Calendar days; null for drives that do not fail."""
    return F.datediff(F.to_date("failure_time"), F.to_date("ds"))


def in_horizon(dtf: Column, horizon: int) -> Column:
    return F.coalesce((dtf > 0) & (dtf <= horizon), F.lit(False)).cast("int")


def _by(drive=KEY):
    return Window.partitionBy(*drive)


def reasons(df: DataFrame, horizon: int, min_history: int) -> DataFrame:
    """Every row with vendor, dtf, label and the reason for which labelling drops it (null: kept). The last day is
    taken after post-failure rows went; history counts the rows that remain."""
    df = df.withColumns({"vendor": vendor(), "dtf": days_to_failure()})
    post = F.coalesce(F.col("dtf") <= 0, F.lit(False))
    df = df.withColumn("post", post).withColumn("last", F.max(F.when(~F.col("post"), F.col("ds"))).over(_by()))
    blind = F.col("dtf").isNull() & (F.datediff("last", "ds") < horizon)
    df = df.withColumn("reason", F.when(F.col("post"), "post_failure").when(blind, "unobservable"))
    kept = F.count(F.when(F.col("reason").isNull(), 1)).over(_by())
    df = df.withColumn("kept", kept)
    short = F.col("reason").isNull() & (F.col("kept") < min_history)
    return df.withColumn("reason", F.when(short, "short_history").otherwise(F.col("reason"))).withColumn("label", in_horizon(F.col("dtf"), horizon)).drop("post", "last", "kept")


def build_labels(df: DataFrame, horizon: int = 30, min_history: int = 30) -> DataFrame:
    return reasons(df, horizon, min_history).filter("reason IS NULL").drop("reason")


def label_stats(df: DataFrame, horizon: int = 30, min_history: int = 30) -> DataFrame:
    """One row: rows in, rows dropped by reason, rows out, positives, drives."""
    r = reasons(df, horizon, min_history)
    why = lambda k: F.count_if(F.coalesce(F.col("reason") == k, F.lit(False))).alias(f"n_{k}")
    kept = F.col("reason").isNull()
    return r.agg(F.count(F.lit(1)).alias("n_in"), why("post_failure"), why("unobservable"), why("short_history"), F.count_if(kept).alias("n_out"), F.coalesce(F.sum(F.when(kept, F.col("label"))), F.lit(0)).cast("long").alias("n_pos"), F.count_distinct(F.when(kept, F.struct(*KEY))).alias("n_drives"))


def drive_table(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(*KEY).agg(F.first("vendor").alias("vendor"), F.max("label").alias("drive_label"), F.count(F.lit(1)).alias("n_rows"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))


def label_summary(labelled: DataFrame) -> DataFrame:
    rows = labelled.groupBy("vendor", *KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"), F.max("label").alias("fails"))
    return rows.groupBy("vendor").agg(F.count(F.lit(1)).alias("drives"), F.sum("fails").alias("failing"), F.sum("n").alias("n_rows"), F.sum("pos").alias("positives"), F.round(100.0 * F.sum("pos") / F.sum("n"), 4).alias("pct_positive"))


def multi_horizon(labelled: DataFrame, horizons: list[int]) -> DataFrame:
    """Every row once per horizon, with that horizon's label."""
    rows = labelled.drop("label").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return rows.withColumn("label", in_horizon(F.col("dtf"), F.col("horizon")))


def key_collisions(df: DataFrame, key: str, other: str) -> DataFrame:
    """n: keys that occur with more than one value of other."""
    many = df.groupBy(key).agg((F.min(other) < F.max(other)).alias("many"))
    return many.agg(F.count_if("many").alias("n"))


def _per_drive(df: DataFrame, cond: Column) -> DataFrame:
    return df.withColumn("dtf", days_to_failure()).groupBy(*KEY).agg(F.count_if(F.coalesce(cond, F.lit(False))).alias("n"), F.max("failure_time").alias("failed"))


def post_failure_profile(df: DataFrame, limits: list[int]) -> DataFrame:
    """Days on or after the failure, per drive that has any, described in one row; quartiles are observed values."""
    n = _per_drive(df, F.col("dtf") <= 0).filter("n > 0")
    quart = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n)").cast("long").alias(name) for q, name in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    return n.agg(F.count(F.lit(1)).alias("drives"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("sd"), F.min("n").alias("lo"), *quart, F.max("n").alias("hi"), *[F.count_if(F.col("n") > k).alias(f"over_{k}") for k in limits])


def horizon_coverage(df: DataFrame, horizon: int) -> DataFrame:
    """Failed drives with any, all or none of the horizon's days."""
    n = _per_drive(df, (F.col("dtf") > 0) & (F.col("dtf") <= horizon)).filter("failed IS NOT NULL")
    return n.agg(F.count(F.lit(1)).alias("failed"), F.count_if(F.col("n") >= 1).alias("at_least_one"), F.count_if(F.col("n") == horizon).alias("whole"), F.count_if(F.col("n") == 0).alias("none"))


def history_profile(df: DataFrame, horizon: int, least: int) -> DataFrame:
    """Days of failed drives before the horizon begins."""
    n = _per_drive(df, F.col("dtf") > horizon).filter("failed IS NOT NULL")
    return n.agg(F.count(F.lit(1)).alias("failed"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count_if(F.col("n") >= least).alias("enough"))


def censoring_depth(df: DataFrame, limits: list[int]) -> DataFrame:
    """Drives without a failure by the days from their last row to the last of all."""
    end = F.broadcast(df.agg(F.max("ds").alias("end")))
    last = df.filter("failure_time IS NULL").groupBy(*KEY).agg(F.max("ds").alias("last")).crossJoin(end)
    gap = F.datediff("end", "last")
    return last.agg(F.count(F.lit(1)).alias("drives"), *[F.count_if(gap > k).alias(f"over_{k}") for k in limits])


def attach_dtf(windows: DataFrame, rows: DataFrame, checked: bool = False) -> DataFrame:
    """windows (key, ds) with dtf of the same drive and day; without such a row, or a failure, infinite. checked: an
    error when no row matches at all."""
    got = windows.join(rows.select(*KEY, "ds", days_to_failure().cast("double").alias("dtf")), [*KEY, "ds"], "left")
    if checked and windows.join(rows.select(*KEY, "ds"), [*KEY, "ds"], "left_semi").isEmpty():
        raise RuntimeError("no window matches any row")
    return got.withColumn("dtf", F.coalesce("dtf", F.lit(float("inf"))))
