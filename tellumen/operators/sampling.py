"""Hash-ordered samples and holdouts; every draw is fixed by its seed and keys, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellumen.functions.scalars import uniform
from tellumen.sources.fleet import KEY


def hashed(seed: int, keys: list[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def smallest(df: DataFrame, n: int | Column, order: Column, keys: list[str]) -> DataFrame:
    """The n rows first in a hash order, by a cut-off that the order's leading 16 bits give, so that only rows of one
    bucket are numbered together; n may be a column that is the same in all rows."""
    df = df.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, 4))
    size = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    size = size.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    df = df.join(F.broadcast(size), "_b").filter(F.col("_before") < n)
    df = df.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy("_o", *keys)) + F.col("_before"))
    return df.filter(F.col("_k") <= n).drop("_o", "_b", "_before", "_k")


def cap_negatives(df: DataFrame, cap: int, keys: list[str], label: str = "label", seed: int = 42) -> DataFrame:
    """All positives, and as many negatives as the cap leaves room for."""
    pos = df.filter(F.col(label) == 1)
    room = F.broadcast(pos.agg((F.lit(cap) - F.count(F.lit(1))).alias("_room")))
    neg = smallest(df.filter(F.col(label) == 0).crossJoin(room), F.col("_room"), hashed(seed, keys), keys).drop("_room")
    return pos.unionByName(neg)


def sample_drives(drives: DataFrame, n: int, keep_failed: bool = True, seed: int = 42) -> DataFrame:
    """All failed drives and n healthy ones, or n drives in proportion to the failure rate (half-even)."""
    bad, good = drives.filter("drive_label = 1"), drives.filter("drive_label = 0")
    if keep_failed:
        return bad.unionByName(smallest(good, n, hashed(seed, KEY), KEY))
    share = F.broadcast(drives.agg(F.bround(F.lit(float(n)) * F.avg("drive_label")).cast("long").alias("_n")))
    take = lambda side, k: smallest(side.crossJoin(share), k, hashed(seed, KEY), KEY).drop("_n")
    return take(bad, F.col("_n")).unionByName(take(good, F.lit(n) - F.col("_n")))


def stage_holdout(df: DataFrame, stage: int, cal: float = 0.2, seed: int = 42) -> DataFrame:
    """Windows of one stage as test, the others split by drive; not drive-disjoint with test, by design."""
    rest = F.when(uniform(seed, *KEY) < cal, "cal").otherwise("train")
    return df.withColumn("part", F.when(F.col("stage") == stage, "test").otherwise(rest))


def matched_strata(df: DataFrame, n: int, keys: list[str], label: str = "label", seed: int = 42) -> DataFrame:
    """`stratum` 0 ... n - 1 with the same prevalence: each label's rows in hash order, cut in n equal runs. Rows are
    numbered within 4,096 hash buckets a label, whose sizes place the buckets."""
    df = df.withColumn("_o", hashed(seed, keys)).withColumn("_b", F.substring("_o", 1, 3))
    size = df.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(label)
    size = size.withColumns({"_before": F.sum("_c").over(w.orderBy("_b")) - F.col("_c"), "_n": F.sum("_c").over(w)}).drop("_c")
    df = df.join(F.broadcast(size), [label, "_b"])
    k = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_o", *keys)) - 1 + F.col("_before")
    return df.withColumn("stratum", F.floor(k * n / F.col("_n")).cast("int")).drop("_o", "_b", "_before", "_n")


def one_per_drive(df: DataFrame, drive: list[str], keys: list[str], seed: int = 42) -> DataFrame:
    """One row of each drive, first in hash order; an aggregation with partial minima, not a sort."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(c).alias(f"_{c}") for c in drive]).agg(F.min_by(row, hashed(seed, keys)).alias("_r")).select("_r.*")
