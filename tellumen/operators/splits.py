"""Splits by drive: stratified, leave-one-vendor-out, leave-one-model-out; validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellumen.sources.fleet import KEY


def stratified(drives: DataFrame, parts: list[tuple[str, float]], strata: list[str], seed: int) -> DataFrame:
    """drives with `part`: within each stratum, in an md5 order, cut at half-even rounded cumulative fractions;
    the last part takes the rest."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in KEY]))
    w = Window.partitionBy(*strata)
    df = drives.withColumn("k", F.row_number().over(w.orderBy(order))).withColumn("n", F.count(F.lit(1)).over(w))
    acc, part = 0.0, None
    for name, share in parts[:-1]:
        acc += share
        cond = F.col("k") <= F.bround(F.lit(acc) * F.col("n"))
        part = F.when(cond, name) if part is None else part.when(cond, name)
    return df.withColumn("part", part.otherwise(parts[-1][0])).drop("k", "n")


def standard_split(drives: DataFrame, test: float = 0.2, cal: float = 0.2, seed: int = 42) -> DataFrame:
    return stratified(drives, [("test", test), ("cal", (1 - test) * cal), ("train", 1.0)], ["model", "drive_label"], seed)


def held_out_splits(drives: DataFrame, column: str, strata: list[str], cal: float = 0.2, seed: int = 42, within: str | None = None) -> DataFrame:
    """All folds in one plan: for each value of column, its drives are the test part, the rest is cal and train;
    with within only the rest that agrees with the fold in that column."""
    folds = drives.select(F.col(column).alias("fold"), *([F.col(within).alias("_within")] if within else [])).distinct()
    every = drives.crossJoin(F.broadcast(folds))
    if within:
        every = every.filter(F.col(within) == F.col("_within")).drop("_within")
    pool = stratified(every.filter(F.col(column) != F.col("fold")), [("cal", cal), ("train", 1.0)], ["fold", *strata], seed)
    return pool.unionByName(every.filter(F.col(column) == F.col("fold")).withColumn("part", F.lit("test")))


def violations(split: DataFrame, column: str) -> DataFrame:
    """Per fold: held-out rows outside test (leaked), other rows inside it (outside), drives in two parts, empty test or cal."""
    own = F.col(column) == F.col("fold")
    twice = split.groupBy("fold", *KEY).agg(F.count_distinct("part").alias("n")).groupBy("fold").agg(F.count_if(F.col("n") > 1).alias("n_overlaps"))
    out = split.groupBy("fold").agg(F.count_if(own & (F.col("part") != "test")).alias("n_leaked"), F.count_if(~own & (F.col("part") == "test")).alias("n_outside"), F.count_if(F.col("part") == "test").alias("n_test"), F.count_if(F.col("part") == "cal").alias("n_cal"))
    return out.join(twice, "fold")


def split_report(split: DataFrame) -> DataFrame:
    return split.groupBy("part").agg(F.count(F.lit(1)).alias("drives"), F.sum("drive_label").alias("positives"), F.array_join(F.array_sort(F.collect_set("vendor")), ",").alias("vendors"))


def stage_splits(drives: DataFrame, cal: float = 0.2, seed: int = 42) -> DataFrame:
    """drives (key, stage: the drive's own) once for each stage held out, with fold and part: its drives are test, the
    others cal and train, so that no drive is on two sides."""
    return held_out_splits(drives, "stage", [], cal, seed)


def usable_folds(split: DataFrame, rows: DataFrame, least_test: int = 20, least_cal: int = 10) -> DataFrame:
    """fold, positives of test and cal rows, usable. rows: key, label."""
    n = split.join(rows.select(*KEY, "label"), KEY).groupBy("fold").agg(*[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("label"))), F.lit(0)).cast("long").alias(f"{p}_pos") for p in ("test", "cal")])
    return n.withColumn("usable", (F.col("test_pos") >= least_test) & (F.col("cal_pos") >= least_cal))


def widened(split: DataFrame, folds: list, prefix: str = "part") -> DataFrame:
    """A row per drive with its part in every fold."""
    return split.groupBy(*KEY).pivot("fold", folds).agg(F.first("part")).select(*KEY, *[F.col(str(f)).alias(f"{prefix}_{f}") for f in folds])


def manifest(panel: DataFrame, labelled: DataFrame, split: DataFrame) -> DataFrame:
    """Every drive of a sample: failed, in_labelled, part (null outside the split)."""
    drives = panel.groupBy(*KEY).agg(F.max(F.col("failure_time").isNotNull()).alias("failed"))
    known = labelled.select(*KEY).distinct().withColumn("in_labelled", F.lit(True))
    out = drives.join(known, KEY, "left").join(split.select(*KEY, "part"), KEY, "left")
    return out.withColumn("in_labelled", F.coalesce("in_labelled", F.lit(False)))
