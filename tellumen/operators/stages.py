"""Wear stages: equal-mass bins, failure-rate curves, change points, stage tables, stage-by-group association."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellumen.functions.scalars import searchsorted, stage_label


def assign(age: str, edges: list[float]) -> Column:
    """Stage of an age: the number of edges at or below it."""
    cuts = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
    return searchsorted(cuts, F.col(age), bits=max(len(edges).bit_length(), 1))


def average_rank(order: Column, by: list[str], ties: list[str]) -> Column:
    """Average-tie rank of `order` within `by`; `ties` name the columns that make it."""
    first = F.rank().over(Window.partitionBy(*by).orderBy(order))
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, *ties))
    return first + (same - 1) / F.lit(2.0)


def numbered(df: DataFrame, value: str, keys: list[str], buckets: int = 256) -> DataFrame:
    """df with _k (1 ... n by value, then keys) and _n. Approximate quantiles, a bounded list, bound buckets of rows
    that are numbered apart; exact bucket sizes place them. Rows of one value share a bucket."""
    cuts = sorted({c for c in df.stat.approxQuantile(value, [k / buckets for k in range(1, buckets)], 0.25 / buckets)})
    df = df.withColumn("_b", assign(value, cuts))
    size = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    size = size.select(F.col("_b").alias("_sb"), (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(F.lit(0))).alias("_n"))
    df = df.join(F.broadcast(size), F.col("_b").eqNullSafe(F.col("_sb"))).drop("_sb")
    k = F.row_number().over(Window.partitionBy("_b").orderBy(value, *keys)) + F.col("_before")
    return df.withColumn("_k", k).drop("_b", "_before")


def equal_mass(df: DataFrame, value: str, keys: list[str], bins: int) -> DataFrame:
    """`bin` 1 ... bins by value, then keys; sizes differ by one at most, larger bins first."""
    small = F.floor(F.col("_n") / bins)
    more = F.col("_n") - small * bins
    k = F.col("_k") - 1
    cut = more * (small + 1)
    b = F.when(k < cut, F.floor(k / (small + 1))).otherwise(more + F.floor(F.try_divide(k - cut, small)))
    return numbered(df, value, keys).withColumn("bin", (b + 1).cast("int")).drop("_k", "_n")


def failure_curve(df: DataFrame, age: str, y: str, keys: list[str], bins: int = 60) -> DataFrame:
    return equal_mass(df, age, keys, bins).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(age).alias("age"), F.avg(y).alias("rate"))


def binary_segment(signal: np.ndarray, splits: int, least: int = 5) -> list[int]:
    """Greedy splits of a short signal by the largest fall in squared error, as many as the segments' lengths allow;
    the first best one wins, also where nothing falls."""
    x = np.asarray(signal, float) - np.mean(signal)
    prefix, squares = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x, x * x))

    def sse(a, b):
        return squares[b] - squares[a] - (prefix[b] - prefix[a]) ** 2 / (b - a)

    cuts = [0, len(x)]
    for _ in range(splits):
        options = [(sse(a, b) - sse(a, m) - sse(m, b), m) for a, b in zip(cuts, cuts[1:]) for m in range(a + least, b - least + 1)]
        if not options:
            break
        cuts = sorted([*cuts, max(options, key=lambda o: (o[0], -o[1]))[1]])
    return cuts[1:-1]


def changepoint_edges(df: DataFrame, age: str, y: str, keys: list[str], stages: int = 3, bins: int = 60, least: int = 5) -> list[float]:
    """Edges midway between the bin centres around each change point. The curve has `bins` rows, so it is collected."""
    curve = failure_curve(df, age, y, keys, bins).orderBy("bin").collect()
    if len(curve) < stages * least:
        raise ValueError(f"{len(curve)} bins are too few for {stages} stages")
    at = binary_segment(np.array([r.rate for r in curve], float), stages - 1, least)
    return [(curve[k - 1].age + curve[k].age) / 2 for k in at]


def quantile_edges(df: DataFrame, age: str, stages: int, groups: list[str] | None = None) -> DataFrame:
    """groups, edges: interior quantiles of the finite ages without repeats, ascending."""
    x = F.when(~F.isnan(age) & (F.abs(age) < float("inf")), F.col(age))
    q = F.percentile(x, F.array(*[F.lit(k / stages) for k in range(1, stages)]))
    return df.groupBy(*(groups or [])).agg(F.array_sort(F.array_distinct(q)).alias("edges"))


def window_age(windows: DataFrame, column: str = "r_9") -> DataFrame:
    """windows with age: the raw value at the window's end; NaN where it is not finite."""
    if column not in windows.columns:
        raise ValueError(f"{column} is not among the windows' columns")
    x = F.col(column).cast("double")
    return windows.withColumn("age", F.when(F.abs(x) < float("inf"), x).otherwise(float("nan")))


def fit_stages(df: DataFrame, age: str, y: str, keys: list[str], strategy: str = "quantile", stages: int = 5) -> list[float]:
    """Edges by quantiles or change points, fitted on df; assign() places ages between them. A short list."""
    if strategy == "changepoint":
        return changepoint_edges(df, age, y, keys, stages)
    if strategy != "quantile":
        raise ValueError(f"strategy must be quantile or changepoint, not {strategy}")
    edges = quantile_edges(df, age, stages).first().edges
    if edges is None:
        raise ValueError("no finite ages")
    return edges


def stage_table(df: DataFrame, age: str, y: str, edges: list[float]) -> DataFrame:
    """Rows, positives and rate of every stage, empty ones included (null rate)."""
    got = df.groupBy(assign(age, edges).alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"), F.round(F.avg(y), 6).alias("rate"))
    spine = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("stage"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return spine.join(F.broadcast(got), "stage", "left").select("stage", stage_label(F.col("stage"), edges).alias("name"), zero("n"), zero("positives"), "rate")


def modal_stage(df: DataFrame, drive: list[str]) -> DataFrame:
    """Most frequent stage of each drive; ties go to the lowest."""
    n = df.groupBy(*drive, "stage").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*drive).agg(F.max_by("stage", F.struct("n", -F.col("stage"))).alias("stage"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, mutual_information (nats), cramers_v of two columns."""
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    n = n.withColumns({"na": total(a), "nb": total(b), "t": total()})
    e = F.col("na") * F.col("nb") / F.col("t")
    out = n.agg(F.sum((F.col("n") - e) * (F.col("n") - e) / e).alias("chi2"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / e)).alias("mutual_information"), F.first("t").alias("t"), F.least(F.count_distinct(a), F.count_distinct(b)).alias("k"))
    return out.select("chi2", "mutual_information", F.sqrt(F.try_divide(F.col("chi2"), F.col("t") * (F.col("k") - 1))).alias("cramers_v"))
