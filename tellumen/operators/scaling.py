"""Normalisers and flattenings of trailing windows. A day's weight is the number of kept windows that cover it, so
statistics over all window cells need neither window tensors nor an explosion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellumen.functions.scalars import bind, median, searchsorted, spread, zero_missing
from tellumen.sources.fleet import KEY

def _drive():
    return Window.partitionBy(*KEY).orderBy("ds")


def cells(dense: DataFrame, length: int = 30, stride: int = 1, positive_stride: int | None = None, least: float = 0.5) -> DataFrame:
    """Dense days with pos, kept (a window ends here) and covers (kept windows that hold this day)."""
    df = dense.withColumn("pos", F.row_number().over(_drive()) - 1)
    step = F.when(F.col("label") == 1, positive_stride or stride).otherwise(stride)
    seen = F.avg("present").over(_drive().rowsBetween(-(length - 1), 0))
    kept = (F.col("pos") >= length - 1) & (F.col("label") >= 0) & (F.pmod(F.col("pos") - (length - 1), step) == 0) & (seen >= least)
    df = df.withColumn("kept", kept)
    return df.withColumn("covers", F.sum(F.col("kept").cast("int")).over(_drive().rowsBetween(0, length - 1)))


def fit_zscore(df: DataFrame, features: list[str]) -> DataFrame:
    """One row with c_mu and c_sd (population) of each feature over all window cells."""
    n = F.sum("covers").cast("double")
    out = []
    for c in features:
        mu = F.try_divide(F.sum(F.col("covers") * F.col(c)), n)
        square = F.try_divide(F.sum(F.col("covers") * F.col(c) * F.col(c)), n)
        out += [mu.alias(f"{c}_mu"), F.sqrt(F.greatest(square - mu * mu, F.lit(0.0))).alias(f"{c}_sd")]
    return df.filter("covers > 0").agg(*out)


def zscore(df: DataFrame, stats: DataFrame, features: list[str], eps: float = 1e-8) -> DataFrame:
    scaled = {c: (F.col(c) - F.col(f"{c}_mu")) / F.when(F.col(f"{c}_sd") < eps, 1.0).otherwise(F.col(f"{c}_sd")) for c in features}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*stats.columns)


def constant_features(stats: DataFrame, features: list[str], eps: float = 1e-6) -> DataFrame:
    """feature, sd of the features whose spread over all window cells is below eps."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_sd").alias("sd")) for c in features])
    return stats.select(F.inline(rows)).filter(F.col("sd") < eps)


def fit_rank(df: DataFrame, features: list[str], group: str, grid: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Quantile grids of each feature per group (groups of two cells or more) and pooled; one row of arrays a group."""
    share = F.array(*[F.lit(k / (grid - 1)) for k in range(grid)])
    grids = [F.percentile(c, share, F.col("covers")).alias(f"{c}_g") for c in features]
    used = df.filter("covers > 0")
    own = used.groupBy(group).agg(F.sum("covers").alias("n"), *grids).filter("n >= 2").drop("n")
    return own, used.agg(*grids).withColumnsRenamed({f"{c}_g": f"{c}_all" for c in features})


def rank(df: DataFrame, own: DataFrame, pooled: DataFrame, features: list[str], group: str, grid: int = 1000) -> DataFrame:
    """Each value's place in its group's grid, in [-0.5, 0.5]; unseen groups use the pooled grid."""
    bits = grid.bit_length() + 1
    df = df.join(F.broadcast(own), group, "left").crossJoin(F.broadcast(pooled))
    place = {c: searchsorted(F.coalesce(f"{c}_g", f"{c}_all"), F.col(c), right=False, bits=bits) / F.lit(grid - 1.0) - 0.5 for c in features}
    return df.withColumns(place).drop(*[f"{c}_{s}" for c in features for s in ("g", "all")])


def steps(c: str, length: int) -> Column:
    """The window's values, oldest first."""
    return F.collect_list(c).over(_drive().rowsBetween(-(length - 1), 0))


def self_scaled(arr: Column, head: int = 5, eps: float = 1e-8) -> Column:
    """A window by the median and MAD of its own first steps; the window's spread, then 1, replace a MAD of 0."""
    return bind(_own_scale(arr, head, eps), lambda s: F.transform(arr, lambda v: zero_missing((v - s["centre"]) / s["scale"])))


def self_scaled_last(arr: Column, head: int = 5, eps: float = 1e-8) -> Column:
    """The last element of self_scaled, without scaling the others."""
    return bind(_own_scale(arr, head, eps), lambda s: zero_missing((F.element_at(arr, -1) - s["centre"]) / s["scale"]))


def _own_scale(arr: Column, head: int, eps: float) -> Column:
    """centre, scale of a window, each step evaluated once a window."""

    def scale(first, centre):
        mad = median(F.transform(first, lambda v: F.abs(v - centre)))
        return bind(mad, lambda m: F.when(m > eps, m).otherwise(bind(spread(arr), lambda sd: F.when(sd > eps, sd).otherwise(1.0))))

    return bind(F.slice(arr, 1, head), lambda first: bind(median(first), lambda c: F.struct(c.alias("centre"), scale(first, c).alias("scale"))))


def flatten_full(df: DataFrame, features: list[str], length: int) -> DataFrame:
    """Kept windows with c_t0 ... c_t(length-1), time-major."""
    df = df.withColumns({f"{c}_w": steps(c, length) for c in features}).filter("kept")
    return df.select(*KEY, "vendor", F.col("ds").alias("end_ds"), F.col("label").alias("y"), *[F.get(f"{c}_w", F.lit(t)).alias(f"{c}_t{t}") for t in range(length) for c in features])


def flatten_last(df: DataFrame, features: list[str]) -> DataFrame:
    """Kept windows with the value of each feature at their end."""
    return df.filter("kept").select(*KEY, "vendor", F.col("ds").alias("end_ds"), F.col("label").alias("y"), *[F.col(c).alias(f"{c}_last") for c in features])


def flatten_stats(df: DataFrame, features: list[str], length: int) -> DataFrame:
    """Kept windows with mean, std (population), min, max, last and delta of each feature."""
    frame, out = _drive().rowsBetween(-(length - 1), 0), {}
    for c in features:
        out |= {f"{c}_mean": F.avg(c).over(frame), f"{c}_std": F.stddev_pop(c).over(frame), f"{c}_min": F.min(c).over(frame), f"{c}_max": F.max(c).over(frame), f"{c}_last": F.col(c), f"{c}_delta": F.col(c) - F.first(c).over(frame)}
    df = df.withColumns(out).filter("kept")
    return df.select(*KEY, "vendor", F.col("ds").alias("end_ds"), F.col("label").alias("y"), *out)


def flatten_self_scaled(df: DataFrame, features: list[str], length: int, how: str = "stats") -> DataFrame:
    """Kept windows scaled by their own first steps, then flattened ("stats", "full" or "last") inside the window."""
    df = df.withColumns({f"{c}_w": steps(c, length) for c in features}).filter("kept")
    df = df.withColumns({f"{c}_w": self_scaled(F.col(f"{c}_w")) for c in features})
    out = {}
    for c in features:
        w = F.col(f"{c}_w")
        last = F.element_at(w, -1)
        if how == "full":
            out |= {f"{c}_t{t}": F.get(w, F.lit(t)) for t in range(length)}
        elif how == "last":
            out[f"{c}_last"] = last
        else:
            mean = F.aggregate(w, F.lit(0.0), lambda a, v: a + v) / F.size(w)
            out |= {f"{c}_mean": mean, f"{c}_std": spread(w), f"{c}_min": F.array_min(w), f"{c}_max": F.array_max(w), f"{c}_last": last, f"{c}_delta": last - F.get(w, F.lit(0))}
    return df.select(*KEY, "vendor", F.col("ds").alias("end_ds"), F.col("label").alias("y"), *[v.alias(k) for k, v in out.items()])


def flatten_dynamics(df: DataFrame, features: list[str], length: int, last: bool = True) -> DataFrame:
    """Kept windows with slope, delta, rel_delta, std, max_jump, n_changes and, on request, last of each feature."""
    frame, inner = _drive().rowsBetween(-(length - 1), 0), _drive().rowsBetween(-(length - 2), 0)
    df = df.withColumns({f"{c}_step": F.abs(F.col(c) - F.lag(c).over(_drive())) for c in features})
    out = {}
    for c in features:
        first = F.first(c).over(frame)
        delta = F.col(c) - first
        out |= {
            f"{c}_slope": F.regr_slope(F.col(c), F.col("pos").cast("double")).over(frame),
            f"{c}_delta": delta,
            f"{c}_rel_delta": delta / (F.abs(first) + 1),
            f"{c}_std": F.stddev_pop(c).over(frame),
            f"{c}_max_jump": F.max(f"{c}_step").over(inner) if length > 1 else F.lit(0.0),
            f"{c}_n_changes": F.avg((F.col(f"{c}_step") > 1e-9).cast("double")).over(inner) if length > 1 else F.lit(0.0),
        }
        if last:
            out[f"{c}_last"] = F.col(c)
    df = df.withColumns(out).filter("kept")
    return df.select(*KEY, "vendor", F.col("ds").alias("end_ds"), F.col("label").alias("y"), *[zero_missing(F.col(c)).alias(c) for c in out])


def transfer(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: share of test outside train's range, shift of the mean in train SDs, ratio of SDs."""
    one = lambda c, s: F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.avg(c).alias("mu"), F.stddev_pop(c).alias("sd")).alias(f"{s}_{c}")
    fit = train.agg(*[one(c, "fit") for c in features])
    got = test.crossJoin(F.broadcast(fit))
    aggs = [F.struct(F.lit(c).alias("feature"), F.avg(((F.col(c) < F.col(f"fit_{c}.lo")) | (F.col(c) > F.col(f"fit_{c}.hi"))).cast("double")).alias("outside"), F.avg(c).alias("mu"), F.stddev_pop(c).alias("sd"), F.first(f"fit_{c}").alias("fit")) for c in features]
    rows = got.agg(F.array(*aggs).alias("r")).select(F.inline("r"))
    return rows.select("feature", "outside", F.try_divide(F.col("mu") - F.col("fit.mu"), F.col("fit.sd")).alias("shift"), F.try_divide(F.col("sd"), F.col("fit.sd")).alias("sd_ratio"))
