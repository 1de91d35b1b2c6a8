"""Feature rankers over a long table (feature, x, y), their consensus and the choice of a prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellumen.functions.scalars import searchsorted
from tellumen.operators.conformal import auc
from tellumen.operators.stages import average_rank

EPS = 1e-12


def long_features(df: DataFrame, array: str, y: str) -> DataFrame:
    """feature (position), x, y of an array column; null and NaN components go."""
    rows = df.select(F.col(y).alias("y"), F.posexplode(array).alias("feature", "x")).withColumn("x", F.col("x").cast("double"))
    return rows.filter("x IS NOT NULL AND NOT isnan(x)")


def moment_scores(long: DataFrame) -> DataFrame:
    """feature, variance (population SD), correlation (absolute), mean_gap and fisher from one aggregation."""
    one = lambda k, f: f(F.when(F.col("y") == k, F.col("x")))
    y = F.col("y").cast("double")
    m = long.groupBy("feature").agg(
        F.stddev_pop("x").alias("variance"),
        F.covar_pop("x", y).alias("cov"), F.stddev_pop(y).alias("sdy"),
        one(0, F.avg).alias("m0"), one(1, F.avg).alias("m1"), one(0, F.var_pop).alias("v0"), one(1, F.var_pop).alias("v1"),
    )
    gap = F.abs(F.col("m1") - F.col("m0"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return m.select("feature", "variance", F.abs(F.col("cov") / (F.col("variance") * F.col("sdy") + EPS)).alias("correlation"), zero(gap / (F.sqrt((F.col("v0") + F.col("v1")) / 2) + EPS)).alias("mean_gap"), zero(gap * gap / (F.col("v0") + F.col("v1") + EPS)).alias("fisher"))


def auc_scores(long: DataFrame) -> DataFrame:
    a = auc(long.withColumnRenamed("x", "p"), ["feature"])
    return a.select("feature", F.abs(F.coalesce("auc", F.lit(0.5)) - 0.5).alias("auc"))


def information_scores(long: DataFrame, bins: int = 10) -> DataFrame:
    """Mutual information of the feature's quantile bin and y, over the entropy of y, in nats. Joint counts are one
    aggregation; the cut-points are a row per feature."""
    cuts = long.groupBy("feature").agg(F.array_sort(F.array_distinct(F.percentile("x", F.array(*[F.lit(k / bins) for k in range(1, bins)])))).alias("cuts"))
    n = long.join(F.broadcast(cuts), "feature").groupBy("feature", searchsorted(F.col("cuts"), F.col("x"), bits=bins.bit_length()).alias("bin"), "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    n = n.withColumns({"t": total(), "nb": total("bin"), "ny": total("y")})
    by_y = n.groupBy("feature", "y").agg(F.max("ny").alias("ny"), F.max("t").alias("t"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("mi"))
    share = F.col("ny") / F.col("t")
    return by_y.groupBy("feature").agg((F.sum("mi") / (F.sum(-share * F.log(share)) + EPS)).alias("information"))


def scores(long: DataFrame) -> DataFrame:
    """feature, ranker, score of the five rankers; scores equal to 12 places are ties, whatever the order of their sums."""
    wide = moment_scores(long).drop("fisher").join(auc_scores(long), "feature").join(information_scores(long), "feature")
    return wide.unpivot("feature", ["variance", "correlation", "mean_gap", "auc", "information"], "ranker", "score").withColumn("score", F.round("score", 12))


def to_ranks(s: DataFrame) -> DataFrame:
    """feature, ranker, r: descending average-tie ranks."""
    return s.select("feature", "ranker", average_rank(F.col("score").desc(), ["ranker"], ["score"]).alias("r"))


def kendall(ranks: DataFrame) -> DataFrame:
    """a, b, tau of every pair of rankers; a pair of features tied in both counts among a's ties alone. The pairs of
    features come from a join on the ranker: features squared, independent of the rows."""
    l, r = ranks.alias("l"), ranks.alias("r")
    signs = l.join(r, (F.col("l.ranker") == F.col("r.ranker")) & (F.col("l.feature") < F.col("r.feature"))).select(F.col("l.ranker").alias("ranker"), F.col("l.feature").alias("f"), F.col("r.feature").alias("g"), F.signum(F.col("l.r") - F.col("r.r")).alias("s"))
    a, b = signs.alias("a"), signs.alias("b")
    both = a.join(b, (F.col("a.f") == F.col("b.f")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.ranker") < F.col("b.ranker")))
    prod = F.col("a.s") * F.col("b.s")
    t = both.groupBy(F.col("a.ranker").alias("a"), F.col("b.ranker").alias("b")).agg(F.count_if(prod > 0).alias("c"), F.count_if(prod < 0).alias("d"), F.count_if(F.col("a.s") == 0).alias("ta"), F.count_if((F.col("b.s") == 0) & (F.col("a.s") != 0)).alias("tb"))
    n = (F.col("c") + F.col("d")).cast("double")
    return t.select("a", "b", F.coalesce(F.try_divide(F.col("c") - F.col("d"), F.sqrt((n + F.col("ta")) * (n + F.col("tb")))), F.lit(0.0)).alias("tau"))


def kept_rankers(tau: DataFrame, z: float = 2.0) -> DataFrame:
    """ranker, agreement, kept: rankers whose mean tau is not below the mean by z SDs; at least max(2, n // 2) stay,
    and all of fewer than three."""
    both = tau.select("a", "tau").unionByName(tau.select(F.col("b").alias("a"), "tau"))
    m = both.groupBy(F.col("a").alias("ranker")).agg(F.avg("tau").alias("agreement"))
    all_ = Window.partitionBy(F.lit(0))
    m = m.withColumns({"mu": F.avg("agreement").over(all_), "sd": F.stddev_pop("agreement").over(all_), "n": F.count(F.lit(1)).over(all_), "k": F.row_number().over(all_.orderBy(F.col("agreement").desc(), "ranker"))})
    keep = (F.col("agreement") >= F.col("mu") - z * F.col("sd")) | (F.col("n") < 3) | (F.col("k") <= F.greatest(F.lit(2), F.floor(F.col("n") / 2)))
    return m.select("ranker", "agreement", keep.alias("kept"))


def consensus(ranks: DataFrame) -> DataFrame:
    """feature, mean_rank, place: 1 is best; ties go to the smaller feature."""
    m = ranks.groupBy("feature").agg(F.avg("r").alias("mean_rank"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("mean_rank", "feature")))


def choose(order: DataFrame, fisher: DataFrame, tol: float = 0.02, least: int = 1, most: int | None = None) -> DataFrame:
    """The shortest prefix whose summed separability is within tol of the whole, at least `least`, at most `most`."""
    w = Window.partitionBy(F.lit(0))
    df = order.join(fisher.select("feature", "fisher"), "feature")
    df = df.withColumn("run", F.sum("fisher").over(w.orderBy("place"))).withColumn("best", F.max("run").over(w))
    df = df.withColumn("k", F.greatest(F.min(F.when(F.col("run") >= (1 - tol) * F.col("best"), F.col("place"))).over(w), F.lit(least)))
    df = df.filter(F.col("place") <= (F.col("k") if most is None else F.least("k", F.lit(most))))
    return df.select("feature", "place", "mean_rank", "run")


def select_features(long: DataFrame, z: float = 2.0, tol: float = 0.02, least: int = 1, most: int | None = None) -> DataFrame:
    """Scores, outlying rankers out, consensus, prefix. One class only is an error."""
    if long.select("y").distinct().limit(2).count() < 2:
        raise ValueError("feature selection needs two classes")
    s = scores(long)
    kept = kept_rankers(kendall(to_ranks(s)), z).filter("kept").select("ranker")
    return choose(consensus(to_ranks(s).join(F.broadcast(kept), "ranker", "left_semi")), moment_scores(long), tol, least, most)


def base_features(selected: DataFrame, names: list[str]) -> DataFrame:
    """Base features that some selected derived name begins with."""
    base = selected.sparkSession.createDataFrame([(n,) for n in names], "base string")
    return F.broadcast(base).join(selected, F.col("feature").startswith(F.concat("base", F.lit("_"))), "left_semi")
