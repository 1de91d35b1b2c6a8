"""Weighted scores: precision and AUC, thresholds, reliability, weighted conformal sets, clustered bootstraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellumen.functions.scalars import searchsorted, uniform
from tellumen.operators.conformal import candidate, lac
from tellumen.operators.stages import equal_mass, numbered


def _w(*by: str):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def weighted_auc(df: DataFrame, weight: str, groups: list[str]) -> DataFrame:
    """AUC of weighted rows, half credit for ties, from the histogram of scores."""
    hist = df.groupBy(*groups, "p").agg(F.sum(F.when(F.col("y") == 1, F.col(weight)).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col(weight)).otherwise(0.0)).alias("neg"))
    hist = hist.withColumn("below", F.sum("neg").over(_w(*groups).orderBy("p")) - F.col("neg"))
    return hist.groupBy(*groups).agg(F.round(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def average_precision(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row-wise average precision; ties in p are ordered by keys. Positives are numbered among themselves too."""
    n = numbered(df.withColumn("_p", -F.col("p")), "_p", keys)
    hits = numbered(n.filter("y = 1").withColumnRenamed("_k", "_at").drop("_n"), "_p", keys)
    return hits.agg(F.round(F.avg(F.col("_k") / F.col("_at")), 6).alias("ap"))


def pick_threshold(df: DataFrame, beta: float = 0.5, grid: int = 200) -> DataFrame:
    """threshold, f_beta: the first best of `grid` even steps from the least to the greatest score. Rows are counted
    by step and summed from the top, so the grid meets `grid` rows, not the data."""
    ends = df.agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    steps = ends.select(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda k: F.col("lo") + k * (F.col("hi") - F.col("lo")) / (grid - 1)).alias("g"))
    n = df.crossJoin(F.broadcast(steps)).groupBy(searchsorted(F.col("g"), F.col("p"), bits=grid.bit_length()).alias("k")).agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    spine = steps.select(F.posexplode("g").alias("k", "threshold")).withColumn("k", F.col("k") + 1)
    up = Window.partitionBy(F.lit(0)).orderBy(F.col("k").desc())
    c = spine.join(F.broadcast(n), "k", "left").withColumns({"tp": F.coalesce(F.sum("pos").over(up), F.lit(0)), "flagged": F.coalesce(F.sum("n").over(up), F.lit(0))})
    c = c.withColumn("all_pos", F.max("tp").over(Window.partitionBy(F.lit(0))))
    b = beta * beta
    f = F.coalesce(F.try_divide((1 + b) * F.col("tp"), b * F.col("all_pos") + F.col("flagged")), F.lit(0.0))
    best = c.agg(F.max_by(F.struct("threshold", f.alias("f")), F.struct(f, -F.col("k"))).alias("x"))
    return best.select(F.round("x.threshold", 6).alias("threshold"), F.round("x.f", 6).alias("f_beta"))


def reliability(df: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """bin, n, mean_p, rate over equal-mass bins of p."""
    return equal_mass(df, "p", keys, bins).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))


def calibration_error(df: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    r = reliability(df, keys, bins)
    return r.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n"), 6).alias("ece"))


def aps_true(u: Column, p: str = "p", y: str = "y") -> Column:
    """Cumulative mass, most likely label first (0.5: healthy first), down to y, less u times y's own mass."""
    return F.when(F.col(y) == 1, aps_candidate(u, 1, p)).otherwise(aps_candidate(u, 0, p))


def aps_candidate(u: Column, label: int, p: str = "p") -> Column:
    own = F.col(p) if label else 1 - F.col(p)
    first = F.col(p) > 0.5 if label else F.col(p) <= 0.5
    return F.when(first, own).otherwise(F.lit(1.0)) - u * own


def density_ratio(df: DataFrame, p: str = "p", part: str = "part", lo: float = 0.05, hi: float = 20.0) -> DataFrame:
    """df with w: a domain classifier's odds of test over calibration, for their sizes, clipped."""
    n = F.broadcast(df.agg(F.count_if(F.col(part) == "cal").alias("_c"), F.count_if(F.col(part) == "test").alias("_t")))
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    w = q / (1 - q) * F.try_divide(F.col("_c").cast("double"), F.col("_t"))
    return df.crossJoin(n).withColumn("w", F.least(F.greatest(w, F.lit(lo)), F.lit(hi))).drop("_c", "_t")


def fit_density_ratio(cal: DataFrame, test: DataFrame, columns: list[str], lo: float = 0.05, hi: float = 20.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cal and test with w, from a logistic domain classifier on columns, and one row on the weights of both: the
    report of ratio_report and domain_auc."""
    from tellumen.operators.conformal import auc
    from tellumen.operators.models import Classifier

    both = cal.withColumn("_part", F.lit("cal")).unionByName(test.withColumn("_part", F.lit("test")))
    domain = both.select("_part", *columns).withColumn("y", (F.col("_part") == "test").cast("int"))
    model = Classifier(columns, "logistic", weighted=False).fit(domain)
    scored = density_ratio(model.score(both.withColumnsRenamed({c: f"_own_{c}" for c in ("p", "w") if c in both.columns})), part="_part", lo=lo, hi=hi)
    info = ratio_report(scored, lo, hi).crossJoin(auc(model.score(domain), []).withColumnRenamed("auc", "domain_auc"))
    out = scored.drop("p").withColumnsRenamed({"_own_p": "p"}).drop("_own_w")
    return out.filter("_part = 'cal'").drop("_part"), out.filter("_part = 'test'").drop("_part"), info


def ratio_report(df: DataFrame, lo: float = 0.05, hi: float = 20.0) -> DataFrame:
    """n, mean weight, share at a clip bound, effective sample size."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("w"), 6).alias("mean_w"), F.round(F.avg(((F.col("w") <= lo) | (F.col("w") >= hi)).cast("double")), 6).alias("clipped"), F.round(F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w")), 3).alias("ess"))


def weighted_sets(test: DataFrame, cal: DataFrame, alpha: float, weight: str = "w") -> DataFrame:
    """test with qhat, set_h, set_f: per row the first calibration score whose cumulative weight reaches
    (1 - alpha)(W + w). Only scores between the targets of the least and the greatest test weight can be an answer;
    with weights in [lo, hi] those are at most (hi - lo) / lo + 2, so that slice is broadcast and searched."""
    hist = cal.withColumn("s", lac()).filter("s IS NOT NULL AND NOT isnan(s)").groupBy("s").agg(F.sum(weight).alias("c"))
    hist = hist.withColumns({"cum": F.sum("c").over(_w().orderBy("s")), "total": F.sum("c").over(_w())})
    ends = F.broadcast(test.agg(F.min(weight).alias("lo"), F.max(weight).alias("hi")))
    level = F.lit(1 - alpha)
    near = hist.crossJoin(ends).filter((F.col("cum") >= level * (F.col("total") + F.col("lo"))) & (F.col("cum") - F.col("c") < level * (F.col("total") + F.col("hi"))))
    cut = near.agg(F.array_sort(F.collect_list(F.struct("cum", "s"))).alias("_near"))
    total = cal.withColumn("s", lac()).filter("s IS NOT NULL AND NOT isnan(s)").agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("_total"))
    df = test.crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(total))
    k = searchsorted(F.col("_near.cum"), level * (F.col("_total") + F.col(weight)), right=False, bits=20)
    df = df.withColumn("qhat", F.coalesce(F.get("_near.s", k), F.lit(float("inf")))).drop("_near", "_total")
    return df.withColumns({"set_h": candidate("p", 0) <= F.col("qhat"), "set_f": candidate("p", 1) <= F.col("qhat")})


def multiplicities(drives: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """draw, drive, m: a bootstrap over drives; slot k of draw b takes drive floor(n u(seed, b, k)). Drives are
    numbered by id; size draws x drives."""
    ids = drives.select("drive").distinct()
    n = F.broadcast(ids.agg(F.count(F.lit(1)).alias("n")))
    codes = numbered(ids, "drive", []).select("drive", (F.col("_k") - 1).alias("code"))
    slots = codes.select("code").crossJoin(n).select("code", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    taken = slots.select("draw", F.floor(uniform(seed, "draw", "code") * F.col("n")).alias("code"))
    return taken.groupBy("draw", "code").agg(F.count(F.lit(1)).alias("m")).join(codes, "code").drop("code")


def interval(draws: DataFrame, value: str) -> DataFrame:
    """lo, hi (2.5 and 97.5 %), se (ddof 1), n_nan of bootstrap draws."""
    ok = F.when(~F.isnan(value), F.col(value))
    q = draws.agg(F.percentile(ok, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.stddev_samp(ok).alias("se"), F.count_if(ok.isNull()).alias("n_nan"))
    return q.select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "se", "n_nan")


def drive_correlation(df: DataFrame, x: str, y: str, draws: int, seed: int = 42) -> DataFrame:
    """draw, r: Pearson's r of resampled drives, from six sums a drive."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.groupBy("drive").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("x"), F.sum(b).alias("y"), F.sum(a * a).alias("xx"), F.sum(b * b).alias("yy"), F.sum(a * b).alias("xy"))
    t = sums.join(multiplicities(df, draws, seed), "drive").groupBy("draw").agg(*[F.sum(F.col(c) * F.col("m")).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    cov = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    var = (F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y"))
    return t.select("draw", F.try_divide(cov, F.sqrt(var)).alias("r"))
