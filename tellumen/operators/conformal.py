"""Conformal prediction and metrics over scored rows (y 0/1, p), as grouped aggregations and threshold joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidate(p: str, label: int) -> Column:
    """1 - P(label); the double subtraction keeps ties as they are."""
    return 1 - F.col(p) if label else 1 - (1 - F.col(p))


def lac(p: str = "p", y: str = "y") -> Column:
    return F.when(F.col(y) == 1, candidate(p, 1)).otherwise(candidate(p, 0))


def thresholds(cal: DataFrame, alpha: float, cells: list[str]) -> DataFrame:
    """cells, n, qhat: the ceil((n + 1)(1 - alpha))-th smallest finite score, infinite if there are too few. A
    histogram of distinct scores with a running sum: partitioned by cell and score, never one sort of all rows. An
    alpha outside (0, 1) is an error, and so is, when the plan runs, a pooled threshold without any score."""
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie in (0, 1), not {alpha}")
    by = cal.withColumn("s", lac()).filter("s IS NOT NULL AND NOT isnan(s) AND abs(s) < double('Infinity')")
    hist = by.groupBy(*cells, "s").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*cells) if cells else Window.partitionBy(F.lit(0))
    hist = hist.withColumn("cum", F.sum("c").over(w.orderBy("s"))).withColumn("n", F.sum("c").over(w))
    k = F.ceil((F.col("n") + 1) * F.lit(1 - alpha))
    out = hist.groupBy(*cells).agg(F.max("n").alias("n"), F.min(F.when(F.col("cum") >= k, F.col("s"))).alias("q"))
    out = out.withColumn("n", F.coalesce("n", F.raise_error(F.lit("no calibration scores")).cast("long")))
    return out.withColumn("qhat", F.coalesce("q", F.lit(float("inf")))).drop("q")


#: Columns that a method's calibration cells consist of; y stands for the candidate label.
METHODS = {"split": [], "class": ["y"], "group": ["stage"], "both": ["stage", "y"]}


def cells_of(by: str, group: str = "stage") -> list[str]:
    if by not in METHODS:
        raise ValueError(f"by must be one of {', '.join(METHODS)}, not {by}")
    return [group if c == "stage" else c for c in METHODS[by]]


def predict(test: DataFrame, cal: DataFrame, alpha: float, by: str = "split", group: str = "stage", nonempty: bool = False, fallback: str = "pooled") -> DataFrame:
    """test with set_h, set_f, fallback. by: split, class, group or both. A label whose cell has no calibration rows
    flags the row; its threshold is infinite for by="class" and fallback="inf", else the pooled one."""
    if fallback not in ("pooled", "inf"):
        raise ValueError(f"fallback must be pooled or inf, not {fallback}")
    cells = cells_of(by, group)
    pooled = thresholds(cal, alpha, []).select(F.col("qhat").alias("q_all"))
    df = test.crossJoin(F.broadcast(pooled))
    if by == "split":
        df = df.withColumns({"q_h": F.col("q_all"), "q_f": F.col("q_all"), "fallback": F.lit(False)})
    else:
        t = F.broadcast(thresholds(cal, alpha, cells).drop("n"))
        keys = [c for c in cells if c != "y"]
        for label, name in ((0, "q_h"), (1, "q_f")):
            side = t.filter(F.col("y") == label).drop("y") if "y" in cells else t
            side = side.withColumnRenamed("qhat", name)
            df = df.join(side, keys, "left") if keys else df.crossJoin(F.broadcast(side.agg(F.max(name).alias(name))))
        spare = F.lit(float("inf")) if by == "class" or fallback == "inf" else F.col("q_all")
        df = df.withColumn("fallback", F.col("q_h").isNull() | F.col("q_f").isNull()).withColumns({k: F.coalesce(F.col(k), spare) for k in ("q_h", "q_f")})
    h, f = candidate("p", 0) <= F.col("q_h"), candidate("p", 1) <= F.col("q_f")
    df = df.withColumns({"set_h": h, "set_f": f})
    if nonempty:
        empty = ~F.col("set_h") & ~F.col("set_f")
        low = candidate("p", 0) <= candidate("p", 1)
        df = df.withColumns({"set_h": F.col("set_h") | (empty & low), "set_f": F.col("set_f") | (empty & ~low)})
    return df.drop("q_all", "q_h", "q_f")


def properties(sets: DataFrame) -> DataFrame:
    """sets with set_size, singleton, doubleton, empty and labels (the set's labels, ascending)."""
    h, f = F.col("set_h"), F.col("set_f")
    labels = F.filter(F.array(F.when(h, 0), F.when(f, 1)), lambda x: x.isNotNull())
    df = sets.withColumns({"set_size": h.cast("int") + f.cast("int"), "labels": labels})
    return df.withColumns({name: F.col("set_size") == k for k, name in enumerate(("empty", "singleton", "doubleton"))})


def report(sets: DataFrame, cal: DataFrame, alpha: float, by: str = "split", group: str = "stage") -> DataFrame:
    """One row on predicted sets: levels, coverage by class, set sizes, the representative threshold (the median of
    the finite ones), counts, score, method and the share of rows that fell back. Rates are not rounded."""
    y, rate = F.col("y"), lambda c: F.avg(c.cast("double"))
    hit = F.when(y == 1, F.col("set_f")).otherwise(F.col("set_h"))
    out = properties(sets).agg(
        rate(hit).alias("empirical_coverage"),
        rate(F.when(y == 0, hit)).alias("coverage_healthy"),
        rate(F.when(y == 1, hit)).alias("coverage_failure"),
        F.avg("set_size").alias("avg_set_size"),
        *[rate(F.col(k)).alias(f"{k}_rate") for k in ("singleton", "doubleton", "empty", "fallback")],
        F.count(F.lit(1)).alias("n_test"),
        F.count_if(y == 1).alias("n_failures_test"),
    )
    q = thresholds(cal, alpha, cells_of(by, group))
    finite = F.when(F.col("qhat") < float("inf"), F.col("qhat"))
    q = q.agg(F.coalesce(F.percentile(finite, F.lit(0.5)), F.lit(float("inf"))).alias("qhat"), F.sum("n").alias("n_cal"))
    name = {"split": "split", "group": f"mondrian_{group}"}.get(by, f"mondrian_{by}")
    return out.crossJoin(F.broadcast(q)).withColumns({"alpha": F.lit(alpha), "target_coverage": F.lit(1 - alpha), "score_fn": F.lit("lac"), "method": F.lit(name)})


def check_sets(stored: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """One row (n, differing) on two results of one prediction; rows of one side alone differ."""
    side = lambda df, x: df.select(*keys, F.col("set_h").alias(f"h{x}"), F.col("set_f").alias(f"f{x}"))
    both = side(stored, 0).join(side(again, 1), keys, "full")
    same = F.col("h0").eqNullSafe(F.col("h1")) & F.col("f0").eqNullSafe(F.col("f1"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("differing"))


def assert_same_sets(stored: DataFrame, again: DataFrame, keys: list[str]) -> None:
    bad = check_sets(stored, again, keys).first().differing
    if bad:
        raise AssertionError(f"{bad} sets differ")


def coverage(df: DataFrame, groups: list[str]) -> DataFrame:
    hit = F.when(F.col("y") == 1, F.col("set_f")).otherwise(F.col("set_h")).cast("int")
    size = F.col("set_h").cast("int") + F.col("set_f").cast("int")
    share = lambda c: F.round(F.avg(c), 6)
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        share(hit).alias("coverage"),
        share(F.when(F.col("y") == 0, hit)).alias("coverage_healthy"),
        share(F.when(F.col("y") == 1, hit)).alias("coverage_failure"),
        share(size).alias("mean_size"),
        share((size == 0).cast("int")).alias("empty_rate"),
        share((size == 2).cast("int")).alias("doubleton_rate"),
        share(F.col("fallback").cast("int")).alias("fallback_rate"),
    )


def auc(df: DataFrame, groups: list[str]) -> DataFrame:
    """Area under the ROC curve with half credit for ties, from the histogram of scores."""
    hist = df.groupBy(*groups, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    w = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    pairs = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return hist.groupBy(*groups).agg(F.round(F.try_divide(pairs, F.sum("pos") * F.sum("neg").cast("double")), 6).alias("auc"))


def confusion(df: DataFrame, threshold: float, groups: list[str], beta: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, F-beta with p >= threshold as alert."""
    alert, bad = F.col("p") >= threshold, F.col("y") == 1
    c = df.groupBy(*groups).agg(F.count_if(alert & bad).alias("tp"), F.count_if(alert & ~bad).alias("fp"), F.count_if(~alert & bad).alias("fn"), F.count_if(~alert & ~bad).alias("tn"))
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    c = c.withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0))})
    f = F.try_divide((1 + beta**2) * F.col("precision") * F.col("recall"), beta**2 * F.col("precision") + F.col("recall"))
    c = c.withColumn("f_beta", F.round(F.coalesce(f, F.lit(0.0)), 6))
    return c.withColumns({k: F.round(k, 6) for k in ("precision", "recall")})


def fleet_metrics(df: DataFrame, threshold: float, beta: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """One row: threshold, tp, fp, fn, tn, precision, recall, f_beta, f1, auc, avg_precision, prevalence. keys order
    rows of equal p."""
    from tellumen.operators.weighted import average_precision

    c = confusion(df, threshold, [], beta).withColumn("threshold", F.lit(float(threshold)))
    f1 = F.try_divide(2 * F.col("tp").cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    c = c.withColumn("f1", F.round(F.coalesce(f1, F.lit(0.0)), 6))
    c = c.crossJoin(auc(df, [])).crossJoin(df.agg(F.round(F.avg("y"), 6).alias("prevalence")))
    return c.crossJoin(average_precision(df, keys or []).withColumnRenamed("ap", "avg_precision"))


def operating_points(sets: DataFrame, threshold: float, groups: list[str]) -> DataFrame:
    """Per group what a threshold on p does for those who act on alerts, and the failure coverage of the sets."""
    alert, bad = F.col("p") >= threshold, F.col("y") == 1
    work = sets.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_distinct("drive").alias("n_drives"),
        F.round(F.avg("y"), 5).alias("prevalence"),
        F.round(1000.0 * F.count_distinct(F.when(alert, F.col("drive"))) / F.count_distinct("drive"), 1).alias("alerts_per_1k_drives"),
        F.round(F.avg(F.when(bad, F.col("set_f").cast("double"))), 4).alias("conformal_cov_failure"),
    )
    c = confusion(sets, threshold, groups)
    four = [F.round(k, 4).alias(k) for k in ("precision", "recall", "f_beta")]
    return work.join(c.select(*groups, *four), groups)


def drive_level(df: DataFrame) -> DataFrame:
    return df.groupBy("drive").agg(F.max("p").alias("p"), F.max("y").alias("y"))


def calibration(df: DataFrame, groups: list[str]) -> DataFrame:
    q = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = -(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))
    return df.groupBy(*groups).agg(F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 6).alias("brier"), F.round(F.avg(loss), 6).alias("log_loss"), F.round(F.avg("p"), 6).alias("mean_pred"), F.round(F.avg("y"), 6).alias("obs_rate"))


def cluster_se(df: DataFrame, value: Column, groups: list[str]) -> DataFrame:
    """Mean of per-drive means and its standard error over drives."""
    d = df.groupBy(*groups, "drive").agg(F.avg(value).alias("m"))
    return d.groupBy(*groups).agg(F.count(F.lit(1)).alias("drives"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m") / F.sqrt(F.count(F.lit(1))), 6).alias("se"))


def composition(df: DataFrame, groups: list[str]) -> DataFrame:
    """Per cent of sets with one label, both or none."""
    h, f = F.col("set_h"), F.col("set_f")
    share = lambda c, name: F.round(100 * F.avg(c.cast("int")), 4).alias(name)
    return df.groupBy(*groups).agg(share(h & ~f, "only_healthy"), share(f & ~h, "only_failing"), share(h & f, "both_labels"), share(~h & ~f, "no_label"))
