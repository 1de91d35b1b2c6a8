"""Experiments: one fold prepared, fitted, scored, calibrated and audited; grids that resume where they stopped."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellumen.operators import conformal as cp
from tellumen.operators import panel as pn
from tellumen.operators import ranking as fs
from tellumen.operators import scaling as ts
from tellumen.operators import splits as sp
from tellumen.operators import weighted as wt
from tellumen.operators.labels import in_horizon
from tellumen.operators.models import MODEL_INPUT, Classifier
from tellumen.operators.sequence import SequenceModel
from tellumen.operators.weighted import pick_threshold
from tellumen.session import materialised
from tellumen.sources.fleet import KEY

STATS = ("mean", "std", "min", "max", "last", "delta", "slope")


def prepare_folds(labelled: DataFrame, drives: DataFrame, features: list[str], length: int, column: str = "vendor", strata: tuple[str, ...] = ("model", "drive_label")) -> DataFrame:
    """Flat windows of every fold with `fold` and `part`; windows are built once and joined with all folds."""
    win = pn.windows(pn.densify(labelled, features), features, length)
    return win.join(sp.held_out_splits(drives, column, list(strata)).select(*KEY, "fold", "part"), KEY)


@dataclass
class Fold:
    """One fold, windowed, normalised and flattened: `windows` has part, y and `columns`."""

    name: str
    windows: DataFrame
    features: list[str]
    columns: list[str]
    normalize: str
    how: str
    dropped: list[str] = field(default_factory=list)
    held_out: str = ""

    def part(self, name: str) -> DataFrame:
        return self.windows.filter(F.col("part") == name)


def normalised(cells: DataFrame, features: list[str], method: str) -> DataFrame:
    """Days of ts.cells with part, each feature scaled by what the train part says; "none" and "per_drive" (which
    scales inside the window) leave them as they are."""
    train = cells.filter("part = 'train'")
    if method == "zscore":
        return ts.zscore(cells, ts.fit_zscore(train, features), features)
    if method == "rank":
        return ts.rank(cells, *ts.fit_rank(train, features, "vendor"), features, "vendor")
    if method not in ("none", "per_drive"):
        raise ValueError(f"normalize must be none, zscore, rank or per_drive, not {method}")
    return cells


def flattened(cells: DataFrame, features: list[str], length: int, how: str, per_drive: bool = False) -> DataFrame:
    if per_drive:
        return ts.flatten_self_scaled(cells, features, length, how)
    if how == "last":
        return ts.flatten_last(cells, features)
    if how == "full":
        return ts.flatten_full(cells, features, length)
    if how == "stats":
        return ts.flatten_stats(cells, features, length)
    if how in ("dynamics", "dynamics_only"):
        return ts.flatten_dynamics(cells, features, length, last=how == "dynamics")
    raise ValueError(f"no flattening {how}")


def failed_without_positive(windows: DataFrame, drives: DataFrame) -> DataFrame:
    """Failed drives of a split that have no positive window."""
    return drives.filter("drive_label = 1").select(*KEY, "part").join(windows.filter("y = 1").select(*KEY).distinct(), KEY, "left_anti")


def prepare_fold(labelled: DataFrame, split: DataFrame, features: list[str], length: int, name: str = "standard", normalize: str = "zscore", how: str = "stats", stride: int = 1, positive_stride: int | None = None, drop_constant: bool = False, select: bool = False, most: int | None = None, held_out: str | None = None) -> Fold:
    """Windows of one fold's drives (split: key, part): statistics and selected features come from train alone,
    constant features of test go on request (never all of them). Empty train or cal, or a held-out vendor in them,
    are errors."""
    cells = ts.cells(pn.densify(labelled, features), length, stride, positive_stride).join(split.select(*KEY, "part"), KEY)
    size = {r.part: r for r in cells.filter("kept").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.collect_set("vendor").alias("vendors")).collect()}
    if "train" not in size or "cal" not in size:
        raise ValueError(f"{name}: empty train or cal after windowing")
    if held_out and any(held_out in size[p].vendors for p in ("train", "cal")):
        raise AssertionError(f"{name}: held-out vendor {held_out} in train or cal")
    cells = normalised(cells, features, normalize)
    dropped = []
    if drop_constant:
        dead = [r.feature for r in ts.constant_features(ts.fit_zscore(cells.filter("part = 'test'"), features), features).collect()]
        dropped = dead if len(dead) < len(features) else []
        features = [c for c in features if c not in dropped]
    flat = flattened(cells, features, length, how, normalize == "per_drive").join(split.select(*KEY, "part"), KEY)
    columns = [c for c in flat.columns if c not in (*KEY, "vendor", "end_ds", "y", "part")]
    if select:
        train = flat.filter("part = 'train'")
        long = fs.long_features(train.select("y", F.array(*columns).alias("x")), "x", "y")
        if long.select("y").distinct().limit(2).count() == 2:
            chosen = [columns[r.feature] for r in fs.select_features(long, most=most).collect()]
            kept = [c for c in features if any(s.startswith(f"{c}_") for s in chosen)]
            features = kept or features
            columns = [c for c in columns if any(c.startswith(f"{f}_") for f in features)]
    # Every cell goes over the windows many times; they are built once.
    return Fold(name, materialised(flat.select(*KEY, "vendor", "end_ds", "y", "part", *columns), "fold"), features, columns, normalize, how, dropped, held_out or "")


def run_cell(fold: Fold, model: str = "random_forest", alpha: float = 0.1, method: str = "split", group: str = "vendor", beta: float = 0.5, **options) -> DataFrame:
    """One row: the coverage report, window and drive metrics at a threshold chosen on train scores, and what was run.
    method: one of conformal.METHODS or "weighted" (a domain classifier's ratios)."""
    if MODEL_INPUT.get(model) == "seq" and fold.how != "full":
        raise ValueError(f"{model} reads whole windows: prepare the fold with how='full'")
    started = time.monotonic()
    learner = SequenceModel(fold.columns, len(fold.features), **options) if MODEL_INPUT.get(model) == "seq" else Classifier(fold.columns, model, **options)
    fitted = learner.fit(fold.part("train"))
    took = time.monotonic() - started
    score = lambda p: fitted.score(fold.part(p)).withColumn("drive", F.concat_ws(":", *KEY))
    train, cal, test = (materialised(score(p).drop(*fold.columns) if method != "weighted" else score(p), "scores") for p in ("train", "cal", "test"))
    if method == "weighted":
        wcal, wtest, info = wt.fit_density_ratio(cal, test, fold.columns)
        sets = wt.weighted_sets(wtest, wcal, alpha).withColumn("fallback", F.lit(False))
        row = cp.report(sets, cal, alpha).withColumn("method", F.lit("weighted")).crossJoin(info.select("ess", "domain_auc"))
        row = row.crossJoin(sets.agg(F.percentile(F.when(F.col("qhat") < float("inf"), F.col("qhat")), F.lit(0.5)).alias("_q"))).withColumn("qhat", F.coalesce("_q", F.lit(float("inf")))).drop("_q")
    else:
        row = cp.report(cp.predict(test, cal, alpha, method, group), cal, alpha, method, group).withColumns({"ess": F.lit(None).cast("double"), "domain_auc": F.lit(None).cast("double")})
    threshold = pick_threshold(train, beta).first().threshold
    for prefix, df in (("win", test), ("drv", cp.drive_level(test))):
        m = cp.fleet_metrics(df, threshold, beta, ["drive"])
        row = row.crossJoin(m.toDF(*[f"{prefix}_{c}" for c in m.columns]))
    sizes = fold.windows.agg(*[F.count_if(F.col("part") == p).alias(f"n_{p}_windows") for p in ("train", "cal", "test")], F.count_distinct(F.when(F.col("part") == "test", F.struct(*KEY))).alias("n_test_drives"))
    meta = {"split": fold.name, "held_out": fold.held_out, "model": model, "conformal": method, "features": ",".join(fold.features), "n_features": len(fold.features), "normalize": fold.normalize, "flatten": fold.how, "n_dropped_constant": len(fold.dropped), "dropped_constant": ",".join(fold.dropped), "fit_seconds": round(took, 2)}
    return row.crossJoin(sizes).withColumns({k: F.lit(v) for k, v in meta.items()})


def cell_path(path: str, split: str, model: str, method: str) -> str:
    return f"{path}/{split}__{model}__{method}"


def _done(spark, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run_experiment(labelled: DataFrame, splits: dict[str, DataFrame], features: list[str], length: int, models: list[str], methods: list[str], path: str, held_out: dict[str, str] | None = None, prepare: dict | None = None, **options) -> DataFrame:
    """Every (split, model, method) that path does not hold yet; each cell is a folder, written when it is done, so an
    interrupted run goes on with what is missing. A split with nothing missing is not prepared again."""
    spark = labelled.sparkSession
    for name, split in splits.items():
        missing = [(m, c) for m in models for c in methods if not _done(spark, cell_path(path, name, m, c))]
        if missing:
            fold = prepare_fold(labelled, split, features, length, name, held_out=(held_out or {}).get(name), **(prepare or {}))
            for model, method in missing:
                run_cell(fold, model, method=method, **options).write.mode("overwrite").parquet(cell_path(path, name, model, method))
    cells = [cell_path(path, s, m, c) for s in splits for m in models for c in methods]
    return spark.read.parquet(*cells)


def vendor_splits(drives: DataFrame, vendors: list[str], **options) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The standard split and one leaving each vendor out, by name, and the vendors held out."""
    lomo = sp.held_out_splits(drives, "vendor", ["model", "drive_label"], **options)
    splits = {"standard": sp.standard_split(drives)} | {f"lomo_{v}": lomo.filter(F.col("fold") == v) for v in vendors}
    return splits, {f"lomo_{v}": v for v in vendors}


def representation_sweep(labelled: DataFrame, splits: dict[str, DataFrame], features: list[str], length: int, normalisers: list[str], flattens: list[str], model: str = "random_forest", **options) -> DataFrame:
    """split, normalize, flatten, auc (null with one class in test): one fit for each."""
    out = None
    for name, split in splits.items():
        for n in normalisers:
            for how in flattens:
                fold = prepare_fold(labelled, split, features, length, name, n, how)
                fitted = Classifier(fold.columns, model, **options).fit(fold.part("train"))
                one = cp.auc(fitted.score(fold.part("test")), []).withColumns({"split": F.lit(name), "normalize": F.lit(n), "flatten": F.lit(how)})
                out = one if out is None else out.unionByName(one)
    return out


def target_sweep(labelled: DataFrame, split: DataFrame, features: list[str], length: int, horizons: list[int], model: str = "random_forest", **options) -> DataFrame:
    """horizon, granularity (window, drive), n, prevalence, auc: windows once, labelled again for each horizon by the
    days to failure at their end."""
    fold = prepare_fold(labelled, split, features, length)
    ends = labelled.select(*KEY, F.col("ds").alias("end_ds"), "dtf")
    windows, out = fold.windows.join(ends, [*KEY, "end_ds"], "left"), None
    for h in horizons:
        w = windows.withColumn("y", in_horizon(F.col("dtf"), h))
        fitted = Classifier(fold.columns, model, **options).fit(w.filter("part = 'train'"))
        test = fitted.score(w.filter("part = 'test'")).withColumn("drive", F.concat_ws(":", *KEY))
        for grain, df in (("window", test), ("drive", cp.drive_level(test))):
            one = df.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("prevalence")).crossJoin(cp.auc(df, [])).withColumns({"horizon": F.lit(h), "granularity": F.lit(grain)})
            out = one if out is None else out.unionByName(one)
    return out


def seed_stability(labelled: DataFrame, drives: DataFrame, features: list[str], length: int, seeds: list[int], methods: list[str], model: str = "random_forest", **options) -> DataFrame:
    """conformal, n, mean and sd of coverage, failure coverage and set size over splits with different seeds."""
    out = None
    for seed in seeds:
        fold = prepare_fold(labelled, sp.standard_split(drives, seed=seed), features, length, f"seed_{seed}")
        for m in methods:
            one = run_cell(fold, model, method=m, **options).select("split", "conformal", "empirical_coverage", "coverage_failure", "avg_set_size")
            out = one if out is None else out.unionByName(one)
    stats = [f(c).alias(f"{c}_{n}") for c in ("empirical_coverage", "coverage_failure", "avg_set_size") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return out.groupBy("conformal").agg(F.count(F.lit(1)).alias("n"), *stats)


def results_table(results: DataFrame) -> DataFrame:
    cols = ["split", "model", "conformal", "n_test", "win_auc", "win_f_beta", "drv_auc", "empirical_coverage", "coverage_failure", "coverage_healthy", "avg_set_size"]
    return results.select(*cols).orderBy("split", "model", "conformal")


def coverage_gap(results: DataFrame, standard: str = "standard") -> DataFrame:
    """Coverage lost against the standard split's row of the same model and method."""
    std = results.filter(F.col("split") == standard).select("model", "conformal", F.col("empirical_coverage").alias("standard_coverage"))
    rest = results.filter(F.col("split") != standard).join(F.broadcast(std), ["model", "conformal"], "left")
    return rest.select("split", "model", "conformal", "empirical_coverage", "standard_coverage", (F.col("standard_coverage") - F.col("empirical_coverage")).alias("gap"))
