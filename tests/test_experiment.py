"""Folds, cells and experiments on synthetic telemetry: what comes from train alone, errors, resuming."""

import pytest
from pyspark.sql import functions as F

from tellumen.operators import experiment as ex
from tellumen.operators import labels as lb
from tellumen.operators import scaling as ts
from tellumen.operators import splits as sp
from tellumen.operators import weighted as wt
from tellumen.session import materialised
from tellumen.sources import telemetry as tm

FEATURES = ["n_1", "r_1", "n_2", "r_2"]


@pytest.fixture(scope="module")
def labelled(spark):
    raw = tm.synthetic(spark, drives=60, days=80, failure_scale=4.0)
    return materialised(lb.build_labels(raw, 15, 20).drop("r_9"), "test-labelled")


@pytest.fixture(scope="module")
def split(labelled):
    return materialised(sp.standard_split(lb.drive_table(labelled)), "test-split")


@pytest.fixture(scope="module")
def fold(labelled, split):
    return ex.prepare_fold(labelled, split, FEATURES, 7, stride=3, positive_stride=2)


def test_statistics_come_from_train(labelled, split):
    cells = ts.cells(ex.pn.densify(labelled, FEATURES), 7).join(split.select("model", "disk_id", "part"), ["model", "disk_id"])
    z = ts.fit_zscore(ex.normalised(cells, FEATURES, "zscore").filter("part = 'train'"), FEATURES).first()
    assert all(abs(z[f"{c}_mu"]) < 1e-6 and abs(z[f"{c}_sd"] - 1) < 1e-6 for c in FEATURES)
    shifted = cells.withColumn("n_1", F.when(F.col("part") == "test", 1e9).otherwise(F.col("n_1")))
    a, b = (ts.fit_zscore(ex.normalised(x, FEATURES, "zscore").filter("part = 'cal'"), FEATURES).first() for x in (cells, shifted))
    assert a.n_1_mu == pytest.approx(b.n_1_mu)


@pytest.mark.parametrize("normalize,how,n", [("none", "last", 4), ("rank", "dynamics", 28), ("per_drive", "stats", 24)])
def test_representations(labelled, split, normalize, how, n):
    f = ex.prepare_fold(labelled, split, FEATURES, 7, normalize=normalize, how=how, stride=5)
    assert len(f.columns) == n and f.windows.select([F.count_if(F.col(c).isNull()).alias(c) for c in f.columns]).first() == tuple([0] * n)


def test_constant_and_selected_features(labelled, split):
    flat = labelled.withColumn("dead", F.lit(7.0))
    f = ex.prepare_fold(flat, split, [*FEATURES, "dead"], 7, stride=5, drop_constant=True)
    assert f.dropped == ["dead"] and "dead" not in f.features
    f = ex.prepare_fold(flat, split, [*FEATURES, "dead"], 7, stride=5, select=True, most=3)
    assert 1 <= len(f.features) < 5 and all(any(c.startswith(f"{x}_") for x in f.features) for c in f.columns)


def test_bad_folds_are_errors(labelled, split):
    with pytest.raises(ValueError, match="empty"):
        ex.prepare_fold(labelled, split.filter("part <> 'cal'"), FEATURES, 7)
    with pytest.raises(AssertionError, match="held-out"):
        ex.prepare_fold(labelled, split, FEATURES, 7, held_out="A")
    with pytest.raises(ValueError):
        ex.prepare_fold(labelled, split, FEATURES, 7, normalize="minmax")
    with pytest.raises(ValueError):
        ex.prepare_fold(labelled, split, FEATURES, 7, how="fft")


@pytest.mark.parametrize("method", ["both", "weighted"])
def test_cell(fold, method):
    r = ex.run_cell(fold, "logistic", method=method).first()
    n = {x.part: x.n for x in fold.windows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert (r.n_train_windows, r.n_cal_windows, r.n_test) == (n["train"], n["cal"], n["test"]) and len(r) >= 50
    assert r.conformal == method and 0.6 < r.empirical_coverage <= 1 and r.win_auc > 0.7 and r.win_tp + r.win_fn == r.n_failures_test


def test_experiment_resumes(spark, labelled, tmp_path, monkeypatch):
    drives = lb.drive_table(labelled)
    splits, held = ex.vendor_splits(drives, ["C"])
    args = (labelled, splits, FEATURES, 7, ["logistic"], ["split", "class"], str(tmp_path), held, {"stride": 5})
    ran = []
    cell = ex.run_cell
    monkeypatch.setattr(ex, "run_cell", lambda fold, model, **o: ran.append((fold.name, o["method"])) or cell(fold, model, **o))
    got = ex.run_experiment(*args)
    assert got.count() == 4 and len(ran) == 4
    import shutil

    shutil.rmtree(ex.cell_path(str(tmp_path), "lomo_C", "logistic", "class"))
    again = ex.run_experiment(*args)
    assert ran[4:] == [("lomo_C", "class")] and again.count() == 4
    assert [r.split for r in ex.results_table(again).collect()] == ["lomo_C", "lomo_C", "standard", "standard"]
    gap = ex.coverage_gap(again).collect()
    assert len(gap) == 2 and all(r.gap == pytest.approx(r.standard_coverage - r.empirical_coverage) for r in gap)


def test_sweeps(labelled, split):
    r = ex.representation_sweep(labelled, {"standard": split}, FEATURES, 7, ["zscore", "none"], ["last"], "logistic")
    assert {(x.normalize, x.flatten) for x in r.collect()} == {("zscore", "last"), ("none", "last")}
    t = ex.target_sweep(labelled, split, FEATURES, 7, [5, 15], "logistic").collect()
    assert len(t) == 4 and max(x.prevalence for x in t if x.granularity == "window" and x.horizon == 5) < max(x.prevalence for x in t if x.horizon == 15)


def test_ratios_from_features(spark):
    rows = [(k, float(k % 10), "cal") for k in range(400)] + [(k, float(5 + k % 5), "test") for k in range(300)]
    df = spark.createDataFrame(rows, "id int, x double, part string").withColumn("y", F.lit(0)).withColumn("p", F.lit(0.5))
    cal, test, info = wt.fit_density_ratio(df.filter("part = 'cal'"), df.filter("part = 'test'"), ["x"])
    m = {r.x: r.w for r in cal.groupBy("x").agg(F.avg("w").alias("w")).collect()}
    assert m[0.0] < 0.3 < 1.2 < m[9.0] and cal.count() == 400 and test.count() == 300 and set(cal.columns) == {"id", "x", "part", "y", "p", "w"}
    assert 0.7 < info.first().domain_auc < 0.8


def test_within_the_vendor(labelled):
    drives = lb.drive_table(labelled)
    got = sp.held_out_splits(drives, "model", ["drive_label"], within="vendor")
    assert got.filter(F.substring("fold", 2, 1) != F.col("vendor")).isEmpty() and got.filter("part = 'test' AND model <> fold").isEmpty()
