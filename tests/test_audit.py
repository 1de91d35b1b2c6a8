"""Errors, edge cases and helpers of the audits that SQL does not show."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellumen.functions import frames as fr
from tellumen.operators import conformal as cp
from tellumen.operators import labels as lb
from tellumen.operators import stages as st


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(k % 2, k / 100, k % 3, k) for k in range(100)], "y int, p double, stage int, drive int")


def test_missing_class_is_always_in_the_set(spark, scored):
    got = cp.predict(scored, scored.filter("y = 0"), 0.1, "class")
    assert got.filter("NOT set_f OR NOT fallback").isEmpty() and not got.filter("NOT set_h").isEmpty()
    pooled, inf = (cp.predict(scored, scored.filter("stage < 2"), 0.1, "group", fallback=f).filter("stage = 2") for f in ("pooled", "inf"))
    assert inf.filter("NOT (set_h AND set_f)").isEmpty() and not pooled.filter("NOT (set_h AND set_f)").isEmpty()


def test_arguments_are_checked(spark, scored):
    for alpha in (0, 1, -0.1, 1.5):
        with pytest.raises(ValueError):
            cp.thresholds(scored, alpha, [])
    with pytest.raises(ValueError):
        cp.predict(scored, scored, 0.1, "vendor")
    with pytest.raises(ValueError):
        cp.predict(scored, scored, 0.1, fallback="none")
    with pytest.raises(Exception, match="no calibration scores"):
        cp.thresholds(scored.filter("1 = 0"), 0.1, []).collect()


def test_infinite_scores_do_not_count(spark):
    cal = spark.createDataFrame([(0, float("inf")), (0, float("-inf")), (0, float("nan")), *[(0, k / 10) for k in range(9)]], "y int, p double")
    assert cp.thresholds(cal, 0.1, []).first().n == 9


def test_self_check(spark, scored):
    a, b = cp.predict(scored, scored, 0.1), cp.predict(scored, scored, 0.6)
    cp.assert_same_sets(a, a, ["drive"])
    with pytest.raises(AssertionError):
        cp.assert_same_sets(a, b, ["drive"])


def test_report_equals_numpy(spark, scored):
    r = cp.report(cp.predict(scored, scored, 0.2, "class"), scored, 0.2, "class").first()
    p, y = np.arange(100) / 100, np.arange(100) % 2
    s = np.where(y == 1, 1 - p, 1 - (1 - p))
    q = [np.sort(s[y == k])[int(np.ceil(51 * 0.8)) - 1] for k in (0, 1)]
    h, f = 1 - (1 - p) <= q[0], 1 - p <= q[1]
    assert r.method == "mondrian_class" and (r.n_cal, r.n_test, r.n_failures_test) == (100, 100, 50)
    assert np.isclose(r.qhat, np.median(q)) and np.isclose(r.empirical_coverage, np.where(y == 1, f, h).mean())
    assert np.isclose(r.avg_set_size, (h.astype(int) + f).mean()) and np.isclose(r.empty_rate, (~h & ~f).mean()) and len(r) == 16


def test_stage_edges(spark):
    df = spark.createDataFrame([(float(v), k, k % 2) for k, v in enumerate([1, 1, 1, 1, 2, 3, float("nan"), float("inf")])], "age double, id int, y int")
    assert st.fit_stages(df, "age", "y", ["id"], stages=4) == [1.0, 1.75]
    with pytest.raises(ValueError):
        st.fit_stages(df.filter("1 = 0"), "age", "y", ["id"])
    with pytest.raises(ValueError):
        st.fit_stages(df, "age", "y", ["id"], "spline")
    with pytest.raises(ValueError):
        st.window_age(df)
    assert np.isnan(st.window_age(df, "age").filter("id = 7").first().age)


def test_constant_curves_get_all_stages():
    assert st.binary_segment(np.full(60, 0.2), 2) == [5, 10]
    assert st.binary_segment(np.arange(9.0), 1) == []


def test_frames(spark):
    df = spark.createDataFrame([(1, "2020-01-01", 3.0), (2, "2020-01-02", 4.0)], "id int, ds string, r_1 double").withColumn("r_1_mean", F.col("r_1"))
    assert fr.existing(df, ["ds", "zz", "id"]).columns == ["ds", "id"] and fr.drop_features(df, ["r_1"]).columns == ["id", "ds"]
    with pytest.raises(ValueError, match="zz"):
        fr.require(df, ["id", "zz"])
    with pytest.raises(TypeError):
        fr.require_day(df)
    assert fr.require_day(df.withColumn("ds", F.to_date("ds"))).count() == 2
    assert fr.only(df.filter("id = 1")).r_1 == 3.0
    for cond in ("id > 0", "id > 5"):
        with pytest.raises(KeyError):
            fr.only(df.filter(cond))


def test_windows_without_any_row(spark):
    day = datetime.date(2020, 1, 1)
    w = spark.createDataFrame([("MA1", 1, day)], "model string, disk_id long, ds date")
    rows = spark.createDataFrame([("MA1", 2, day, day)], "model string, disk_id long, ds date, failure_time date")
    assert lb.attach_dtf(w, rows).first().dtf == float("inf")
    with pytest.raises(RuntimeError):
        lb.attach_dtf(w, rows, checked=True)
