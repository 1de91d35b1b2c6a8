"""Round trips, brute-force twins and streams of what SQL does not cover."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellumen.operators import models as ml
from tellumen.operators import ranking as fs
from tellumen.operators import stages as st
from tellumen.operators import weighted as wt
from tellumen.plans.registry import QUERIES
from tellumen.sources import telemetry as tm
from tellumen.streaming import online

DIR = "/root/testdata/sf0.001"


def test_csv_to_panel(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "20180101.csv").write_text("disk_id,ds,model,n_1\n1,20180101,MA1,5\n2,oops,MA1,6\n3,20180101,MB1,?\n")
    (tmp_path / "a" / "failure_list.csv").write_text("model,failure_time,disk_id\nMA1,2018-01-03,1\nMB1,never,3\n")
    df = tm.read_daily_csv(spark, [str(tmp_path / "a" / "20180101.csv")], ["n_1"])
    df = tm.to_double(tm.parse_days(df), ["disk_id", "ds", "model"]).withColumn("disk_id", F.col("disk_id").cast("long"))
    fails = tm.clean_failures(tm.find_failures(spark, str(tmp_path)))
    got = {r.disk_id: (r.n_1, r.days_to_failure, r.failure_event) for r in tm.merge_failures(df, fails).collect()}
    assert got == {1: (5.0, 2.0, 0), 3: (None, None, 0)}


def test_headers(spark, tmp_path):
    for name, head in (("a", "x,y"), ("b", "y,x"), ("c", "x,z")):
        (tmp_path / f"{name}.csv").write_text(head + "\n1,2\n")
    got = [r.verdict for r in tm.compare_headers(spark, [str(tmp_path)]).orderBy("file").collect()]
    assert got == ["SAME", "REORDERED", "DIFFERENT SET"]


def test_export_round_trip(spark, tmp_path):
    df = tm.synthetic(spark, drives=12, days=40)
    tm.export_slim(df, str(tmp_path / "slim"), ["n_1", "r_1"])
    back = spark.read.parquet(str(tmp_path / "slim"))
    assert back.count() == df.count()
    with pytest.raises(Exception):
        tm.export_slim(df, str(tmp_path / "slim"), ["n_1", "r_1"])
    p = tm.export_profile(df, ["n_1", "r_1"])
    assert tm.check_export(df, p, ["n_1", "r_1"]).filter("NOT (drives_ok AND n_rows_ok AND failed_ok)").isEmpty()
    with pytest.raises(ValueError):
        tm.check_contract(df, 1, 1)


def test_dump_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.1)], "drive long, p double")
    tm.write_dump({"cal": df}, spark.createDataFrame([("x",)], "tag string"), str(tmp_path))
    back = tm.read_dump(spark, str(tmp_path), "cal")
    assert tm.dump_differences(df, back).isEmpty() and tm.dump_differences(df, back.distinct()).count() == 1
    tm.write_csv(df, str(tmp_path / "csv"))
    assert tm.read_csv(spark, str(tmp_path / "csv"), "drive string, p double").count() == 3
    assert {r.metric for r in tm.report(df.limit(1), "s").collect()} == {"drive", "p"}


def test_numbering_is_exact_with_ties(spark):
    rows = [(k, float(k % 7) if k % 3 else 1.0) for k in range(1000)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(7)
    got = {r.id: r._k for r in st.numbered(df, "v", ["id"], 16).collect()}
    assert got == {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}


def test_segments_match_brute_force():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, 20), rng.normal(1, 0.1, 20), rng.normal(5, 0.1, 20)])
    cost = lambda cuts: sum(np.var(p) * len(p) for p in np.split(x, cuts))
    best = min(itertools.combinations(range(5, 56), 2), key=lambda c: cost(c) if c[1] - c[0] >= 5 else np.inf)
    assert tuple(st.binary_segment(x, 2)) == best == (20, 40)


def test_weighted_sets_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(k % 4 == 0), float(np.round(rng.random(), 3)), float(rng.integers(1, 9)) / 4, "cal" if k < 150 else "test") for k in range(300)]
    df = spark.createDataFrame(rows, "id int, y int, p double, w double, part string")
    got = {r.id: r.qhat for r in wt.weighted_sets(df.filter("part = 'test'"), df.filter("part = 'cal'"), 0.1).collect()}
    cal = sorted((1 - p if y else 1 - (1 - p), w) for _, y, p, w, part in rows if part == "cal")
    total, cum = sum(w for _, w in cal), np.cumsum([w for _, w in cal])
    for i, _, _, w, part in rows:
        if part == "test":
            at = np.flatnonzero(cum >= 0.9 * (total + w))
            assert got[i] == (cal[at[0]][0] if len(at) else np.inf)


def test_one_class_is_an_error(spark):
    df = spark.createDataFrame([(1, 0, 0.5)], "feature int, y int, x double")
    with pytest.raises(ValueError):
        fs.select_features(df)


def test_models_learn_and_handle_one_class(spark):
    df = spark.createDataFrame([(k % 2, float(k % 2) + (k % 5) / 10, None if k % 9 == 0 else 1.0) for k in range(200)], "y int, a double, b double")
    for name, opt in (("random_forest", {"trees": 5}), ("logistic", {}), ("gbm", {"rounds": 3})):
        out = ml.Classifier(["a", "b"], name, **opt).fit(df).score(df)
        assert out.groupBy("y").agg(F.avg("p").alias("p")).filter("y = 1").first().p > 0.8
    assert ml.Classifier(["a"], "logistic").fit(df.filter("y = 1")).score(df).select("p").distinct().collect()[0].p == 1.0


@pytest.mark.parametrize("name", ["ts19_changepoint_stages", "fs11_select_features", "ml8_platt", "ml9_isotonic", "io23_synthetic"])
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_stream_closes_days(spark, tmp_path):
    src = spark.read.parquet(f"{DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    stream = online.daily(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = online.daily(src).join(got.select("disk_id", "ds"), ["disk_id", "ds"], "left_semi")
    assert got.count() == want.count() > 0 and got.exceptAll(want.select(*got.columns)).isEmpty()
