"""Files: locating, counting, inspecting, appending, sampling exports, reports and settings."""

import gzip

import pytest
from pyspark.sql import functions as F

from tellumen.sources import telemetry as tm


def test_files(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "fail_2.csv").write_text("model,failure_time,disk_id\nMA1,2018-01-03,1\n")
    assert tm.find_failures(spark, str(tmp_path), "failure*.csv", "fail_*.csv").count() == 1
    for f in (tm.find_failures, tm.locate_export):
        with pytest.raises(FileNotFoundError):
            f(spark, str(tmp_path))
    spark.range(5).write.parquet(str(tmp_path / "deep" / "export"))
    assert tm.locate_export(spark, str(tmp_path)).endswith("/deep/export")
    (tmp_path / "a.csv").write_text("x,y\n1,\n2,b\n,\n")
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"y,x\n1,2\n"))
    assert tm.count_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv.gz")]) == 4
    assert {r.column: (r.n, r.n_null) for r in tm.inspect_raw(spark, str(tmp_path / "a.csv")).collect()} == {"x": (3, 1), "y": (3, 2)}
    heads = tm.compare_headers(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv.gz")])
    assert [r.verdict for r in heads.orderBy("file").collect()] == ["SAME", "REORDERED"]


def test_append_keeps_the_first_schema(spark, tmp_path):
    path = str(tmp_path / "panel")
    tm.append_panel(spark.createDataFrame([(1, 2.0)], "a long, b double"), path)
    tm.append_panel(spark.createDataFrame([("x", 3, "4")], "new string, b int, a string"), path)
    got = spark.read.parquet(path)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2.0), (4, 3.0)] and got.dtypes == [("a", "bigint"), ("b", "double")]
    with pytest.raises(ValueError, match="b"):
        tm.append_panel(spark.range(1).select(F.col("id").alias("a")), path)


def test_sampled_export(spark, tmp_path):
    tm.write_synthetic(spark, str(tmp_path / "syn"), drives=30, days=40, failure_scale=3.0)
    df = spark.read.parquet(str(tmp_path / "syn"))
    tm.export_slim(df, str(tmp_path / "slim"), ["n_1", "r_1"])
    drives = lambda x: {(r.model, r.disk_id) for r in x.select("model", "disk_id").distinct().collect()}
    failed = drives(df.filter("failure_time IS NOT NULL"))
    some = drives(tm.load_slim(spark, str(tmp_path / "slim"), 5))
    assert failed <= some and len(some) == len(failed) + 5 and drives(tm.load_slim(spark, str(tmp_path / "slim"))) == drives(df)


def test_report_and_settings(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "a int, b double")
    tm.write_report(tm.report(df, "one").unionByName(tm.report(df, "two")), str(tmp_path / "txt"))
    assert [r.value for r in spark.read.text(str(tmp_path / "txt")).collect()] == ["one\ta\t1.0", "one\tb\t0.5", "two\ta\t1.0", "two\tb\t0.5"]
    tm.write_config(spark, {"alpha": 0.1, "method": "split"}, str(tmp_path / "cfg"))
    assert spark.read.json(str(tmp_path / "cfg")).first().asDict() == {"alpha": 0.1, "method": "split"}
