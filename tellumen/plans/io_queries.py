"""Queries of ingest, exports and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellumen.operators import labels as lb
from tellumen.operators import models as ml
from tellumen.operators import panel as pn
from tellumen.operators import sampling as sa
from tellumen.operators import splits as sp
from tellumen.operators.conformal import auc, calibration
from tellumen.operators.experiment import STATS, prepare_fold, run_cell
from tellumen.plans.registry import W, _drives, _labelled, query
from tellumen.session import materialised
from tellumen.sources import telemetry as tm
from tellumen.sources.fleet import FEATURES, KEY, PANEL_SQL, panel, read, scored

_RAW = "raw AS (SELECT event_type AS model, CASE WHEN event_id % 7 = 0 THEN 'x' || user_id::VARCHAR ELSE user_id::VARCHAR END AS disk_id, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS failure_time FROM events)"
_DAYS = "raw AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE strftime(ts, '%Y%m%d') END AS ds FROM events)"


@query("io3_clean_failures", "SELECT model, TRY_CAST(disk_id AS BIGINT) AS disk_id, TRY_CAST(failure_time AS TIMESTAMP) AS failure_time FROM raw WHERE TRY_CAST(disk_id AS BIGINT) IS NOT NULL AND TRY_CAST(failure_time AS TIMESTAMP) IS NOT NULL AND model IS NOT NULL", _RAW)
def _(spark, d):
    e = read(spark, d, "events")
    user = F.col("user_id").cast("string")
    raw = e.select(F.col("event_type").alias("model"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), user)).otherwise(user).alias("disk_id"), F.when(F.col("event_id") % 5 == 0, "none").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("failure_time"))
    return tm.clean_failures(raw)


@query("io4_parse_days", "SELECT event_id, CAST(try_strptime(ds, '%Y%m%d') AS DATE) AS ds FROM raw WHERE try_strptime(ds, '%Y%m%d') IS NOT NULL", _DAYS)
def _(spark, d):
    raw = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "bad").otherwise(F.date_format("ts", "yyyyMMdd")).alias("ds"))
    return tm.parse_days(raw)


@query("io5_to_double", "SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS event_type, TRY_CAST(value AS DOUBLE) AS value FROM events")
def _(spark, d):
    return tm.to_double(read(spark, d, "events").select("event_id", "event_type", F.col("value").cast("string").alias("value")), ["event_id"])


@query("io6_merge_failures", "SELECT model, disk_id, ds, failure_time, date_diff('day', ds, failure_time)::DOUBLE AS days_to_failure, coalesce(failure_time <= ds, FALSE)::INT AS failure_event FROM panel", PANEL_SQL)
def _(spark, d):
    p = panel(spark, d)
    failures = p.filter("failure_time IS NOT NULL").select(*KEY, "failure_time").distinct()
    return tm.merge_failures(p.select(*KEY, "ds"), failures).withColumn("failure_event", F.col("failure_event").cast("int"))


@query("io13_export_profile", "SELECT model, count(DISTINCT disk_id) AS drives, count(*) AS n_rows, count(DISTINCT disk_id) FILTER (failure_time IS NOT NULL) AS failed, min(ds) AS first_ds, max(ds) AS last_ds, greatest(" + ", ".join(f"avg(({c} IS NULL OR isnan({c}))::INT)" for c in FEATURES) + ") < 0.5 AS usable FROM panel GROUP BY model", PANEL_SQL)
def _(spark, d):
    return tm.export_profile(panel(spark, d), FEATURES)


@query("io20_pending_cells", "SELECT n_name, r_name FROM nation CROSS JOIN region EXCEPT SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    done = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    return tm.pending(n.select("n_name").crossJoin(F.broadcast(r.select("r_name"))), done, ["n_name", "r_name"])


@query("io23_synthetic")
def _(spark, d):
    return tm.synthetic(spark)


@query("ml1_forest")
def _(spark, d):
    x = _labelled(spark, d)
    win = pn.windows(pn.densify(x, FEATURES), FEATURES, W).join(sp.standard_split(_drives(spark, d)).select(*KEY, "part"), KEY)
    win = materialised(win, "ml1-windows")
    m = ml.Classifier([f"{c}_{s}" for c in FEATURES for s in STATS], "random_forest").fit(win.filter("part <> 'test'"))
    return auc(m.score(win.filter("part = 'test'")), [])


@query("ml8_platt")
def _(spark, d):
    s = scored(spark, d)
    q = ml.platt(s.filter("part = 'cal'"), s.filter("part = 'test'"))
    return calibration(q.drop("p").withColumnRenamed("q", "p"), ["stage"])


@query("ml9_isotonic")
def _(spark, d):
    s = scored(spark, d)
    q = ml.isotonic(s.filter("part = 'cal'"), s.filter("part = 'test'"))
    return calibration(q.drop("p").withColumnRenamed("q", "p"), ["stage"])


@query("ex2_run_cell")
def _(spark, d):
    x = _labelled(spark, d)
    split = sp.held_out_splits(lb.drive_table(x), "vendor", ["model", "drive_label"]).filter("fold = 'A'")
    return run_cell(prepare_fold(x, split, FEATURES, W, "lomo_A", held_out="A"), "logistic", method="class")


@query("sp14_manifest", "SELECT fold, part, count(*) AS drives FROM (SELECT vendor AS fold, 'test' AS part FROM (SELECT model, disk_id, substr(model, 2, 1) AS vendor FROM panel GROUP BY ALL)) GROUP BY ALL", PANEL_SQL)
def _(spark, d):
    drives = panel(spark, d).select(*KEY, lb.vendor().alias("vendor"), F.lit(0).alias("drive_label")).distinct()
    return sp.held_out_splits(drives, "vendor", ["model"]).filter("part = 'test'").groupBy("fold", "part").agg(F.count(F.lit(1)).alias("drives"))


@query("sp13_within_vendor", "SELECT count(*) AS n FROM (SELECT model, disk_id FROM panel GROUP BY ALL)", PANEL_SQL)
def _(spark, d):
    drives = panel(spark, d).select(*KEY, lb.vendor().alias("vendor"), F.lit(0).alias("drive_label")).distinct()
    parts = sp.stratified(drives, [("test", 0.2), ("cal", 0.16), ("train", 1.0)], ["vendor", "model", "drive_label"], 42)
    return sa.one_per_drive(parts, KEY, KEY).agg(F.count(F.lit(1)).alias("n"))
