"""Queries over the event panel: normalisers, flattenings, label diagnostics, joins, stages, sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tellumen.functions import scalars as sc
from tellumen.operators import labels as lb
from tellumen.operators import panel as pn
from tellumen.operators import sampling as sa
from tellumen.operators import scaling as ts
from tellumen.operators import stages as st
from tellumen.plans.registry import _DENSE, _LABELS, H, MIN, W, _drives, _labelled, query
from tellumen.sources.fleet import FEATURES, KEY, PANEL_SQL, missing, panel, read

G, EXACT = 100, ["n_1", "n_2", "r_2"]
_CELLS = _DENSE + f""",
wk AS (SELECT *, pos >= {W - 1} AND label >= 0 AND avg(present) OVER (PARTITION BY model, disk_id ORDER BY ds ROWS {W - 1} PRECEDING) >= 0.5 AS kept FROM wp),
cells AS (SELECT *, sum(kept::INT) OVER (PARTITION BY model, disk_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS covers FROM wk),
each AS (SELECT *, unnest(range(covers::BIGINT)) AS copy FROM cells),
z AS (SELECT {", ".join(f"avg({c}) AS {c}_mu, stddev_pop({c}) AS {c}_sd" for c in FEATURES)} FROM each)"""


def _cells(spark, d):
    return ts.cells(pn.densify(_labelled(spark, d), FEATURES), W)


def _r(cols, k=4):
    return [(F.round(F.round(c, 9), k) + 0).alias(c) for c in cols]


@query("ts5_zscore", "SELECT model, disk_id, ds, " + ", ".join(f"round(({c} - {c}_mu) / CASE WHEN {c}_sd < 1e-8 THEN 1 ELSE {c}_sd END, 4) + 0 AS {c}" for c in FEATURES) + " FROM cells, z WHERE kept", _CELLS)
def _(spark, d):
    df = _cells(spark, d)
    return ts.zscore(df, ts.fit_zscore(df, FEATURES), FEATURES).filter("kept").select(*KEY, "ds", *_r(FEATURES))


@query("ag19_cell_moments", "SELECT " + ", ".join(f"round({c}_mu, 4) AS {c}_mu, round({c}_sd, 4) AS {c}_sd" for c in FEATURES) + " FROM z", _CELLS)
def _(spark, d):
    s = ts.fit_zscore(_cells(spark, d), FEATURES)
    return s.select(*_r(s.columns))


@query("ts8_constant_features", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round({c}_sd, 4) AS sd, {c}_sd < 1e-6 AS bad FROM z2" for c in [*FEATURES, "flat"]) + ") WHERE bad", _CELLS + ", z2 AS (SELECT *, 0.0::DOUBLE AS flat_sd FROM z)")
def _(spark, d):
    df = _cells(spark, d).withColumn("flat", F.lit(3.0))
    return ts.constant_features(ts.fit_zscore(df, [*FEATURES, "flat"]), [*FEATURES, "flat"]).select("feature", F.round("sd", 4).alias("sd"), F.lit(True).alias("bad"))


def _rank_sql(features: list[str], size: int) -> str:
    grid = "[" + ", ".join(repr(k / (size - 1)) for k in range(size)) + "]"
    return "SELECT model, disk_id, ds, " + ", ".join(f"round(len(list_filter({c}_g, lambda e: e < {c})) / {size - 1}.0::DOUBLE - 0.5, 4) AS {c}" for c in features) + f" FROM cells JOIN (SELECT vendor, {', '.join(f'quantile_cont({c}, {grid}) AS {c}_g' for c in features)} FROM each GROUP BY vendor) g USING (vendor) WHERE kept"


def _ranked(spark, d, features, size):
    df = _cells(spark, d)
    own, pooled = ts.fit_rank(df, features, "vendor", size)
    return ts.rank(df.filter("kept"), own, pooled, features, "vendor", size).select(*KEY, "ds", *_r(features))


@query("ts6_rank", _rank_sql(FEATURES, G), _CELLS)
def _(spark, d):
    return _ranked(spark, d, FEATURES, G)


# The whole grid, on the features that no order of summation changes: a mean's last bit moves it across a grid point.
@query("ts6_rank_1000", _rank_sql(EXACT, 1000), _CELLS)
def _(spark, d):
    return _ranked(spark, d, EXACT, 1000)


_OWN = ", ".join(f"list({c}) OVER fr AS {c}_w" for c in FEATURES)
_MED = ", ".join(f"list_aggregate({c}_w[1:5], 'median') AS {c}_m, list_aggregate({c}_w, 'stddev_pop') AS {c}_s" for c in FEATURES)
_MAD = ", ".join(f"list_aggregate(list_transform({c}_w[1:5], lambda v: abs(v - {c}_m)), 'median') AS {c}_d" for c in FEATURES)


@query("ts7_per_drive", "SELECT model, disk_id, ds, " + ", ".join(f"round(({c} - {c}_m) / CASE WHEN {c}_d > 1e-8 THEN {c}_d WHEN {c}_s > 1e-8 THEN {c}_s ELSE 1 END, 4) + 0 AS {c}" for c in FEATURES) + f" FROM (SELECT *, {_MAD} FROM (SELECT *, {_MED} FROM (SELECT *, {_OWN} FROM cells WINDOW fr AS (PARTITION BY model, disk_id ORDER BY ds ROWS {W - 1} PRECEDING)) WHERE kept))", _CELLS)
def _(spark, d):
    df = _cells(spark, d).withColumns({f"{c}_w": ts.steps(c, W) for c in FEATURES}).filter("kept")
    return df.select(*KEY, "ds", *[(F.round(ts.self_scaled_last(F.col(f"{c}_w")), 4) + 0).alias(c) for c in FEATURES])


@query("ts11_flatten_full", "SELECT model, disk_id, ds AS end_ds, " + ", ".join(f"round(r_1_w[{t + 1}], 4) AS r_1_t{t}" for t in range(W)) + f" FROM (SELECT *, list(r_1) OVER (PARTITION BY model, disk_id ORDER BY ds ROWS {W - 1} PRECEDING) AS r_1_w FROM cells) WHERE kept", _CELLS)
def _(spark, d):
    return ts.flatten_full(_cells(spark, d), ["r_1"], W).select(*KEY, "end_ds", *_r([f"r_1_t{t}" for t in range(W)]))


@query("ts10_flatten_last", "SELECT model, disk_id, ds AS end_ds, " + ", ".join(f"round({c}, 4) AS {c}" for c in FEATURES) + " FROM cells WHERE kept", _CELLS)
def _(spark, d):
    return _cells(spark, d).filter("kept").select(*KEY, F.col("ds").alias("end_ds"), *_r(FEATURES))


_DYN = ("slope", "delta", "rel_delta", "std", "max_jump", "n_changes")
_DYN_SQL = """SELECT model, disk_id, ds AS end_ds, round((regr_slope({c}, pos) OVER fr)::DECIMAL(24, 9), 4)::DOUBLE + 0 AS {c}_slope, round(({c} - first_value({c}) OVER fr)::DECIMAL(24, 9), 4)::DOUBLE + 0 AS {c}_delta, round(({c} - first_value({c}) OVER fr) / (abs(first_value({c}) OVER fr) + 1), 4) + 0 AS {c}_rel_delta,
round((stddev_pop({c}) OVER fr)::DECIMAL(24, 9), 4)::DOUBLE + 0 AS {c}_std, round((max(jump) OVER st)::DECIMAL(24, 9), 4)::DOUBLE + 0 AS {c}_max_jump, round((avg((jump > 1e-9)::INT) OVER st)::DECIMAL(24, 9), 4)::DOUBLE + 0 AS {c}_n_changes, round(({c})::DECIMAL(24, 9), 4)::DOUBLE + 0 AS {c}_last, kept
FROM (SELECT *, abs({c} - lag({c}) OVER (PARTITION BY model, disk_id ORDER BY ds)) AS jump FROM cells) WINDOW fr AS (PARTITION BY model, disk_id ORDER BY ds ROWS {w} PRECEDING), st AS (PARTITION BY model, disk_id ORDER BY ds ROWS {v} PRECEDING)"""


@query("ts13_flatten_dynamics", f"SELECT * EXCLUDE (kept) FROM ({_DYN_SQL.format(c='r_1', w=W - 1, v=W - 2)}) WHERE kept", _CELLS)
def _(spark, d):
    return ts.flatten_dynamics(_cells(spark, d), ["r_1"], W).select(*KEY, "end_ds", *_r([f"r_1_{s}" for s in (*_DYN, "last")]))


@query("ts14_dynamics_only", f"SELECT * EXCLUDE (kept, r_2_last) FROM ({_DYN_SQL.format(c='r_2', w=W - 1, v=W - 2)}) WHERE kept", _CELLS)
def _(spark, d):
    return ts.flatten_dynamics(_cells(spark, d), ["r_2"], W, last=False).select(*KEY, "end_ds", *_r([f"r_2_{s}" for s in _DYN]))


@query("ts26_transfer", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(({c} < lo OR {c} > hi)::INT), 6) AS outside, round((avg({c}) - any_value(mu)) / any_value(sd), 4) AS shift, round(stddev_pop({c}) / any_value(sd), 4) AS sd_ratio FROM labelled, (SELECT min({c}) AS lo, max({c}) AS hi, avg({c}) AS mu, stddev_pop({c}) AS sd FROM labelled WHERE vendor <> 'A') WHERE vendor = 'A'" for c in FEATURES), _LABELS)
def _(spark, d):
    df = _labelled(spark, d)
    t = ts.transfer(df.filter("vendor <> 'A'"), df.filter("vendor = 'A'"), FEATURES)
    return t.select("feature", F.round("outside", 6).alias("outside"), *_r(["shift", "sd_ratio"]))


@query("ts4_window_summary", "SELECT count(*) AS windows, count(DISTINCT (model, disk_id)) AS drives, sum(label)::BIGINT AS positives, round(avg(label), 6) AS positive_rate FROM cells WHERE kept", _CELLS)
def _(spark, d):
    k = _cells(spark, d).filter("kept")
    return k.agg(F.count(F.lit(1)).alias("windows"), F.count_distinct(F.struct(*KEY)).alias("drives"), F.sum("label").alias("positives"), F.round(F.avg("label"), 6).alias("positive_rate"))


@query("ts22_multi_horizon", "SELECT h AS horizon, sum((dtf > 0 AND dtf <= h)::INT)::BIGINT AS positives, count(*) AS n FROM labelled CROSS JOIN (SELECT unnest([1, 2, 3, 5]) AS h) GROUP BY h".replace("sum((dtf > 0 AND dtf <= h)::INT)", "sum(coalesce(dtf > 0 AND dtf <= h, FALSE)::INT)"), _LABELS)
def _(spark, d):
    return lb.multi_horizon(_labelled(spark, d), [1, 2, 3, 5]).groupBy("horizon").agg(F.sum("label").alias("positives"), F.count(F.lit(1)).alias("n"))


_HASH = "md5(concat_ws('|', '42', model, disk_id::VARCHAR, ds::VARCHAR))"


@query("ts23_cap_negatives", f"SELECT model, disk_id, ds, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH}) AS k, sum(label) OVER () AS n_pos FROM labelled) WHERE label = 1 OR k <= 500 - n_pos", _LABELS)
def _(spark, d):
    return sa.cap_negatives(_labelled(spark, d), 500, [*KEY, "ds"], "label").select(*KEY, "ds", "label")


@query("ts17_failure_curve", "SELECT bin, count(*) AS n, round(avg(r_9), 6) AS age, round(avg(label), 6) AS rate FROM (SELECT *, ntile(60) OVER (ORDER BY r_9, model, disk_id, ds) AS bin FROM labelled) GROUP BY bin", _LABELS)
def _(spark, d):
    return st.failure_curve(_labelled(spark, d), "r_9", "label", [*KEY, "ds"], 60).select("bin", "n", F.round("age", 6).alias("age"), F.round("rate", 6).alias("rate"))


@query("ts19_changepoint_stages")
def _(spark, d):
    df = _labelled(spark, d)
    edges = st.changepoint_edges(df, "r_9", "label", [*KEY, "ds"], 3, 60)
    return st.stage_table(df, "r_9", "label", edges)


@query("ts21_stage_table", """SELECT s.stage, any_value(s.name) AS name, count(l.model) AS n, coalesce(sum(label), 0)::BIGINT AS positives, round(avg(label), 6) AS rate FROM (VALUES (0, 's0[-inf,20)'), (1, 's1[20,60)'), (2, 's2[60,1e+06)'), (3, 's3[1e+06,inf)')) s(stage, name)
LEFT JOIN labelled l ON s.stage = (CASE WHEN r_9 >= 1000000 THEN 3 WHEN r_9 >= 60 THEN 2 WHEN r_9 >= 20 THEN 1 ELSE 0 END) GROUP BY s.stage""", _LABELS)
def _(spark, d):
    return st.stage_table(_labelled(spark, d), "r_9", "label", [20.0, 60.0, 1e6])


@query("ag3_integrity", "SELECT count(*) AS n, count(*) FILTER (dtf < 0) AS n_after, max(ds) AS last_ds, count(failure_time) AS n_failing FROM v", _LABELS)
def _(spark, d):
    p = panel(spark, d).withColumn("dtf", lb.days_to_failure())
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("dtf") < 0, F.lit(False))).alias("n_after"), F.max("ds").alias("last_ds"), F.count("failure_time").alias("n_failing"))


@query("ag5_key_collisions", "SELECT count(*) AS n FROM (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) > 1)")
def _(spark, d):
    return lb.key_collisions(read(spark, d, "lineitem"), "l_suppkey", "l_returnflag")


@query("ag8_usable_features", "SELECT vendor, count(*) FILTER (share > 0.5) AS usable FROM (" + " UNION ALL ".join(f"SELECT vendor, avg(({c} IS NOT NULL AND NOT isnan({c}))::INT) AS share FROM labelled GROUP BY vendor" for c in FEATURES) + ") GROUP BY vendor", _LABELS)
def _(spark, d):
    a = _labelled(spark, d).groupBy("vendor").agg(*[(1 - F.avg(missing(c).cast("double"))).alias(c) for c in FEATURES])
    return a.unpivot("vendor", FEATURES, "feature", "share").groupBy("vendor").agg(F.count_if(F.col("share") > 0.5).alias("usable"))


@query("ag10_post_failure", "SELECT count(*) AS drives, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, min(n) AS lo, quantile_disc(n, 0.25) AS q1, quantile_disc(n, 0.5) AS q2, quantile_disc(n, 0.75) AS q3, max(n) AS hi, count(*) FILTER (n > 5) AS over_5 FROM (SELECT count(*) AS n FROM v WHERE dtf <= 0 GROUP BY model, disk_id)", _LABELS)
def _(spark, d):
    return lb.post_failure_profile(panel(spark, d), [5])


@query("ag11_horizon_coverage", f"SELECT count(*) AS failed, count(*) FILTER (n >= 1) AS at_least_one, count(*) FILTER (n = {H}) AS whole, count(*) FILTER (n = 0) AS none FROM (SELECT count(*) FILTER (dtf > 0 AND dtf <= {H}) AS n FROM v WHERE failure_time IS NOT NULL GROUP BY model, disk_id)", _LABELS)
def _(spark, d):
    return lb.horizon_coverage(panel(spark, d), H)


@query("ag12_history", f"SELECT count(*) AS failed, round(avg(n), 6) AS mean, min(n) AS lo, max(n) AS hi, count(*) FILTER (n >= {MIN}) AS enough FROM (SELECT count(*) FILTER (dtf > {H}) AS n FROM v WHERE failure_time IS NOT NULL GROUP BY model, disk_id)", _LABELS)
def _(spark, d):
    return lb.history_profile(panel(spark, d), H, MIN)


@query("ag13_censoring_depth", "SELECT count(*) AS drives, count(*) FILTER (gap > 1) AS over_1, count(*) FILTER (gap > 3) AS over_3 FROM (SELECT date_diff('day', max(ds), (SELECT max(ds) FROM v)) AS gap FROM v WHERE failure_time IS NULL GROUP BY model, disk_id)", _LABELS)
def _(spark, d):
    return lb.censoring_depth(panel(spark, d), [1, 3])


@query("ag14_projected_labels", f"SELECT vendor, count(*) AS n, count(*) FILTER (dtf <= {H}) AS positives FROM v WHERE dtf IS NULL OR dtf >= 0 GROUP BY vendor", _LABELS)
def _(spark, d):
    p = panel(spark, d).withColumns({"vendor": lb.vendor(), "dtf": lb.days_to_failure()}).filter("dtf IS NULL OR dtf >= 0")
    return p.groupBy("vendor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("dtf") <= H, F.lit(False))).alias("positives"))


_AGE = [0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@query("ag21_age_percentiles", "SELECT vendor, " + ", ".join(f"round(quantile_cont(r_9, {q}), 6) AS p{round(q * 100)}" for q in _AGE) + " FROM labelled GROUP BY vendor", _LABELS)
def _(spark, d):
    q = _labelled(spark, d).groupBy("vendor").agg(F.percentile("r_9", F.array(*[F.lit(x) for x in _AGE])).alias("q"))
    return q.select("vendor", *[F.round(F.col("q")[k], 6).alias(f"p{round(x * 100)}") for k, x in enumerate(_AGE)])


@query("ag18_modal_stage", "SELECT model, disk_id, stage FROM (SELECT *, row_number() OVER (PARTITION BY model, disk_id ORDER BY n DESC, stage) AS k FROM (SELECT model, disk_id, CASE WHEN r_9 >= 60 THEN 2 WHEN r_9 >= 20 THEN 1 ELSE 0 END AS stage, count(*) AS n FROM labelled GROUP BY ALL)) WHERE k = 1", _LABELS)
def _(spark, d):
    return st.modal_stage(_labelled(spark, d).withColumn("stage", st.assign("r_9", [20.0, 60.0])), KEY)


@query("j8_failed_without_positive", "SELECT model, disk_id FROM v WHERE failure_time IS NOT NULL GROUP BY ALL EXCEPT SELECT model, disk_id FROM labelled WHERE label = 1", _LABELS)
def _(spark, d):
    return panel(spark, d).filter("failure_time IS NOT NULL").select(*KEY).distinct().join(_labelled(spark, d).filter("label = 1").select(*KEY), KEY, "left_anti")


@query("j4_attach_dtf", "SELECT model, disk_id, c.ds, coalesce(v.dtf::DOUBLE, 'inf'::DOUBLE) AS dtf FROM cells c LEFT JOIN v USING (model, disk_id) WHERE kept AND v.ds = c.ds", _CELLS)
def _(spark, d):
    right = panel(spark, d).select(*KEY, "ds", lb.days_to_failure().cast("double").alias("dtf"))
    out = _cells(spark, d).filter("kept").select(*KEY, "ds").join(right, [*KEY, "ds"], "left")
    return out.select(*KEY, "ds", F.coalesce("dtf", F.lit(float("inf"))).alias("dtf"))


@query("pf19_fingerprint", "SELECT vendor, substr(sha1(string_agg(concat_ws(':', model, disk_id::VARCHAR), '|' ORDER BY concat_ws(':', model, disk_id::VARCHAR))), 1, 12) AS print FROM drives GROUP BY vendor", _LABELS)
def _(spark, d):
    return _drives(spark, d).groupBy("vendor").agg(sc.fingerprint(*KEY).alias("print"))


@query("sp6_drive_sample", "SELECT model, disk_id FROM (SELECT *, row_number() OVER (PARTITION BY drive_label ORDER BY md5(concat_ws('|', '42', model, disk_id::VARCHAR))) AS k FROM drives) WHERE drive_label = 1 OR k <= 20", _LABELS)
def _(spark, d):
    return sa.sample_drives(_drives(spark, d), 20).select(*KEY)


@query("sp9_stage_holdout", "SELECT model, disk_id, ds, CASE WHEN r_9 >= 20 AND r_9 < 60 THEN 'test' WHEN ('0x' || substr(md5(concat_ws('|', '42', model, disk_id::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.2::DOUBLE THEN 'cal' ELSE 'train' END AS part FROM labelled", _LABELS)
def _(spark, d):
    df = _labelled(spark, d).withColumn("stage", st.assign("r_9", [20.0, 60.0]))
    return sa.stage_holdout(df, 1).select(*KEY, "ds", "part")


@query("sp12_matched_strata", f"SELECT label, stratum, count(*) AS n FROM (SELECT label, ((row_number() OVER (PARTITION BY label ORDER BY {_HASH}) - 1) * 3 // count(*) OVER (PARTITION BY label))::INT AS stratum FROM labelled) GROUP BY ALL", _LABELS)
def _(spark, d):
    return sa.matched_strata(_labelled(spark, d), 3, [*KEY, "ds"], "label").groupBy("label", "stratum").agg(F.count(F.lit(1)).alias("n"))


@query("ag25_contingency", """SELECT round(sum((n - e) * (n - e) / e), 4) AS chi2, round(sum(n / t * ln(n * t / (a * b))), 6) AS mutual_information, round(sqrt(sum((n - e) * (n - e) / e) / (any_value(t) * least(any_value(ka), any_value(kb)))), 6) AS cramers_v
FROM (SELECT *, a * b / t AS e FROM (SELECT n::DOUBLE AS n, sum(n) OVER (PARTITION BY vendor)::DOUBLE AS a, sum(n) OVER (PARTITION BY stage)::DOUBLE AS b, sum(n) OVER ()::DOUBLE AS t, (SELECT count(DISTINCT vendor) - 1 FROM labelled) AS ka, (SELECT count(DISTINCT CASE WHEN r_9 >= 60 THEN 2 WHEN r_9 >= 20 THEN 1 ELSE 0 END) - 1 FROM labelled) AS kb
FROM (SELECT vendor, CASE WHEN r_9 >= 60 THEN 2 WHEN r_9 >= 20 THEN 1 ELSE 0 END AS stage, count(*) AS n FROM labelled GROUP BY ALL)))""", _LABELS)
def _(spark, d):
    return st.contingency(_labelled(spark, d).withColumn("stage", st.assign("r_9", [20.0, 60.0])), "vendor", "stage").select(F.round("chi2", 4).alias("chi2"), F.round("mutual_information", 6).alias("mutual_information"), F.round("cramers_v", 6).alias("cramers_v"))


@query("ag26_cell_counts", "SELECT stage, count(*) FILTER (label = 0) AS healthy, count(*) FILTER (label = 1) AS failing, count(*) AS total FROM (SELECT *, CASE WHEN r_9 >= 60 THEN 2 WHEN r_9 >= 20 THEN 1 ELSE 0 END AS stage FROM labelled) GROUP BY ROLLUP (stage)", _LABELS)
def _(spark, d):
    df = _labelled(spark, d).withColumn("stage", st.assign("r_9", [20.0, 60.0]))
    return df.rollup("stage").agg(F.count_if(F.col("label") == 0).alias("healthy"), F.count_if(F.col("label") == 1).alias("failing"), F.count(F.lit(1)).alias("total"))


@query("so6_pivot", "SELECT vendor, count(*) FILTER (label = 0) AS l0, count(*) FILTER (label = 1) AS l1 FROM labelled GROUP BY vendor", _LABELS)
def _(spark, d):
    return _labelled(spark, d).groupBy("vendor").pivot("label", [0, 1]).count().select("vendor", F.coalesce("0", F.lit(0)).alias("l0"), F.coalesce("1", F.lit(0)).alias("l1"))


@query("so3_common_models", "SELECT model FROM v WHERE dtf <= 0 INTERSECT SELECT model FROM labelled WHERE label = 1", _LABELS)
def _(spark, d):
    return panel(spark, d).filter(lb.days_to_failure() <= 0).select("model").intersect(_labelled(spark, d).filter("label = 1").select("model"))


@query("w9_equal_mass", "SELECT bin, count(*) AS n, min(r_9) AS lo, max(r_9) AS hi FROM (SELECT r_9, ntile(10) OVER (ORDER BY r_9, model, disk_id, ds) AS bin FROM labelled) GROUP BY bin", _LABELS)
def _(spark, d):
    return st.equal_mass(_labelled(spark, d), "r_9", [*KEY, "ds"], 10).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("r_9").alias("lo"), F.max("r_9").alias("hi"))


@query("w11_one_row_per_drive", f"SELECT model, disk_id, ds FROM (SELECT *, row_number() OVER (PARTITION BY model, disk_id ORDER BY {_HASH}) AS k FROM labelled) WHERE k = 1", _LABELS)
def _(spark, d):
    return sa.one_per_drive(_labelled(spark, d), KEY, [*KEY, "ds"]).select(*KEY, "ds")


@query("w7_average_rank", "SELECT model, disk_id, ds, rank() OVER (PARTITION BY vendor ORDER BY r_9) + (count(*) OVER (PARTITION BY vendor, r_9) - 1) / 2.0::DOUBLE AS r FROM labelled", _LABELS)
def _(spark, d):
    return _labelled(spark, d).select(*KEY, "ds", st.average_rank(F.col("r_9"), ["vendor"], ["r_9"]).alias("r"))


@query("w10_first_difference", "SELECT model, disk_id, ds, round(r_9 - lag(r_9) OVER (PARTITION BY model, disk_id ORDER BY ds), 6) AS step FROM panel", PANEL_SQL)
def _(spark, d):
    w = Window.partitionBy(*KEY).orderBy("ds")
    return panel(spark, d).select(*KEY, "ds", F.round(F.col("r_9") - F.lag("r_9").over(w), 6).alias("step"))
