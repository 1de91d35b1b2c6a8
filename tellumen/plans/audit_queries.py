"""Queries of audits: conformal edge cases, full reports, stage holdouts, manifests, sweeps, frame helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellumen.functions import frames as fr
from tellumen.functions import scalars as sc
from tellumen.operators import conformal as cp
from tellumen.operators import labels as lb
from tellumen.operators import panel as pn
from tellumen.operators import ranking as fs
from tellumen.operators import scaling as ts
from tellumen.operators import splits as sp
from tellumen.operators import stages as st
from tellumen.operators import weighted as wt
from tellumen.plans.panel_queries import _CELLS, _cells
from tellumen.plans.registry import _DENSE, _LABELS, _STANDARD, W, _assign, _cells as _cell_sql, _coverage_sql, _drives, _labelled, _parts, _sets, query
from tellumen.plans.score_queries import _MOMENTS, IDS, _long
from tellumen.sources import telemetry as tm
from tellumen.sources.fleet import FEATURES, KEY, PANEL_SQL, SCORED_SQL, panel, scored

# ---- conformal prediction where cells are missing or small

_LESS = {"cp7_missing_class": ("class", "y = 0"), "cp8_unseen_group": ("group", "stage <> 2"), "cp9_missing_cell": ("both", "NOT (stage = 2 AND y = 1)")}

for _name, (_by, _keep) in _LESS.items():
    for _spare in ("pooled", "inf"):
        _sql = _sets(_by).replace("part = 'cal'", f"part = 'cal' AND {_keep}")
        if _spare == "inf" or _by == "class":
            _sql = _sql.replace("q.qhat) AS", "'inf'::DOUBLE) AS")

        @query(_name + ("_inf" if _spare == "inf" else ""), _coverage_sql(["stage"]), _sql)
        def _(spark, d, by=_by, keep=_keep, spare=_spare):
            cal, test = _parts(spark, d)
            return cp.coverage(cp.predict(test, cal.filter(keep), 0.1, by, fallback=spare), ["stage"])


_SMALL = f"{SCORED_SQL}, t AS ({_cell_sql(['l_orderkey']).replace('0.9::DOUBLE', '0.7::DOUBLE')})"


@query("cp4_small_cells", "SELECT n::BIGINT AS n, count(*) AS cells, count(*) FILTER (qhat IS NULL) AS infinite, round(avg(qhat), 6) AS mean_finite FROM t GROUP BY n", _SMALL)
def _(spark, d):
    t = cp.thresholds(_parts(spark, d)[0], 0.3, ["l_orderkey"])
    finite = F.when(F.col("qhat") < float("inf"), F.col("qhat"))
    return t.groupBy("n").agg(F.count(F.lit(1)).alias("cells"), F.count_if(finite.isNull()).alias("infinite"), F.round(F.avg(finite), 6).alias("mean_finite"))


# ---- whole reports

_RATES = ("empirical_coverage", "coverage_healthy", "coverage_failure", "avg_set_size", "singleton_rate", "doubleton_rate", "empty_rate", "qhat", "fallback_rate")


def _report_sql(by: str) -> str:
    q = "(SELECT qhat FROM q)" if by == "split" else "(SELECT median(qhat) FROM t1)"
    n = "(SELECT max(n) FROM q)" if by == "split" else "(SELECT sum(n) FROM t1)"
    name = {"split": "split", "group": "mondrian_stage"}.get(by, f"mondrian_{by}")
    return f"""SELECT * FROM (WITH {_sets(by)} SELECT 0.1::DOUBLE AS alpha, 0.9::DOUBLE AS target_coverage, round(avg(hit), 6) AS empirical_coverage, round(avg(hit) FILTER (y = 0), 6) AS coverage_healthy, round(avg(hit) FILTER (y = 1), 6) AS coverage_failure,
round(avg(size), 6) AS avg_set_size, round(avg((size = 1)::INT), 6) AS singleton_rate, round(avg((size = 2)::INT), 6) AS doubleton_rate, round(avg((size = 0)::INT), 6) AS empty_rate, round({q}, 6) AS qhat, {n}::BIGINT AS n_cal, count(*) AS n_test, count(*) FILTER (y = 1) AS n_failures_test, 'lac' AS score_fn, '{name}' AS method, round(avg(fallback::INT), 6) AS fallback_rate
FROM (SELECT *, (CASE WHEN y = 1 THEN set_f ELSE set_h END)::INT AS hit, set_h::INT + set_f::INT AS size FROM sets))"""


def _four(spark, d, f):
    """f(sets, cal, by) of the four methods, one below the other."""
    cal, test = _parts(spark, d)
    out = None
    for by in cp.METHODS:
        one = f(cp.predict(test, cal, 0.1, by), cal, by)
        out = one if out is None else out.unionByName(one)
    return out


@query("mt3_report", " UNION ALL ".join(_report_sql(by) for by in cp.METHODS))
def _(spark, d):
    return _four(spark, d, lambda s, cal, by: cp.report(s, cal, 0.1, by)).withColumns({c: F.round(c, 6) for c in _RATES})


@query("cp15_set_properties", "SELECT stage, labels, count(*) AS n, sum(singleton::INT)::BIGINT AS singletons FROM (SELECT stage, concat_ws(',', CASE WHEN set_h THEN '0' END, CASE WHEN set_f THEN '1' END) AS labels, set_h <> set_f AS singleton FROM sets) GROUP BY ALL", _sets("both"))
def _(spark, d):
    cal, test = _parts(spark, d)
    s = cp.properties(cp.predict(test, cal, 0.1, "both"))
    labels = F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels")
    return s.groupBy("stage", labels).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("singleton").cast("int")).alias("singletons"))


@query("cp17_set_check", "SELECT count(*) AS n, count(*) FILTER (a.set_h <> b.set_h OR a.set_f <> b.set_f) AS differing FROM sets a JOIN (SELECT l_orderkey, l_linenumber, drive, l_shipdate, p, 1 - (1 - p) <= qhat AS set_h, 1 - p <= qhat AS set_f FROM scored, q WHERE part = 'test') b USING (l_orderkey, l_linenumber, drive, l_shipdate)", _sets("class"))
def _(spark, d):
    cal, test = _parts(spark, d)
    return cp.check_sets(cp.predict(test, cal, 0.1, "class"), cp.predict(test, cal, 0.1), [*IDS, "l_shipdate"])


@query("hl5_four_methods", " UNION ALL ".join(f"SELECT '{by}' AS method, * FROM (WITH {_sets(by)} {_coverage_sql(['stage'])})" for by in cp.METHODS))
def _(spark, d):
    return _four(spark, d, lambda s, cal, by: cp.coverage(s, ["stage"]).withColumn("method", F.lit(by)))


@query("mt19_set_sizes", " UNION ALL ".join(f"SELECT '{by}' AS method, * FROM (WITH {_sets(by)} SELECT set_h::INT + set_f::INT AS size, count(*) AS n, count(*) FILTER (y = 1) AS failing FROM sets GROUP BY ALL)" for by in cp.METHODS))
def _(spark, d):
    sizes = lambda s, cal, by: cp.properties(s).groupBy(F.col("set_size").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("failing")).withColumn("method", F.lit(by))
    return _four(spark, d, sizes)


@query("rp2_claims", "SELECT bool_and(coverage >= 0.88::DOUBLE) AS all_reach, max(abs(coverage - 0.9::DOUBLE)) <= 0.1::DOUBLE AS within, round(max(abs(coverage - 0.9::DOUBLE)), 6) AS worst FROM (SELECT stage, avg((CASE WHEN y = 1 THEN set_f ELSE set_h END)::INT) AS coverage FROM sets GROUP BY stage)", _sets("group"))
def _(spark, d):
    cal, test = _parts(spark, d)
    c = F.col("coverage")
    gap = F.max(F.abs(c - 0.9))
    return cp.coverage(cp.predict(test, cal, 0.1, "group"), ["stage"]).agg(F.every(c >= 0.88).alias("all_reach"), (gap <= 0.1).alias("within"), F.round(gap, 6).alias("worst"))


_CONF = "count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS fn"


@query("mt11_fleet_metrics", f"""SELECT 0.5::DOUBLE AS threshold, c.tp::BIGINT AS tp, c.fp::BIGINT AS fp, c.fn::BIGINT AS fn, c.tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(1.25::DOUBLE * tp / (1.25::DOUBLE * tp + fp + 0.25::DOUBLE * fn), 6) AS f_beta, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
(SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)::DOUBLE), 6) FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY ALL))) AS auc,
(SELECT round(avg(hits / k), 6) FROM (SELECT y, row_number() OVER o AS k, sum(y) OVER o AS hits FROM scored WINDOW o AS (ORDER BY p DESC, {", ".join(IDS)}, l_shipdate ROWS UNBOUNDED PRECEDING)) WHERE y = 1) AS avg_precision, prevalence
FROM (SELECT {_CONF}, count(*) FILTER (p < 0.5 AND y = 0) AS tn, round(avg(y), 6) AS prevalence FROM scored) c""", SCORED_SQL)
def _(spark, d):
    return cp.fleet_metrics(scored(spark, d), 0.5, keys=[*IDS, "l_shipdate"])


@query("mt17_operating_table", f"""SELECT stage, n_windows, n_drives, prevalence, alerts_per_1k_drives, conformal_cov_failure, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(1.25::DOUBLE * tp / (1.25::DOUBLE * tp + fp + 0.25::DOUBLE * fn), 4) AS f_beta
FROM (SELECT stage, count(*) AS n_windows, count(DISTINCT drive) AS n_drives, round(avg(y), 5) AS prevalence, round(1000.0::DOUBLE * count(DISTINCT drive) FILTER (p >= 0.5) / count(DISTINCT drive), 1) AS alerts_per_1k_drives, round(avg(set_f::INT) FILTER (y = 1), 4) AS conformal_cov_failure, {_CONF} FROM sets GROUP BY stage)""", _sets("split"))
def _(spark, d):
    cal, test = _parts(spark, d)
    return cp.operating_points(cp.predict(test, cal, 0.1), 0.5, ["stage"])


_ALPHA3 = (0.05, 0.1, 0.2)


@query("ex10_within_vendor_audit", " UNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, * FROM (WITH {_sets('split').replace('0.9::DOUBLE', repr(1 - a) + '::DOUBLE')}, g AS (SELECT vendor, stage, count(*) AS n, count(*) FILTER (y = 1) AS n_fail, avg(set_f::INT) FILTER (y = 1) AS c FROM sets GROUP BY ALL) SELECT vendor, sum(n)::BIGINT AS n, bool_and(n_fail >= 30) AS reliable, round(arg_max(c, stage) - arg_min(c, stage), 6) AS trend FROM g GROUP BY vendor)" for a in _ALPHA3))
def _(spark, d):
    cal, test = _parts(spark, d)
    out = None
    for a in _ALPHA3:
        g = cp.predict(test, cal, a).groupBy("vendor", "stage").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("n_fail"), F.avg(F.when(F.col("y") == 1, F.col("set_f").cast("double"))).alias("c"))
        trend = F.round(F.max_by("c", "stage") - F.min_by("c", "stage"), 6).alias("trend")
        one = g.groupBy("vendor").agg(F.sum("n").alias("n"), F.every(F.col("n_fail") >= 30).alias("reliable"), trend).withColumn("alpha", F.lit(a))
        out = one if out is None else out.unionByName(one)
    return out


# ---- windows, stages, holdouts

@query("ts3_strided", "SELECT model, disk_id, ds AS end_ds, label AS y FROM win WHERE (pos - 6) % CASE WHEN label = 1 THEN 2 ELSE 3 END = 0", _DENSE)
def _(spark, d):
    w = pn.windows(pn.densify(_labelled(spark, d), FEATURES), FEATURES, W, stride=3, positive_stride=2)
    return w.select(*KEY, "end_ds", "y")


def _aged(spark, d):
    c = [*FEATURES, "r_9"]
    return st.window_age(ts.cells(pn.densify(_labelled(spark, d), c), W).filter("kept"))


_AGED = _CELLS + ", aged AS (SELECT c.model, c.disk_id, c.ds, c.label, l.r_9 AS age FROM cells c JOIN labelled l USING (model, disk_id, ds) WHERE c.kept)"


@query("ts15_window_age", "SELECT model, disk_id, ds, age FROM aged", _AGED)
def _(spark, d):
    return _aged(spark, d).select(*KEY, "ds", "age")


@query("ts20_fit_stages", "SELECT stage::INT AS stage, count(*) AS n, sum(label)::BIGINT AS positives, round(avg(label), 6) AS rate FROM (SELECT label, len(list_filter(e, lambda x: x <= age)) AS stage FROM aged, (SELECT list_distinct(quantile_cont(age, [0.2, 0.4, 0.6, 0.8])) AS e FROM aged)) GROUP BY stage", _AGED)
def _(spark, d):
    w = _aged(spark, d)
    edges = st.fit_stages(w, "age", "label", [*KEY, "ds"], "quantile", 5)
    return st.stage_table(w, "age", "label", edges).drop("name").filter("n > 0")


@query("ts16_distinct_edges", "SELECT vendor, unnest(list_sort(list_distinct(quantile_cont(r_2, [0.2, 0.4, 0.6, 0.8])))) AS edge FROM labelled GROUP BY vendor", _LABELS)
def _(spark, d):
    return st.quantile_edges(_labelled(spark, d), "r_2", 5, ["vendor"]).select("vendor", F.explode("edges").alias("edge"))


@query("ts18_one_split", "SELECT k::INT AS cut, round(l / (k + 0.0), 6) AS left_rate FROM (SELECT a.bin AS k, sum(b.rate) FILTER (b.bin <= a.bin) AS l, sum(b.rate) AS t FROM curve a, curve b WHERE a.bin BETWEEN 5 AND 55 GROUP BY a.bin) ORDER BY round(l * l / k + (t - l) * (t - l) / (60 - k), 12) DESC, k LIMIT 1", _LABELS + ", curve AS (SELECT bin, avg(label) AS rate FROM (SELECT label, ntile(60) OVER (ORDER BY r_9, model, disk_id, ds) AS bin FROM labelled) GROUP BY bin)")
def _(spark, d):
    import numpy as np

    curve = st.failure_curve(_labelled(spark, d), "r_9", "label", [*KEY, "ds"], 60).orderBy("bin").collect()
    rate = np.array([r.rate for r in curve], float)
    rows = [(int(k), round(float(rate[:k].mean()), 6)) for k in st.binary_segment(rate, 1)]
    return spark.createDataFrame(rows, "cut int, left_rate double")


@query("ts24_subset", "SELECT model, disk_id, ds FROM cells WHERE kept AND disk_id % 4 = 1", _CELLS)
def _(spark, d):
    return _cells(spark, d).filter("kept").filter("disk_id % 4 = 1").select(*KEY, "ds")


@query("ts9_drop_features", "SELECT model, disk_id, end_ds, y, round(r_1_mean, 4) + 0 AS r_1_mean FROM (SELECT *, ds AS end_ds, label AS y FROM win)", _DENSE)
def _(spark, d):
    w = pn.windows(pn.densify(_labelled(spark, d), FEATURES), FEATURES, W)
    return fr.drop_features(w, ["n_1", "n_2", "r_2"]).select(*KEY, "end_ds", "y", (F.round(F.round("r_1_mean", 9), 4) + 0).alias("r_1_mean"))


_STAGED = "CASE WHEN r_9 >= 60 THEN 2 WHEN r_9 >= 20 THEN 1 ELSE 0 END"
_HELD = _LABELS + f""", modal AS (SELECT model, disk_id, stage FROM (SELECT *, row_number() OVER (PARTITION BY model, disk_id ORDER BY n DESC, stage) AS k FROM (SELECT model, disk_id, {_STAGED} AS stage, count(*) AS n FROM labelled GROUP BY ALL)) WHERE k = 1),
fold AS (SELECT m.*, f.fold FROM modal m CROSS JOIN (SELECT DISTINCT stage AS fold FROM modal) f),
held AS (SELECT model, disk_id, fold, part FROM {_assign('fold', [('cal', 0.2)], 'train', '(SELECT * FROM fold WHERE stage <> fold)')} UNION ALL SELECT model, disk_id, fold, 'test' FROM fold WHERE stage = fold)"""


def _held(spark, d):
    df = _labelled(spark, d).withColumn("stage", st.assign("r_9", [20.0, 60.0]))
    return sp.stage_splits(st.modal_stage(df, KEY))


@query("sp10_drive_disjoint_stages", "SELECT model, disk_id, fold, part FROM held", _HELD)
def _(spark, d):
    return _held(spark, d).select(*KEY, "fold", "part")


@query("sp10_usable_folds", "SELECT fold, coalesce(sum(label) FILTER (part = 'test'), 0)::BIGINT AS test_pos, coalesce(sum(label) FILTER (part = 'cal'), 0)::BIGINT AS cal_pos, coalesce(sum(label) FILTER (part = 'test'), 0) >= 20 AND coalesce(sum(label) FILTER (part = 'cal'), 0) >= 10 AS usable FROM held JOIN labelled USING (model, disk_id) GROUP BY fold", _HELD)
def _(spark, d):
    return sp.usable_folds(_held(spark, d), _labelled(spark, d))


@query("sp11_stage_manifest", "SELECT model, disk_id, " + ", ".join(f"max(part) FILTER (fold = {k}) AS part_{k}" for k in range(3)) + " FROM held GROUP BY model, disk_id", _HELD)
def _(spark, d):
    return sp.widened(_held(spark, d), [0, 1, 2])


@query("sp13_population_split", f"SELECT vendor, model, disk_id, part FROM {_assign('vendor, model, drive_label', [('test', 0.2), ('cal', 0.2 + 0.8 * 0.2)], 'train', 'drives')}", _LABELS)
def _(spark, d):
    parts = sp.stratified(_drives(spark, d), [("test", 0.2), ("cal", 0.8 * 0.2), ("train", 1.0)], ["vendor", "model", "drive_label"], 42)
    return parts.select("vendor", *KEY, "part")


_MANIFEST = _LABELS + f", man AS (SELECT p.model, p.disk_id, failed, s.part, l.model IS NOT NULL AS in_labelled FROM (SELECT model, disk_id, bool_or(failure_time IS NOT NULL) AS failed FROM panel GROUP BY ALL) p LEFT JOIN (SELECT DISTINCT model, disk_id FROM labelled) l USING (model, disk_id) LEFT JOIN {_STANDARD} s USING (model, disk_id))"


def _manifest(spark, d):
    return sp.manifest(panel(spark, d), _labelled(spark, d), sp.standard_split(_drives(spark, d)))


@query("sp14_sample_manifest", "SELECT model, disk_id, failed, in_labelled, part FROM man", _MANIFEST)
def _(spark, d):
    return _manifest(spark, d).select(*KEY, "failed", "in_labelled", "part")


@query("sp14_fingerprints", "SELECT part, count(*) AS n, sum(failed::INT)::BIGINT AS failed, substr(sha1(string_agg(concat_ws(':', model, disk_id::VARCHAR), '|' ORDER BY concat_ws(':', model, disk_id::VARCHAR))), 1, 12) AS print FROM man WHERE in_labelled GROUP BY part", _MANIFEST)
def _(spark, d):
    return _manifest(spark, d).filter("in_labelled").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("int")).alias("failed"), sc.fingerprint(*KEY).alias("print"))


@query("j4_infinite_dtf", "SELECT c.model, c.disk_id, c.ds, coalesce(v.dtf::DOUBLE, 'inf'::DOUBLE) AS dtf FROM cells c LEFT JOIN v USING (model, disk_id, ds)", _CELLS)
def _(spark, d):
    return lb.attach_dtf(_cells(spark, d).select(*KEY, "ds"), panel(spark, d))


_VENDORS, _MODELS, _WAYS = ["A", "B", "C"], ["random_forest", "gbm", "logistic"], ["split", "class", "both"]
_JOBS = "jobs AS (SELECT * FROM (SELECT unnest(['A', 'B', 'C']) AS fold), (SELECT unnest(['random_forest', 'gbm', 'logistic']) AS model), (SELECT unnest(['split', 'class', 'both']) AS method)), done AS (SELECT fold, model, method FROM jobs JOIN (SELECT DISTINCT vendor FROM labelled WHERE label = 1) ON vendor = fold WHERE model <> 'gbm')"


@query("io20_pending_jobs", "SELECT concat_ws('__', fold, model, method) AS cell FROM jobs ANTI JOIN done USING (fold, model, method)", f"{_LABELS}, {_JOBS}")
def _(spark, d):
    jobs = spark.range(1)
    for c, v in (("fold", _VENDORS), ("model", _MODELS), ("method", _WAYS)):
        jobs = jobs.withColumn(c, F.explode(F.array(*[F.lit(x) for x in v])))
    seen = _labelled(spark, d).filter("label = 1").select(F.col("vendor").alias("fold")).distinct()
    done = jobs.join(seen, "fold").filter("model <> 'gbm'")
    return tm.pending(jobs, done, ["fold", "model", "method"]).select(F.concat_ws("__", "fold", "model", "method").alias("cell"))


# ---- sweeps, best rows, checks of frames

@query("ag24_sweep_summary", "SELECT vendor, count(m) AS n, round(avg(m), 6) AS mean, round(min(m), 6) AS least, round(max(m), 6) AS greatest FROM (SELECT vendor, drive, avg(p) AS m FROM scored GROUP BY ALL) GROUP BY vendor", SCORED_SQL)
def _(spark, d):
    per = scored(spark, d).groupBy("vendor", "drive").agg(F.avg("p").alias("m"))
    return fr.summary(per, ["vendor"], "m").withColumns({c: F.round(c, 6) for c in ("mean", "least", "greatest")})


_STAGES = SCORED_SQL + ", g AS (SELECT vendor, stage, count(*) AS n, round(avg(y), 6) AS rate FROM scored GROUP BY ALL)"


def _by_stage(spark, d):
    return scored(spark, d).groupBy("vendor", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("rate"))


@query("w12_oldest_stage", "SELECT vendor, stage, n, rate FROM (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY stage DESC) AS k FROM g) WHERE k = 1", _STAGES)
def _(spark, d):
    return fr.best_row(_by_stage(spark, d), ["vendor"], F.col("stage"))


@query("sl2_best_row", "SELECT vendor, stage, n, rate FROM g ORDER BY n DESC, vendor, stage LIMIT 1", _STAGES)
def _(spark, d):
    return fr.best_row(_by_stage(spark, d), [], F.col("n"), -F.ascii("vendor"), -F.col("stage"))


@query("sl5_head", "SELECT vendor, stage, n FROM g ORDER BY vendor, stage LIMIT 5", _STAGES)
def _(spark, d):
    return _by_stage(spark, d).select("vendor", "stage", "n").orderBy("vendor", "stage").limit(5)


@query("pf20_verdict", "SELECT vendor, stage, CASE WHEN n >= 500 THEN 'OK' WHEN n >= 100 THEN 'THIN' ELSE 'TOO FEW' END AS verdict FROM g", _STAGES)
def _(spark, d):
    return _by_stage(spark, d).select("vendor", "stage", fr.verdict(F.col("n")).alias("verdict"))


@query("pf8_existing_columns", "SELECT disk_id, ds, r_1 FROM panel", PANEL_SQL)
def _(spark, d):
    return fr.existing(panel(spark, d), ["disk_id", "no_such", "ds", "r_1", "r_77"])


@query("pf12_row_statistics", "SELECT model, disk_id, ds, round((n_1 + r_1 + n_2) / 3, 6) AS mean, greatest(n_1, r_1, n_2) AS hi FROM panel", PANEL_SQL)
def _(spark, d):
    return panel(spark, d).select(*KEY, "ds", F.round(sc.row_mean("n_1", "r_1", "n_2"), 6).alias("mean"), sc.row_max("n_1", "r_1", "n_2").alias("hi"))


_EDGES = [0.1, 0.25, 0.25, 0.5, 0.9]


@query("pf15_searchsorted", "SELECT p, count(*) AS n, len(list_filter([0.1, 0.25, 0.25, 0.5, 0.9], lambda e: e <= p))::INT AS at_right, len(list_filter([0.1, 0.25, 0.25, 0.5, 0.9], lambda e: e < p))::INT AS at_left FROM scored GROUP BY p", SCORED_SQL)
def _(spark, d):
    e = F.array(*[F.lit(x) for x in _EDGES])
    side = lambda right: sc.searchsorted(e, F.col("p"), right=right, bits=3)
    return scored(spark, d).groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", "n", side(True).alias("at_right"), side(False).alias("at_left"))


@query("pf16_zero_missing", "SELECT round(sum(CASE WHEN isfinite(x) THEN x ELSE 0 END), 4) AS total, count(*) FILTER (NOT coalesce(isfinite(x), FALSE)) AS zeroed FROM (SELECT CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE ELSE value END AS x FROM events)")
def _(spark, d):
    from tellumen.sources.fleet import read

    k = F.col("event_id") % 5
    x = F.when(k == 1, float("nan")).when(k == 2, float("inf")).when(k != 0, F.col("value"))
    z = sc.zero_missing(x)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return read(spark, d, "events").agg(F.round(F.sum(z), 4).alias("total"), F.count_if(bad).alias("zeroed"))


@query("hl13_drive_codes", "SELECT drive, dense_rank() OVER (ORDER BY drive) - 1 AS code FROM (SELECT DISTINCT drive FROM scored)", SCORED_SQL)
def _(spark, d):
    return st.numbered(scored(spark, d).select("drive").distinct(), "drive", []).select("drive", (F.col("_k") - 1).alias("code"))


@query("sl6_capped_prefix", "SELECT feature::INT AS feature, place FROM con WHERE place <= least(3, (SELECT min(CASE WHEN run >= 0.98::DOUBLE * best THEN place END) FROM (SELECT *, max(run) OVER () AS best FROM (SELECT place, sum(gap * gap / (vs + 1e-12)) OVER (ORDER BY place) AS run FROM con JOIN mo USING (feature)))))", _MOMENTS)
def _(spark, d):
    x = _long(spark, d)
    return fs.choose(fs.consensus(fs.to_ranks(fs.scores(x))), fs.moment_scores(x), most=3).select("feature", "place")


@query("cp3_aps_candidates", "SELECT stage, round(avg(CASE WHEN p <= 0.5 THEN 1 - p ELSE 1 END - u * (1 - p)), 6) AS healthy, round(avg(CASE WHEN p > 0.5 THEN p ELSE 1 END - u * p), 6) AS failing FROM (SELECT *, ('0x' || substr(md5(concat_ws('|', '8', l_orderkey::VARCHAR, l_linenumber::VARCHAR, drive::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM scored) GROUP BY stage", SCORED_SQL)
def _(spark, d):
    u = sc.uniform(8, *IDS)
    return scored(spark, d).groupBy("stage").agg(F.round(F.avg(wt.aps_candidate(u, 0)), 6).alias("healthy"), F.round(F.avg(wt.aps_candidate(u, 1)), 6).alias("failing"))
