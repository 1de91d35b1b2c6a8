"""Registry of the engine's queries and their SQL. Panel queries use horizon 5 and window 7 on the event panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellumen.operators import conformal as cp
from tellumen.operators import labels as lb
from tellumen.operators import panel as pn
from tellumen.operators import splits as sp
from tellumen.sources.fleet import FEATURES, PANEL_SQL, SCORED_SQL, missing, panel, read, scored

QUERIES: dict = {}
SQL: dict = {}
H, W, MIN = 5, 7, 5

_LABELS = f"""{PANEL_SQL},
v AS (SELECT *, substr(model, 2, 1) AS vendor, date_diff('day', ds, failure_time) AS dtf FROM panel),
a AS (SELECT *, coalesce(dtf <= 0, FALSE) AS post, max(CASE WHEN NOT coalesce(dtf <= 0, FALSE) THEN ds END) OVER (PARTITION BY model, disk_id) AS last FROM v),
b AS (SELECT *, CASE WHEN post THEN 'post_failure' WHEN dtf IS NULL AND date_diff('day', ds, last) < {H} THEN 'unobservable' END AS r1 FROM a),
c AS (SELECT *, count(CASE WHEN r1 IS NULL THEN 1 END) OVER (PARTITION BY model, disk_id) AS kept FROM b),
reasons AS (SELECT *, CASE WHEN r1 IS NULL AND kept < {MIN} THEN 'short_history' ELSE r1 END AS reason, CASE WHEN coalesce(dtf > 0 AND dtf <= {H}, FALSE) THEN 1 ELSE 0 END AS label FROM c),
labelled AS (SELECT * FROM reasons WHERE reason IS NULL),
drives AS (SELECT model, disk_id, min(vendor) AS vendor, max(label) AS drive_label, count(*) AS n_rows, min(ds) AS first_ds, max(ds) AS last_ds FROM labelled GROUP BY model, disk_id)"""


def query(name: str, sql: str | None = None, base: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (f"WITH {base} " if base else "") + sql
        return f

    return add


def _labelled(spark, d):
    return lb.build_labels(panel(spark, d), H, MIN)


def _drives(spark, d):
    return lb.drive_table(_labelled(spark, d))


@query("pf1_vendor", "SELECT model, substr(model, 2, 1) AS vendor, count(*) AS n FROM panel GROUP BY model", PANEL_SQL)
def _(spark, d):
    return panel(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n")).select("model", lb.vendor().alias("vendor"), "n")


@query("pf2_calendar_days", "SELECT model, disk_id, ds, date_diff('day', ds, failure_time) AS dtf FROM panel", PANEL_SQL)
def _(spark, d):
    return panel(spark, d).select("model", "disk_id", "ds", lb.days_to_failure().alias("dtf"))


@query("pf4_fractional_days", "SELECT event_id, round((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(ts)) / 86400000000.0::DOUBLE, 6) AS days FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.round((F.unix_micros(F.lit("2026-01-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(86400e6), 6).alias("days"))


@query("pf7_missing", "SELECT sum(CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END)::BIGINT AS n_missing, count(*) AS n FROM events")
def _(spark, d):
    return read(spark, d, "events").agg(F.sum(missing("value").cast("int")).alias("n_missing"), F.count(F.lit(1)).alias("n"))


@query("ts1_build_labels", "SELECT model, disk_id, ds, vendor, dtf, label FROM labelled", _LABELS)
def _(spark, d):
    return _labelled(spark, d).select("model", "disk_id", "ds", "vendor", "dtf", "label")


@query("ag1_drive_table", "SELECT * FROM drives", _LABELS)
def _(spark, d):
    return _drives(spark, d)


@query("ag2_label_summary", """SELECT vendor, count(*) AS drives, sum(f)::BIGINT AS failing, sum(n)::BIGINT AS n_rows, sum(pos)::BIGINT AS positives, round(100.0::DOUBLE * sum(pos) / sum(n), 4) AS pct_positive
FROM (SELECT vendor, model, disk_id, count(*) AS n, sum(label) AS pos, max(label) AS f FROM labelled GROUP BY ALL) GROUP BY vendor""", _LABELS)
def _(spark, d):
    return lb.label_summary(_labelled(spark, d))


@query("ag16_label_stats", """SELECT count(*) AS n_in, count(*) FILTER (reason = 'post_failure') AS n_post_failure, count(*) FILTER (reason = 'unobservable') AS n_unobservable, count(*) FILTER (reason = 'short_history') AS n_short_history,
count(*) FILTER (reason IS NULL) AS n_out, coalesce(sum(label) FILTER (reason IS NULL), 0)::BIGINT AS n_pos, count(DISTINCT (model, disk_id)) FILTER (reason IS NULL) AS n_drives FROM reasons""", _LABELS)
def _(spark, d):
    return lb.label_stats(panel(spark, d), H, MIN)


@query("ag4_right_censored", "SELECT count(*) AS n FROM (SELECT max(ds) AS last FROM panel GROUP BY model, disk_id) WHERE last < (SELECT max(ds) FROM panel)", PANEL_SQL)
def _(spark, d):
    last = panel(spark, d).groupBy("model", "disk_id").agg(F.max("ds").alias("last"))
    return last.crossJoin(F.broadcast(last.agg(F.max("last").alias("end")))).agg(F.count_if(F.col("last") < F.col("end")).alias("n"))


@query("ag6_vendor_profile", """SELECT substr(model, 2, 1) AS vendor, count(DISTINCT disk_id) AS drives, count(DISTINCT disk_id) FILTER (failure_time IS NOT NULL) AS failed, count(*) AS n_rows, min(ds) AS first_ds, max(ds) AS last_ds FROM panel GROUP BY ALL""", PANEL_SQL)
def _(spark, d):
    return panel(spark, d).groupBy(lb.vendor().alias("vendor")).agg(F.count_distinct("disk_id").alias("drives"), F.count_distinct(F.when(F.col("failure_time").isNotNull(), F.col("disk_id"))).alias("failed"), F.count(F.lit(1)).alias("n_rows"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))


@query("ag7_availability", "SELECT substr(model, 2, 1) AS vendor, " + ", ".join(f"round(1 - avg(CASE WHEN {c} IS NULL OR isnan({c}) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS {c}" for c in FEATURES) + " FROM panel GROUP BY ALL", PANEL_SQL)
def _(spark, d):
    return panel(spark, d).groupBy(lb.vendor().alias("vendor")).agg(*[F.round(1 - F.avg(missing(c).cast("double")), 6).alias(c) for c in FEATURES])


@query("ag9_boundary", "SELECT count(*) FILTER (dtf = 0) AS n_zero, count(*) FILTER (dtf < 0) AS n_after, count(*) FILTER (dtf > 0) AS n_before, count(*) FILTER (dtf IS NULL) AS n_null, min(dtf)::INT AS lo, max(dtf)::INT AS hi FROM v", _LABELS)
def _(spark, d):
    t = F.col("dtf")
    return panel(spark, d).select(lb.days_to_failure().alias("dtf")).agg(F.count_if(t == 0).alias("n_zero"), F.count_if(t < 0).alias("n_after"), F.count_if(t > 0).alias("n_before"), F.count_if(t.isNull()).alias("n_null"), F.min(t).alias("lo"), F.max(t).alias("hi"))


@query("ag15_duplicate_keys", "SELECT count(*) - count(DISTINCT (model, disk_id, ds)) AS n FROM panel", PANEL_SQL)
def _(spark, d):
    return panel(spark, d).agg((F.count(F.lit(1)) - F.count_distinct(F.struct("model", "disk_id", "ds"))).alias("n"))


def _assign(strata: str, cuts: list[tuple[str, float]], last: str, source: str) -> str:
    case = " ".join(f"WHEN k <= round_even({f!r}::DOUBLE * n, 0) THEN '{p}'" for p, f in cuts)
    return f"""(SELECT *, CASE {case} ELSE '{last}' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY md5(concat_ws('|', '42', model, disk_id::VARCHAR))) AS k, count(*) OVER (PARTITION BY {strata}) AS n FROM {source}))"""


_STANDARD = _assign("model, drive_label", [("test", 0.2), ("cal", 0.2 + 0.8 * 0.2)], "train", "drives")
_FOLDS = """(SELECT d.*, f.fold FROM drives d CROSS JOIN (SELECT DISTINCT {c} AS fold FROM drives) f WHERE d.{c} {op} f.fold)"""
_LOMO = f"(SELECT model, disk_id, vendor, fold, part FROM {_assign('fold, model, drive_label', [('cal', 0.2)], 'train', _FOLDS.format(c='vendor', op='<>'))} UNION ALL SELECT model, disk_id, vendor, fold, 'test' FROM {_FOLDS.format(c='vendor', op='=')})"


@query("sp2_standard_split", f"SELECT model, disk_id, part FROM {_STANDARD}", _LABELS)
def _(spark, d):
    return sp.standard_split(_drives(spark, d)).select("model", "disk_id", "part")


@query("sp3_lomo_splits", f"SELECT model, disk_id, fold, part FROM {_LOMO}", _LABELS)
def _(spark, d):
    return sp.held_out_splits(_drives(spark, d), "vendor", ["model", "drive_label"]).select("model", "disk_id", "fold", "part")


@query("sp4_lomm_splits", f"SELECT model, disk_id, fold, part FROM {_assign('fold, drive_label', [('cal', 0.2)], 'train', _FOLDS.format(c='model', op='<>'))} UNION ALL SELECT model, disk_id, fold, 'test' FROM {_FOLDS.format(c='model', op='=')}", _LABELS)
def _(spark, d):
    return sp.held_out_splits(_drives(spark, d), "model", ["drive_label"]).select("model", "disk_id", "fold", "part")


@query("sp7_validate", f"""SELECT fold, sum(leaked)::BIGINT AS n_leaked, sum(outside)::BIGINT AS n_outside, sum(t)::BIGINT AS n_test, sum(c)::BIGINT AS n_cal, count(*) FILTER (parts > 1) AS n_overlaps
FROM (SELECT fold, model, disk_id, count(*) FILTER (vendor = fold AND part <> 'test') AS leaked, count(*) FILTER (vendor <> fold AND part = 'test') AS outside, count(*) FILTER (part = 'test') AS t, count(*) FILTER (part = 'cal') AS c, count(DISTINCT part) AS parts FROM {_LOMO} GROUP BY ALL) GROUP BY fold""", _LABELS)
def _(spark, d):
    return sp.violations(sp.held_out_splits(_drives(spark, d), "vendor", ["model", "drive_label"]), "vendor")


@query("sp8_split_report", f"SELECT part, count(*) AS drives, sum(drive_label)::BIGINT AS positives, string_agg(DISTINCT vendor, ',' ORDER BY vendor) AS vendors FROM {_STANDARD} GROUP BY part", _LABELS)
def _(spark, d):
    return sp.split_report(sp.standard_split(_drives(spark, d)))


_DENSE = _LABELS + """,
e AS (SELECT *, coalesce(lead(ds) OVER (PARTITION BY model, disk_id ORDER BY ds), ds + 1) AS nxt, """ + " + ".join(f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 0 ELSE 1 END" for c in FEATURES) + f""" AS there,
  {", ".join(f"last_value(CASE WHEN isnan({c}) THEN NULL ELSE {c} END IGNORE NULLS) OVER (PARTITION BY model, disk_id ORDER BY ds ROWS UNBOUNDED PRECEDING) AS f_{c}" for c in FEATURES)} FROM labelled),
dense AS (SELECT model, disk_id, vendor, CAST(day AS DATE) AS ds, CASE WHEN day = ds THEN label ELSE -1 END AS label, CASE WHEN day = ds THEN there / {len(FEATURES)}.0::DOUBLE ELSE 0 END AS present, {", ".join(f"coalesce(f_{c}, 0) AS {c}" for c in FEATURES)}
  FROM (SELECT *, unnest(generate_series(ds, nxt - 1, INTERVAL 1 DAY)) AS day FROM e)),
wp AS (SELECT *, row_number() OVER (PARTITION BY model, disk_id ORDER BY ds) - 1 AS pos FROM dense),
wf AS (SELECT *, avg(present) OVER fr AS presence, {", ".join(f"avg({c}) OVER fr AS {c}_mean, stddev_pop({c}) OVER fr AS {c}_std, min({c}) OVER fr AS {c}_min, max({c}) OVER fr AS {c}_max, {c} - first_value({c}) OVER fr AS {c}_delta, regr_slope({c}, pos) OVER fr AS {c}_slope" for c in FEATURES)}
  FROM wp WINDOW fr AS (PARTITION BY model, disk_id ORDER BY ds ROWS {W - 1} PRECEDING)),
win AS (SELECT * FROM wf WHERE pos >= {W - 1} AND label >= 0 AND presence >= 0.5)"""


def _windows(spark, d):
    return pn.windows(pn.densify(_labelled(spark, d), FEATURES), FEATURES, W)


@query("ts2_densify", f"SELECT model, disk_id, ds, label, round(present, 6) AS present, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM dense", _DENSE)
def _(spark, d):
    return pn.densify(_labelled(spark, d), FEATURES).select("model", "disk_id", "ds", "label", *[F.round(c, 6).alias(c) for c in ("present", *FEATURES)])


_STATS = [f"{c}_{s}" for c in FEATURES for s in ("mean", "std", "min", "max", "delta", "slope")]


@query("ts3_make_windows", "SELECT model, disk_id, vendor, ds AS end_ds, label AS y, round(presence, 6) AS presence FROM win", _DENSE)
def _(spark, d):
    return _windows(spark, d).select("model", "disk_id", "vendor", "end_ds", "y", F.round("presence", 6).alias("presence"))


@query("ts12_flatten_stats", f"SELECT model, disk_id, ds AS end_ds, {', '.join(f'round({c}::DECIMAL(24, 9), 4)::DOUBLE + 0 AS {c}' for c in _STATS)} FROM win", _DENSE)
def _(spark, d):
    return _windows(spark, d).select("model", "disk_id", "end_ds", *[(F.round(F.round(c, 9), 4) + 0).alias(c) for c in _STATS])


@query("ts16_quantile_stages", "SELECT vendor, round(quantile_cont(r_9, 0.25), 6) AS e1, round(quantile_cont(r_9, 0.5), 6) AS e2, round(quantile_cont(r_9, 0.75), 6) AS e3 FROM labelled GROUP BY vendor", _LABELS)
def _(spark, d):
    q = F.percentile("r_9", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return _labelled(spark, d).groupBy("vendor").agg(q.alias("q")).select("vendor", *[F.round(F.col("q")[k], 6).alias(f"e{k + 1}") for k in range(3)])


def _cells(cells: list[str]) -> str:
    cols = ", ".join(cells)
    by = f"PARTITION BY {cols}" if cells else ""
    lead = f"{cols}, " if cells else ""
    return f"""SELECT {lead}max(n) AS n, min(CASE WHEN cum >= ceil((n + 1) * 0.9::DOUBLE) THEN s END) AS qhat FROM (SELECT {lead}s, sum(c) OVER ({by} ORDER BY s) AS cum, sum(c) OVER ({by}) AS n FROM
(SELECT {lead}CASE WHEN y = 1 THEN 1 - p ELSE 1 - (1 - p) END AS s, count(*) AS c FROM scored WHERE part = 'cal' GROUP BY ALL)){" GROUP BY " + cols if cells else ""}"""


def _sets(by: str) -> str:
    """CTE `sets` for one kind of conformal predictor at alpha 0.1."""
    allq = f"q AS ({_cells([])})"
    if by == "split":
        return f"{SCORED_SQL}, {allq}, sets AS (SELECT t.*, 1 - (1 - p) <= q.qhat AS set_h, 1 - p <= q.qhat AS set_f, FALSE AS fallback FROM scored t, q WHERE part = 'test')"
    cells = {"class": ["y"], "group": ["stage"], "both": ["stage", "y"]}[by]
    on = lambda a, k: " AND ".join(f"{a}.{c} = " + (str(k) if c == "y" else f"t.{c}") for c in cells)
    return f"{SCORED_SQL}, {allq}, t1 AS ({_cells(cells)}), sets AS (SELECT t.*, 1 - (1 - p) <= coalesce(h.qhat, q.qhat) AS set_h, 1 - p <= coalesce(f.qhat, q.qhat) AS set_f, h.qhat IS NULL OR f.qhat IS NULL AS fallback FROM scored t CROSS JOIN q LEFT JOIN t1 h ON {on('h', 0)} LEFT JOIN t1 f ON {on('f', 1)} WHERE part = 'test')"


def _coverage_sql(groups: list[str]) -> str:
    lead = "".join(f"{g}, " for g in groups)
    return f"""SELECT {lead}count(*) AS n, round(avg(hit), 6) AS coverage, round(avg(CASE WHEN y = 0 THEN hit END), 6) AS coverage_healthy, round(avg(CASE WHEN y = 1 THEN hit END), 6) AS coverage_failure, round(avg(size), 6) AS mean_size, round(avg((size = 0)::INT), 6) AS empty_rate, round(avg((size = 2)::INT), 6) AS doubleton_rate, round(avg(fallback::INT), 6) AS fallback_rate
FROM (SELECT *, (CASE WHEN y = 1 THEN set_f ELSE set_h END)::INT AS hit, set_h::INT + set_f::INT AS size FROM sets) {"GROUP BY " + ", ".join(groups) if groups else ""}"""


def _parts(spark, d):
    s = scored(spark, d)
    return s.filter("part = 'cal'"), s.filter("part = 'test'")


@query("cp4_quantile", _cells([]).replace("SELECT max(n)", "SELECT max(n)::BIGINT", 1), SCORED_SQL)
def _(spark, d):
    return cp.thresholds(_parts(spark, d)[0], 0.1, [])


@query("cp10_cell_report", f"SELECT stage, y, n::BIGINT AS n, qhat FROM ({_cells(['stage', 'y'])})", SCORED_SQL)
def _(spark, d):
    return cp.thresholds(_parts(spark, d)[0], 0.1, ["stage", "y"])


for _name, _by in (("cp5_split", "split"), ("cp7_mondrian_class", "class"), ("cp8_mondrian_group", "group"), ("cp9_mondrian_both", "both")):

    @query(_name, _coverage_sql(["vendor", "stage"]), _sets(_by))
    def _(spark, d, by=_by):
        cal, test = _parts(spark, d)
        return cp.coverage(cp.predict(test, cal, 0.1, by), ["vendor", "stage"])


@query("mt3_coverage_report", _coverage_sql([]), _sets("split"))
def _(spark, d):
    cal, test = _parts(spark, d)
    return cp.coverage(cp.predict(test, cal, 0.1), [])


_AUC = """SELECT {g}round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)::DOUBLE), 6) AS auc FROM (SELECT *, coalesce(sum(neg) OVER ({by} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {g}p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY ALL)) {end}"""


@query("mt5_auc", _AUC.format(g="", by="", end=""), SCORED_SQL)
def _(spark, d):
    return cp.auc(scored(spark, d), [])


@query("rp4_auc_by_stage", _AUC.format(g="stage, ", by="PARTITION BY stage", end="GROUP BY stage"), SCORED_SQL)
def _(spark, d):
    return cp.auc(scored(spark, d), ["stage"])


_CONFUSION = """SELECT {g}tp, fp, fn, tn, round(coalesce(pr, 0), 6) AS precision, round(coalesce(rc, 0), 6) AS recall, round(coalesce(1.25::DOUBLE * pr * rc / nullif(0.25 * pr + rc, 0), 0), 6) AS f_beta FROM (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS pr, tp::DOUBLE / nullif(tp + fn, 0) AS rc FROM
(SELECT {g}count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM {t} {end}))"""


@query("mt8_confusion", _CONFUSION.format(g="stage, ", t="scored", end="GROUP BY stage"), SCORED_SQL)
def _(spark, d):
    return cp.confusion(scored(spark, d), 0.5, ["stage"])


@query("mt12_drive_level", _CONFUSION.format(g="", t="(SELECT drive, max(p) AS p, max(y) AS y FROM scored GROUP BY drive)", end=""), SCORED_SQL)
def _(spark, d):
    return cp.confusion(cp.drive_level(scored(spark, d)), 0.5, [])


@query("mt13_calibration", """SELECT stage, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg(p), 6) AS mean_pred, round(avg(y), 6) AS obs_rate FROM (SELECT *, least(greatest(p, 1e-12), 1 - 1e-12) AS q FROM scored) GROUP BY stage""", SCORED_SQL)
def _(spark, d):
    return cp.calibration(scored(spark, d), ["stage"])


@query("rs1_cluster_se", "SELECT stage, count(*) AS drives, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS se FROM (SELECT stage, drive, avg(p) AS m FROM scored GROUP BY ALL) GROUP BY stage", SCORED_SQL)
def _(spark, d):
    return cp.cluster_se(scored(spark, d), F.col("p"), ["stage"])


@query("ag23_grouping_battery", "SELECT vendor, stage, count(*) AS n, round(avg(p), 6) AS mean_p FROM scored GROUP BY GROUPING SETS ((), (stage), (vendor), (vendor, stage))", SCORED_SQL)
def _(spark, d):
    return scored(spark, d).groupingSets([[], ["stage"], ["vendor"], ["vendor", "stage"]], "vendor", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


@query("ag28_alerts", "SELECT count(DISTINCT drive) AS drives, count(DISTINCT drive) FILTER (p >= 0.9) AS alerting FROM scored", SCORED_SQL)
def _(spark, d):
    return scored(spark, d).agg(F.count_distinct("drive").alias("drives"), F.count_distinct(F.when(F.col("p") >= 0.9, F.col("drive"))).alias("alerting"))
