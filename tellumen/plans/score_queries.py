"""Queries over scored windows and the feature matrix: metrics, weighted conformal, bootstraps, feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellumen.functions import scalars as sc
from tellumen.operators import bootstrap as bs
from tellumen.operators import conformal as cp
from tellumen.operators import ranking as fs
from tellumen.operators import weighted as wt
from tellumen.plans.registry import _cells, _coverage_sql, _parts, _sets, query
from tellumen.sources.fleet import _UD, SCORED_SQL, read, scored

IDS = ["l_orderkey", "l_linenumber", "drive"]
_ORDER = ", ".join(IDS)
_WEIGHT = "(1 + stage) / 4.0::DOUBLE"


def _weighted(spark, d):
    return scored(spark, d).withColumn("w", (1 + F.col("stage")) / F.lit(4.0))


@query("mt1_coverage", "SELECT round(avg((CASE WHEN y = 1 THEN set_f ELSE set_h END)::INT), 6) AS coverage FROM sets", _sets("split"))
def _(spark, d):
    cal, test = _parts(spark, d)
    return cp.coverage(cp.predict(test, cal, 0.1), []).select("coverage")


@query("mt4_group_coverage", _coverage_sql(["stage"]), _sets("both"))
def _(spark, d):
    cal, test = _parts(spark, d)
    return cp.coverage(cp.predict(test, cal, 0.1, "both"), ["stage"])


@query("mt6_weighted_auc", f"SELECT stage, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM (SELECT *, sum(neg) OVER (PARTITION BY stage ORDER BY p) - neg AS below FROM (SELECT stage, p, sum(CASE WHEN y = 1 THEN {_WEIGHT} ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN {_WEIGHT} ELSE 0 END) AS neg FROM scored GROUP BY ALL)) GROUP BY stage", SCORED_SQL)
def _(spark, d):
    return wt.weighted_auc(_weighted(spark, d), "w", ["stage"])


@query("mt7_average_precision", f"SELECT round(avg(tp / k), 6) AS ap FROM (SELECT y, row_number() OVER o AS k, sum(y) OVER o AS tp FROM scored WINDOW o AS (ORDER BY p DESC, {_ORDER} ROWS UNBOUNDED PRECEDING)) WHERE y = 1", SCORED_SQL)
def _(spark, d):
    return wt.average_precision(scored(spark, d), IDS)


@query("mt10_pick_threshold", """SELECT round(g, 6) AS threshold, round(f, 6) AS f_beta FROM (SELECT k, g, 1.25::DOUBLE * count(*) FILTER (p >= g AND y = 1) / (0.25::DOUBLE * any_value(a) + count(*) FILTER (p >= g)) AS f
FROM scored, (SELECT k, lo + k * (hi - lo) / 199 AS g, a FROM (SELECT min(p) AS lo, max(p) AS hi, sum(y) AS a FROM scored), (SELECT unnest(range(200)) AS k)) GROUP BY k, g) ORDER BY f DESC, k LIMIT 1""", SCORED_SQL)
def _(spark, d):
    return wt.pick_threshold(scored(spark, d))


@query("mt14_calibration_error", f"SELECT round(sum(n * abs(mp - r)) / sum(n), 6) AS ece FROM (SELECT bin, count(*) AS n, avg(p) AS mp, avg(y) AS r FROM (SELECT *, ntile(15) OVER (ORDER BY p, {_ORDER}) AS bin FROM scored) GROUP BY bin)", SCORED_SQL)
def _(spark, d):
    return wt.calibration_error(scored(spark, d), IDS)


@query("mt15_alert_budget", "SELECT round(any_value(t), 6) AS threshold, count(*) FILTER (p >= t) AS alerts, count(*) FILTER (p >= t AND y = 1) AS hits FROM sets, (SELECT min(CASE WHEN k = floor(spot) THEN p END) + (min(CASE WHEN k = ceil(spot) THEN p END) - min(CASE WHEN k = floor(spot) THEN p END)) * any_value(spot - floor(spot)) AS t FROM (SELECT p, row_number() OVER (ORDER BY p) - 1 AS k, (count(*) OVER () - 1) * (1 - (SELECT avg((set_f AND NOT set_h)::INT) FROM sets)) AS spot FROM sets))", _sets("class"))
def _(spark, d):
    cal, test = _parts(spark, d)
    s = cp.predict(test, cal, 0.1, "class")
    share = s.agg(F.avg((F.col("set_f") & ~F.col("set_h")).cast("double"))).first()[0] or 0.0
    t = F.broadcast(s.agg(F.percentile("p", F.lit(1 - share)).alias("t")))
    hit = F.col("p") >= F.col("t")
    return s.crossJoin(t).agg(F.round(F.first("t"), 6).alias("threshold"), F.count_if(hit).alias("alerts"), F.count_if(hit & (F.col("y") == 1)).alias("hits"))


@query("mt16_positive_quantile", "SELECT round(quantile_cont(p, 0.1), 6) AS threshold FROM scored WHERE part = 'cal' AND y = 1", SCORED_SQL)
def _(spark, d):
    return _parts(spark, d)[0].filter("y = 1").agg(F.round(F.percentile("p", F.lit(0.1)), 6).alias("threshold"))


@query("mt17_operating_points", "SELECT stage, count(*) FILTER (p >= 0.5) AS alerts, round(1000.0::DOUBLE * count(DISTINCT drive) FILTER (p >= 0.5) / count(DISTINCT drive), 4) AS alerts_per_1k, round(avg((p >= 0.5)::INT) FILTER (y = 1), 6) AS recall FROM scored GROUP BY stage", SCORED_SQL)
def _(spark, d):
    alert = F.col("p") >= 0.5
    return scored(spark, d).groupBy("stage").agg(F.count_if(alert).alias("alerts"), F.round(1000.0 * F.count_distinct(F.when(alert, F.col("drive"))) / F.count_distinct("drive"), 4).alias("alerts_per_1k"), F.round(F.avg(F.when(F.col("y") == 1, alert.cast("int"))), 6).alias("recall"))


_ALPHAS = [0.05, 0.1, 0.2]


def _alpha_sql(a: float) -> str:
    return f"SELECT {a}::DOUBLE AS alpha, * FROM (WITH {_sets('class').replace('0.9::DOUBLE', repr(1 - a) + '::DOUBLE')} {_coverage_sql(['stage'])})"


@query("mt18_alpha_sweep", " UNION ALL ".join(_alpha_sql(a) for a in _ALPHAS))
def _(spark, d):
    cal, test = _parts(spark, d)
    out = None
    for a in _ALPHAS:
        c = cp.coverage(cp.predict(test, cal, a, "class"), ["stage"]).withColumn("alpha", F.lit(a))
        out = c if out is None else out.unionByName(c)
    return out


_COMPOSITION = "round(100 * avg((set_h AND NOT set_f)::INT), 4) AS only_healthy, round(100 * avg((set_f AND NOT set_h)::INT), 4) AS only_failing, round(100 * avg((set_h AND set_f)::INT), 4) AS both_labels, round(100 * avg((NOT set_h AND NOT set_f)::INT), 4) AS no_label"


@query("ag27_set_composition", f"SELECT stage, {_COMPOSITION} FROM sets GROUP BY stage", _sets("class"))
def _(spark, d):
    cal, test = _parts(spark, d)
    return cp.composition(cp.predict(test, cal, 0.1, "class"), ["stage"])


@query("cp6_force_nonempty", "SELECT count(*) FILTER (NOT h AND NOT f) AS empties, count(*) FILTER (h) AS healthy, count(*) FILTER (f) AS failing FROM (SELECT set_h OR (NOT set_f AND 1 - (1 - p) <= 1 - p) AS h, set_f OR (NOT set_h AND NOT 1 - (1 - p) <= 1 - p) AS f FROM sets)", _sets("split"))
def _(spark, d):
    cal, test = _parts(spark, d)
    s = cp.predict(test, cal, 0.1, nonempty=True)
    return s.agg(F.count_if(~F.col("set_h") & ~F.col("set_f")).alias("empties"), F.count_if("set_h").alias("healthy"), F.count_if("set_f").alias("failing"))


@query("cp2_aps", f"SELECT stage, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN own ELSE 1 END - u * own), 6) AS mean_score FROM (SELECT *, CASE WHEN y = 1 THEN p ELSE 1 - p END AS own, {_UD.format(salt='7', key='l_orderkey::VARCHAR, l_linenumber::VARCHAR, drive::VARCHAR')} AS u FROM scored) GROUP BY stage", SCORED_SQL)
def _(spark, d):
    return scored(spark, d).groupBy("stage").agg(F.round(F.avg(wt.aps_true(sc.uniform(7, *IDS))), 6).alias("mean_score"))


_WQ = f"""{SCORED_SQL}, sw AS (SELECT *, {_WEIGHT} AS w FROM scored),
hist AS (SELECT s, sum(c) OVER (ORDER BY s) AS cum FROM (SELECT CASE WHEN y = 1 THEN 1 - p ELSE 1 - (1 - p) END AS s, sum(w) AS c FROM sw WHERE part = 'cal' GROUP BY ALL)),
q AS (SELECT w, min(s) AS qhat FROM (SELECT DISTINCT w FROM sw) JOIN hist ON cum >= 0.9::DOUBLE * ((SELECT sum(w) FROM sw WHERE part = 'cal') + w) GROUP BY w)"""


@query("cp11_weighted_sets", "SELECT stage, count(*) AS n, round(avg(qhat), 6) AS qhat, count(*) FILTER (1 - (1 - p) <= qhat) AS healthy, count(*) FILTER (1 - p <= qhat) AS failing FROM sw JOIN q USING (w) WHERE part = 'test' GROUP BY stage", _WQ)
def _(spark, d):
    df = _weighted(spark, d)
    s = wt.weighted_sets(df.filter("part = 'test'"), df.filter("part = 'cal'"), 0.1)
    return s.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("qhat"), 6).alias("qhat"), F.count_if("set_h").alias("healthy"), F.count_if("set_f").alias("failing"))


@query("cp12_density_ratio", "SELECT count(*) AS n, round(avg(w), 6) AS mean_w, round(avg((w <= 0.05 OR w >= 20)::INT), 6) AS clipped, round(sum(w) * sum(w) / sum(w * w), 3) AS ess FROM (SELECT least(greatest(q / (1 - q) * c / t, 0.05::DOUBLE), 20) AS w FROM (SELECT least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM scored), (SELECT count(*) FILTER (part = 'cal') AS c, count(*) FILTER (part = 'test') AS t FROM scored))", SCORED_SQL)
def _(spark, d):
    return wt.ratio_report(wt.density_ratio(scored(spark, d)))


_BOOT = """{n} AS (SELECT draw, drive, count(*) AS m FROM (SELECT draw, floor(('0x' || substr(md5(concat_ws('|', '{seed}', draw::VARCHAR, slot::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * n) AS code
 FROM (SELECT unnest(range({draws})) AS draw), (SELECT row_number() OVER (ORDER BY drive) - 1 AS slot, count(*) OVER () AS n FROM (SELECT DISTINCT drive FROM scored WHERE {where}))) JOIN (SELECT drive, row_number() OVER (ORDER BY drive) - 1 AS code FROM (SELECT DISTINCT drive FROM scored WHERE {where})) USING (code) GROUP BY ALL)"""
_RS2 = f"""{SCORED_SQL}, {_BOOT.format(n='mc', seed=42, draws=2000, where="part = 'cal'")}, {_BOOT.format(n='mt', seed=43, draws=2000, where="part = 'test'")},
sc AS (SELECT *, CASE WHEN y = 1 THEN 1 - p ELSE 1 - (1 - p) END AS s FROM scored),
q AS (SELECT draw, min(CASE WHEN cum >= ceil((n + 1) * 0.9::DOUBLE) THEN s END) AS qhat FROM (SELECT draw, s, sum(c) OVER (PARTITION BY draw ORDER BY s) AS cum, sum(c) OVER (PARTITION BY draw) AS n FROM (SELECT draw, s, sum(m) AS c FROM sc JOIN mc USING (drive) WHERE part = 'cal' GROUP BY ALL)) GROUP BY draw)"""


_RS2_DRAWS = "SELECT draw, round(qhat, 6) AS qhat, round(sum(CASE WHEN s <= qhat THEN m ELSE 0 END)::DOUBLE / sum(m), 6) AS coverage FROM sc JOIN mt USING (drive) JOIN q USING (draw) WHERE part = 'test' GROUP BY draw, qhat"


@query("rs2_cluster_bootstrap", _RS2_DRAWS, _RS2)
def _(spark, d):
    cal, test = _parts(spark, d)
    return bs.bootstrap_coverage(cal, test, 0.1).select("draw", F.round("qhat", 6).alias("qhat"), F.round("coverage", 6).alias("coverage"))


@query("rs2_interval", f"SELECT round(quantile_cont(coverage, 0.025), 5) AS lo, round(quantile_cont(coverage, 0.975), 5) AS hi, round(stddev_samp(coverage), 7) AS se, 0::BIGINT AS n_nan FROM ({_RS2_DRAWS})", _RS2)
def _(spark, d):
    cal, test = _parts(spark, d)
    draws = bs.bootstrap_coverage(cal, test, 0.1).select(F.round("coverage", 6).alias("coverage"))
    return wt.interval(draws, "coverage").withColumns({"lo": F.round("lo", 5), "hi": F.round("hi", 5), "se": F.round("se", 7)})


@query("rs4_sign_bootstrap", "SELECT draw, round((n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)), 6) AS r FROM (SELECT draw, sum(m)::DOUBLE AS n, sum(m * p) AS x, sum(m * y)::DOUBLE AS y, sum(m * p * p) AS xx, sum(m * y * y)::DOUBLE AS yy, sum(m * p * y) AS xy FROM scored JOIN mb USING (drive) GROUP BY draw)", f"{SCORED_SQL}, {_BOOT.format(n='mb', seed=42, draws=500, where='TRUE')}")
def _(spark, d):
    return wt.drive_correlation(scored(spark, d), "p", "y", 500).select("draw", F.round("r", 6).alias("r"))


_ONE = f"""{SCORED_SQL}, num AS (SELECT *, CASE WHEN y = 1 THEN 1 - p ELSE 1 - (1 - p) END AS s, row_number() OVER (PARTITION BY drive ORDER BY l_orderkey, l_linenumber, l_shipdate, p) - 1 AS k FROM scored),
pick AS (SELECT draw, drive, floor(('0x' || substr(md5(concat_ws('|', '9', draw::VARCHAR, drive::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * n) AS k FROM (SELECT drive, count(*) AS n FROM scored GROUP BY drive), (SELECT unnest(range(200)) AS draw)),
one AS (SELECT draw, num.* FROM pick JOIN num USING (drive, k)),
q AS (SELECT draw, coalesce(min(CASE WHEN cum >= ceil((n + 1) * 0.9::DOUBLE) THEN s END), 'inf'::DOUBLE) AS qhat FROM (SELECT draw, s, row_number() OVER (PARTITION BY draw ORDER BY s) AS cum, count(*) OVER (PARTITION BY draw) AS n FROM one WHERE part = 'cal') GROUP BY draw)"""


@query("rs3_one_window_per_drive", "SELECT draw, count(*) AS drives, round(any_value(qhat), 6) AS qhat, round(avg((s <= qhat)::INT), 6) AS coverage FROM one JOIN q USING (draw) WHERE part = 'test' GROUP BY draw", _ONE)
def _(spark, d):
    one = bs.one_window_draws(scored(spark, d), ["l_orderkey", "l_linenumber", "l_shipdate", "p"]).withColumn("s", cp.lac())
    q = cp.thresholds(one.filter("part = 'cal'"), 0.1, ["draw"]).drop("n")
    test = one.filter("part = 'test'").join(F.broadcast(q), "draw")
    return test.groupBy("draw").agg(F.count(F.lit(1)).alias("drives"), F.round(F.first("qhat"), 6).alias("qhat"), F.round(F.avg((F.col("s") <= F.col("qhat")).cast("int")), 6).alias("coverage"))


@query("ex8_stage_audit", _coverage_sql(["stage"]).replace("SELECT stage,", "SELECT coalesce(stage, -1) AS stage,").replace("GROUP BY stage", "GROUP BY GROUPING SETS ((), (stage))"), _sets("group"))
def _(spark, d):
    cal, test = _parts(spark, d)
    s = cp.predict(test, cal, 0.1, "group")
    return cp.coverage(s, ["stage"]).unionByName(cp.coverage(s, []).withColumn("stage", F.lit(-1)))


@query("ag22_weighted_rates", f"SELECT vendor, round(sum({_WEIGHT} * y) / sum({_WEIGHT}), 6) AS rate, round(sum({_WEIGHT} * p) / sum({_WEIGHT}), 6) AS mean_p FROM scored GROUP BY vendor", SCORED_SQL)
def _(spark, d):
    share = lambda c: F.round(F.sum(F.col("w") * F.col(c)) / F.sum("w"), 6)
    return _weighted(spark, d).groupBy("vendor").agg(share("y").alias("rate"), share("p").alias("mean_p"))


@query("ag29_pivot", "SELECT vendor, " + ", ".join(f"round(avg(p) FILTER (stage = {k}), 6) AS s{k}" for k in range(4)) + " FROM scored GROUP BY vendor", SCORED_SQL)
def _(spark, d):
    return scored(spark, d).groupBy("vendor").pivot("stage", [0, 1, 2, 3]).agg(F.round(F.avg("p"), 6)).toDF("vendor", "s0", "s1", "s2", "s3")


@query("mt20_interaction", "SELECT vendor, stage, count(*) AS n, round(avg(y), 6) AS rate FROM scored GROUP BY ALL HAVING count(*) >= 200", SCORED_SQL)
def _(spark, d):
    return scored(spark, d).groupBy("vendor", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("rate")).filter("n >= 200")


@query("rp3_half_width_ratio", "SELECT stage, round(sqrt(avg(y) * (1 - avg(y)) / count(*)) / any_value(se), 4) AS ratio FROM scored JOIN (SELECT stage, stddev_samp(m) / sqrt(count(*)) AS se FROM (SELECT stage, drive, avg(y) AS m FROM scored GROUP BY ALL) GROUP BY stage) USING (stage) GROUP BY stage", SCORED_SQL)
def _(spark, d):
    s = scored(spark, d)
    binom = s.groupBy("stage").agg(F.sqrt(F.avg("y") * (1 - F.avg("y")) / F.count(F.lit(1))).alias("b"))
    drive = s.groupBy("stage", "drive").agg(F.avg("y").alias("m")).groupBy("stage").agg((F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return binom.join(drive, "stage").select("stage", F.round(F.col("b") / F.col("se"), 4).alias("ratio"))


@query("rp6_number_audit", "SELECT DISTINCT x FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+\\.[0-9]+')) AS x FROM documents) WHERE x NOT IN (SELECT printf('%.2f', value) FROM events WHERE value IS NOT NULL)")
def _(spark, d):
    found = read(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0))).alias("x")).distinct()
    pool = read(spark, d, "events").filter("value IS NOT NULL").select(F.format_string("%.2f", "value").alias("x")).distinct()
    return found.join(pool, "x", "left_anti")


@query("pf14_scalars", "SELECT round(avg(ln(q / (1 - q))), 6) AS mean_logit, round(avg(1 / (1 + exp(-p))), 6) AS mean_sigmoid FROM (SELECT p, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM scored)", SCORED_SQL)
def _(spark, d):
    return scored(spark, d).agg(F.round(F.avg(sc.logit(F.col("p"))), 6).alias("mean_logit"), F.round(F.avg(sc.sigmoid(F.col("p"))), 6).alias("mean_sigmoid"))


@query("pf17_valid_scores", "SELECT count(*) AS n FROM scored WHERE p BETWEEN 0 AND 1 AND y IN (0, 1)", SCORED_SQL)
def _(spark, d):
    return scored(spark, d).filter(sc.valid_scores()).agg(F.count(F.lit(1)).alias("n"))


_LONG = "long AS (SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, i - 1 AS feature, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE embedding[i] IS NOT NULL)"
_MOMENTS = _LONG + """, mo AS (SELECT feature, stddev_pop(x) AS variance, abs(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y) + 1e-12)) AS correlation, abs(avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0)) AS gap, var_pop(x) FILTER (y = 0) + var_pop(x) FILTER (y = 1) AS vs FROM long GROUP BY feature),
au AS (SELECT feature, abs(round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)::DOUBLE), 6) - 0.5) AS auc FROM (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY x) - neg AS below FROM (SELECT feature, x, sum(y) AS pos, sum(1 - y) AS neg FROM long GROUP BY ALL)) GROUP BY feature),
cuts AS (SELECT feature, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM long GROUP BY feature),
jn AS (SELECT feature, len(list_filter(list_distinct(c), lambda e: e <= x)) AS bin, y, count(*)::DOUBLE AS n FROM long JOIN cuts USING (feature) GROUP BY ALL),
jt AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny FROM jn),
inf AS (SELECT feature, sum(n / t * ln(n * t / (nb * ny))) / (any_value(h) + 1e-12) AS information FROM jt JOIN (SELECT feature, sum(-s * ln(s)) AS h FROM (SELECT DISTINCT feature, y, ny / t AS s FROM jt) GROUP BY feature) USING (feature) GROUP BY feature),
sco AS (SELECT feature, ranker, round(score, 12) AS score FROM (SELECT feature, 'variance' AS ranker, variance AS score FROM mo UNION ALL SELECT feature, 'correlation', correlation FROM mo UNION ALL SELECT feature, 'mean_gap', gap / (sqrt(vs / 2) + 1e-12) FROM mo UNION ALL SELECT feature, 'auc', auc FROM au UNION ALL SELECT feature, 'information', information FROM inf)),
ra AS (SELECT feature, ranker, rank() OVER (PARTITION BY ranker ORDER BY score DESC) + (count(*) OVER (PARTITION BY ranker, score) - 1) / 2.0::DOUBLE AS r FROM sco),
sg AS (SELECT a.ranker, a.feature AS f, b.feature AS g, sign(a.r - b.r) AS s FROM ra a JOIN ra b ON a.ranker = b.ranker AND a.feature < b.feature),
ta AS (SELECT a.ranker AS a, b.ranker AS b, count(*) FILTER (a.s * b.s > 0) AS c, count(*) FILTER (a.s * b.s < 0) AS d, count(*) FILTER (a.s = 0) AS ta, count(*) FILTER (b.s = 0 AND a.s <> 0) AS tb FROM sg a JOIN sg b ON a.f = b.f AND a.g = b.g AND a.ranker < b.ranker GROUP BY ALL),
tau AS (SELECT a, b, coalesce((c - d) / nullif(sqrt((c + d + ta)::DOUBLE * (c + d + tb)), 0), 0) AS tau FROM ta),
con AS (SELECT feature, avg(r) AS mean_rank, row_number() OVER (ORDER BY avg(r), feature) AS place FROM ra GROUP BY feature)"""


def _long(spark, d):
    e = read(spark, d, "embeddings").withColumn("y", (F.col("label") == 0).cast("int"))
    return fs.long_features(e, "embedding", "y")


@query("fs1_moment_scores", "SELECT feature::INT AS feature, round(variance, 6) AS variance, round(correlation, 6) AS correlation, round(gap / (sqrt(vs / 2) + 1e-12), 6) AS mean_gap, round(gap * gap / (vs + 1e-12), 6) AS fisher FROM mo", _MOMENTS)
def _(spark, d):
    return fs.moment_scores(_long(spark, d)).select("feature", *[F.round(c, 6).alias(c) for c in ("variance", "correlation", "mean_gap", "fisher")])


@query("fs4_auc_scores", "SELECT feature::INT AS feature, round(auc, 6) AS auc FROM au", _MOMENTS)
def _(spark, d):
    return fs.auc_scores(_long(spark, d)).select("feature", F.round("auc", 6).alias("auc"))


@query("fs5_information_scores", "SELECT feature::INT AS feature, round(information, 6) AS information FROM inf", _MOMENTS)
def _(spark, d):
    return fs.information_scores(_long(spark, d)).select("feature", F.round("information", 6).alias("information"))


@query("fs6_kendall", "SELECT a, b, round(tau, 6) AS tau FROM tau", _MOMENTS)
def _(spark, d):
    return fs.kendall(fs.to_ranks(fs.scores(_long(spark, d)))).select("a", "b", F.round("tau", 6).alias("tau"))


@query("fs7_kept_rankers", """SELECT ranker, round(m, 6) AS agreement, m >= avg(m) OVER () - 2 * stddev_pop(m) OVER () OR row_number() OVER (ORDER BY m DESC, ranker) <= 2 AS kept FROM (SELECT a AS ranker, avg(tau) AS m FROM (SELECT a, tau FROM tau UNION ALL SELECT b, tau FROM tau) GROUP BY a)""", _MOMENTS)
def _(spark, d):
    return fs.kept_rankers(fs.kendall(fs.to_ranks(fs.scores(_long(spark, d))))).select("ranker", F.round("agreement", 6).alias("agreement"), "kept")


@query("fs8_consensus", "SELECT feature::INT AS feature, round(mean_rank, 4) AS mean_rank, place FROM con", _MOMENTS)
def _(spark, d):
    return fs.consensus(fs.to_ranks(fs.scores(_long(spark, d)))).select("feature", F.round("mean_rank", 4).alias("mean_rank"), "place")


@query("fs10_choose_prefix", "SELECT feature::INT AS feature, place FROM (SELECT *, min(CASE WHEN run >= 0.98::DOUBLE * best THEN place END) OVER () AS k FROM (SELECT *, max(run) OVER () AS best FROM (SELECT feature, place, sum(gap * gap / (vs + 1e-12)) OVER (ORDER BY place) AS run FROM con JOIN mo USING (feature)))) WHERE place <= k", _MOMENTS)
def _(spark, d):
    x = _long(spark, d)
    return fs.choose(fs.consensus(fs.to_ranks(fs.scores(x))), fs.moment_scores(x)).select("feature", "place")


@query("fs11_select_features")
def _(spark, d):
    return fs.select_features(_long(spark, d)).select("feature", "place")
