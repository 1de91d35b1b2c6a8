"""Bootstraps over drives with thousands of draws: what a draw needs is a weighted sum over drives, so a drive's rows
are met once, with its multiplicities in all draws as a vector, instead of once a draw."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellumen.operators.conformal import lac
from tellumen.operators.weighted import multiplicities
from tellumen.session import materialised

BINS = 256


def per_drive(df: DataFrame, draws: int, seed: int) -> DataFrame:
    """drive, scores (array<struct<s, c>>, ascending), times (array<struct<draw, m>>): both are bounded by the drive's
    own rows and the number of draws."""
    scores = df.withColumn("s", lac()).filter("s IS NOT NULL AND NOT isnan(s)").groupBy("drive", "s").agg(F.count(F.lit(1)).alias("c"))
    scores = scores.groupBy("drive").agg(F.array_sort(F.collect_list(F.struct("s", "c"))).alias("scores"))
    times = multiplicities(df, draws, seed).groupBy("drive").agg(F.collect_list(F.struct("draw", "m")).alias("times"))
    return materialised(scores.join(times, "drive"), "boot-drives")


def _drives(it, draws: int):
    """(scores, counts, multiplicities by draw) of each drive."""
    for b in it:
        scores, times = b.column(b.schema.get_field_index("scores")), b.column(b.schema.get_field_index("times"))
        s, c = (scores.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
        d, m = (times.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
        sizes, counts = (np.concatenate([[0], np.cumsum([len(x) for x in col])]) for col in (scores, times))
        for k in range(b.num_rows):
            i, j = counts[k], counts[k + 1]
            yield s[sizes[k] : sizes[k + 1]], c[sizes[k] : sizes[k + 1]], np.bincount(d[i:j], weights=m[i:j], minlength=draws)


def _bodies(key, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), *[pa.array([x.tobytes() for x in a], pa.binary()) for a in arrays]], ["bin", "total", "lo", "hi"])


def _merged(rows: DataFrame) -> dict:
    """bin -> total, lo, hi: vectors of all tasks added up, or their least and greatest; at most BINS rows."""

    def add(t: pa.Table) -> pa.Table:
        vec = lambda c: np.stack([np.frombuffer(x.as_py()) for x in t.column(c)])
        return pa.Table.from_batches([_bodies(t.column("bin")[:1].to_pylist(), [vec("total").sum(axis=0)], [vec("lo").min(axis=0)], [vec("hi").max(axis=0)])])

    got = rows.groupBy("bin").applyInArrow(lambda t: add(t), "bin int, total binary, lo binary, hi binary").collect()
    return {r.bin: [np.frombuffer(x) for x in (r.total, r.lo, r.hi)] for r in got}


def draw_thresholds(drives: DataFrame, alpha: float, draws: int) -> np.ndarray:
    """The conformal threshold of each draw, exactly: the interval that holds it is cut into BINS parts, pass by pass
    over all drives, until it holds one score. Intervals of scores with few digits need two or three passes."""
    ends = drives.select(F.explode("scores").alias("x")).agg(F.min("x.s").alias("lo"), F.max("x.s").alias("hi")).first()
    if ends.lo is None:
        raise ValueError("no calibration scores")
    lo, hi = np.full(draws, ends.lo), np.full(draws, ends.hi)
    below, rank, out = np.zeros(draws), None, np.full(draws, np.nan)
    while np.isnan(out).any():
        spans, of = np.unique(np.stack([lo, hi]), axis=1, return_inverse=True)
        of = np.where(np.isnan(out), of.ravel(), -1)

        def run(it, spans=spans, of=of):
            total, least, most = np.zeros((BINS, draws)), np.full((BINS, spans.shape[1]), np.inf), np.full((BINS, spans.shape[1]), -np.inf)
            for s, c, m in _drives(it, draws):
                for k, (a, b) in enumerate(spans.T):
                    mine = of == k
                    x, n = s[(s >= a) & (s <= b)], c[(s >= a) & (s <= b)]
                    if len(x) and mine.any():
                        at = np.minimum(((x - a) * (BINS / (b - a) if b > a else 0.0)).astype(int), BINS - 1)
                        bins, start = np.unique(at, return_index=True)
                        total[np.ix_(bins, mine)] += np.add.reduceat(n, start)[:, None] * m[mine]
                        least[bins, k] = np.minimum(least[bins, k], x[start])
                        most[bins, k] = np.maximum(most[bins, k], np.maximum.reduceat(x, start))
            some = np.flatnonzero(np.isfinite(least).any(axis=1))
            yield _bodies(some, total[some], least[some], most[some])

        got = _merged(drives.select("scores", "times").mapInArrow(run, "bin int, total binary, lo binary, hi binary"))
        names = sorted(got)
        total, least, most = (np.stack([got[b][k] for b in names]) for k in range(3))
        if rank is None:
            n = total.sum(axis=0)
            rank = np.ceil((n + 1) * (1 - alpha))
            out[rank > n] = np.inf
        reach = below + np.cumsum(total, axis=0)
        for b in np.flatnonzero(np.isnan(out) & (of >= 0)):
            j = int(np.argmax(reach[:, b] >= rank[b]))
            below[b] = reach[j, b] - total[j, b]
            lo[b], hi[b] = least[j, of[b]], most[j, of[b]]
            if lo[b] == hi[b]:
                out[b] = lo[b]
    return out


def bootstrap_coverage(cal: DataFrame, test: DataFrame, alpha: float, draws: int = 2000, seed: int = 42) -> DataFrame:
    """draw, qhat, coverage: both parts resampled by drive, the threshold fitted again in each draw. One row a draw."""
    q = draw_thresholds(per_drive(cal, draws, seed), alpha, draws)

    def run(it):
        hit, n = np.zeros(draws), np.zeros(draws)
        for s, c, m in _drives(it, draws):
            reach = np.concatenate([[0], np.cumsum(c)])
            hit += m * reach[np.searchsorted(s, q, side="right")]
            n += m * reach[-1]
        yield _bodies([0], [np.stack([hit, n])], [np.zeros(1)], [np.zeros(1)])

    got = _merged(per_drive(test, draws, seed + 1).select("scores", "times").mapInArrow(run, "bin int, total binary, lo binary, hi binary"))
    hit, n = got[0][0].reshape(2, draws) if got else np.zeros((2, draws))
    rows = [(b, float(q[b]), float(hit[b] / n[b]) if n[b] else float("nan")) for b in range(draws)]
    return cal.sparkSession.createDataFrame(rows, "draw int, qhat double, coverage double")


def one_window_draws(df: DataFrame, keys: list[str], draws: int = 200, seed: int = 9) -> DataFrame:
    """draw and the row of one window of each drive in each draw: a drive's windows are numbered by keys, and a draw
    takes number floor(n u(seed, draw, drive)), so that rows are not copied once a draw."""
    from pyspark.sql import Window

    from tellumen.functions.scalars import uniform

    w = Window.partitionBy("drive")
    rows = df.withColumn("_k", F.row_number().over(w.orderBy(*keys)) - 1)
    n = df.groupBy("drive").agg(F.count(F.lit(1)).alias("_n"))
    picks = n.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = picks.select("drive", "draw", F.floor(uniform(seed, "draw", "drive") * F.col("_n")).alias("_k"))
    return picks.join(rows, ["drive", "_k"]).drop("_k")
