"""Windows scaled by their own first steps, against numpy."""

import numpy as np
from pyspark.sql import functions as F

from tellumen.operators.scaling import self_scaled, self_scaled_last


def _slow(x, head=5, eps=1e-8):
    centre = np.median(x[:head])
    mad, sd = np.median(np.abs(x[:head] - centre)), x.std()
    return (x - centre) / (mad if mad > eps else sd if sd > eps else 1.0)


def test_self_scaled(spark):
    rng = np.random.default_rng(1)
    rows = [rng.normal(size=n).round(2) for n in (1, 2, 5, 6, 7, 30)]
    rows += [np.full(7, 3.0), np.array([1.0, 1, 1, 1, 1, 9, 4]), np.array([2.0, 2, 2, 2, 8])]
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(rows)], "k int, w array<double>")
    got = {r.k: r for r in df.select("k", self_scaled(F.col("w")).alias("whole"), self_scaled_last(F.col("w")).alias("last")).collect()}
    for k, x in enumerate(rows):
        assert np.allclose(got[k].whole, _slow(x))
        assert np.isclose(got[k].last, _slow(x)[-1])
