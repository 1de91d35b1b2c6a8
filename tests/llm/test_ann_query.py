"""The query with its own parameters against brute force; repeated ids; routing at every size."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellumen.llm import ann


def recall(rows, got):
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    norm = np.sqrt((x * x).sum(axis=1))
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = (x * x[q]).sum(axis=1) / (norm * norm[q])
        s[q] = -2
        best = np.lexsort((ids, -s))[:5]
        mine = got[ids[q]]
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == 5
        assert all(abs(s[np.flatnonzero(ids == r.vec_id)[0]] - r.score) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hit, total = hit + len({r.vec_id for r in mine} & set(ids[best])), total + 5
    return hit / total


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_recall(spark, sf):
    got = collections.defaultdict(list)
    for r in sorted(ann.op10_ann(spark, f"/root/testdata/{sf}").collect(), key=lambda r: r.rank):
        got[r.query_id].append(r)
    assert recall(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect(), got) >= 0.9


def test_every_size_is_partitioned(monkeypatch, spark):
    seen = []
    fit = ann.fit_index
    monkeypatch.setattr(ann, "fit_index", lambda x, parts, goal, k: seen.append(parts) or fit(x, parts, goal, k))
    rng = np.random.default_rng(1)
    for n in (2, 60, 3000):
        df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(n)], "vec_id long, embedding array<double>")
        assert ann.nearest(df, F.col("vec_id") == 0).count() == min(5, n - 1)
    assert seen[0] == seen[1] == 2 and seen[2] > 8


def test_repeated_ids_are_one_candidate(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), *[(15, [1.0, 0.1 * k]) for k in range(8)], *[(k, [1.0, k / 10]) for k in range(1, 9)]]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, goal=1.0).collect()
    assert sorted(r.rank for r in got) == [1, 2, 3, 4, 5] and len({r.vec_id for r in got}) == 5
    assert min(got, key=lambda r: r.rank).vec_id == 15 and min(got, key=lambda r: r.rank).score == 1.0
