"""N-grams are counted on all trusted documents but the held-out fifth, however many there are."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models_brute import slow_kneser_ney

from tellumen.llm import quality


def test_all_trusted_documents_are_counted(spark):
    rng = np.random.default_rng(8)
    words = rng.integers(0, 400, (23_000, 4))
    rows = [(i, " ".join(f"w{k}" for k in words[i]), "en") for i in range(len(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = range(0, 22_500)
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int")
    o = {r.doc_id: r.o for r in docs.select("doc_id", F.xxhash64("doc_id").alias("o")).collect()}
    logp = slow_kneser_ney([rows[i][1] for i in trusted if o[i] % 5], 16384)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    for i in [*range(0, 22_500, 150), *range(22_500, 23_000, 5)]:
        assert math.isclose(got[i].log10_prob * math.log(10), logp(rows[i][1]), rel_tol=1e-5), i
    held = [got[i] for i in trusted if not o[i] % 5]
    lp, n = np.array([r.log10_prob for r in held]) * math.log(10), np.array([r.n_tokens for r in held])
    s = (lp + 20 * lp.sum() / n.sum()) / (n + 20)
    assert held[0].threshold == pytest.approx(math.exp(-np.quantile(s, 0.003)), rel=1e-6)


@pytest.mark.parametrize("k", [1, 7, 100, 999, 1500, 5000])
def test_most_frequent_is_exact(spark, k):
    c = np.random.default_rng(9).zipf(1.3, 2000).clip(1, 10**9)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(c)], "h long, c long").repartition(3)
    got = [r.h for r in quality._most_frequent(df, "h", k).collect()]
    assert got == sorted(range(len(c)), key=lambda i: (-c[i], i))[:k]


@pytest.mark.parametrize("most", [6, 12, 26])
def test_sieve_keeps_all_members(spark, most):
    df = spark.range(-3000, 3000).select(F.xxhash64("id").alias("o"), "id", F.lit("a text").alias("text"))
    inside = df.filter("id % 7 = 0")
    left = {r.id for r in quality._sifted(df, "o", quality._sieve(inside, "o", most)).collect()}
    assert left >= {i for i in range(-3000, 3000) if i % 7 == 0}
    assert most < 26 or len(left) < 1200
