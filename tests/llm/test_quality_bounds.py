"""Quality thresholds against a brute-force version, where the n-gram bound is far below the trusted documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellumen.llm import quality


def test_thresholds_use_all_trusted_documents(spark):
    rng = np.random.default_rng(5)
    pool = {g: [f"{g}{k}" for k in range(300)] for g in ("en", "de", "xx")}
    rows = [(i, " ".join(rng.choice(pool[g], int(rng.integers(5, 40)))), g) for i, g in enumerate(["en"] * 1500 + ["de"] * 600 + ["xx"] * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    o = {r.doc_id: r.o for r in docs.select("doc_id", F.xxhash64("doc_id").alias("o")).collect()}
    fitted = {i for i in sorted(o, key=lambda i: (o[i], i))[:300] if o[i] % 5}
    got = {r.doc_id: r for r in quality.classify(docs, labels, fit_docs=300).collect()}
    assert len(got) == len(rows)
    for g in pool:
        held = [r for i, r in got.items() if i not in fitted and r.lang == g]
        assert len(held) >= 50
        logp, n = np.array([r.log10_prob for r in held]) * np.log(10), np.array([r.n_tokens for r in held])
        s = (logp + 20 * logp.sum() / n.sum()) / (n + 20)
        assert {round(r.threshold, 6) for r in held} == {round(float(np.exp(-np.quantile(s, 0.003))), 6)}


@pytest.mark.parametrize("whole", [10, 10**6])
def test_low_quantile_is_exact(spark, whole):
    x = np.random.default_rng(6).normal(size=30000)
    df = spark.createDataFrame([(float(v),) for v in x], "s double")
    assert quality._low_quantile(df, [], 0.003, whole).first().cut == pytest.approx(np.quantile(x, 0.003), abs=1e-12)
