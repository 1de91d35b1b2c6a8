"""The recurrent model's kernels against slow versions: whole gradient, scores of texts, the vocabulary's cut, sums."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tellumen.llm import rnnlm
from tellumen.llm.common import summed


def _net(frequent=64, tail=5, seed=0):
    voc = rnnlm.Vocabulary(rnnlm.tx.HashIndex(np.zeros(0, np.uint64)), np.zeros(0), np.zeros(0, int), np.zeros((1, 2, 4)), np.zeros(1), 1.0, 1.0, 1.0, np.ones(tail), frequent)
    net, rng = rnnlm.Gru(voc), np.random.default_rng(seed)
    net.flat = rng.normal(0, 0.3, len(net.flat))
    net.p = net.views(net.flat)
    return net, rng


def _targets(net, rng, shape):
    cls = rng.integers(0, net.classes + net.tail, shape)
    word = np.where(cls < net.classes, cls * rnnlm.SIZE + rng.integers(0, rnnlm.SIZE, shape), -1)
    inp = np.where(cls < net.classes, word, net.frequent + cls - net.classes)
    return cls, word, np.concatenate([np.zeros_like(inp[:1]), inp[:-1]])


def _slow(net, inp, cls, word, live, h):
    """Log probability of the live places, step by step and row by row, without any kernel of the module."""
    total, (table, w, pc, bc, pw, bw) = 0.0, net.p
    n = rnnlm.HIDDEN
    h = h.copy()
    for t in range(len(inp)):
        for r in range(inp.shape[1]):
            x, g = table[inp[t, r]], h[r] @ w
            rr, z = 1 / (1 + np.exp(-(x[:n] + g[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + g[n : 2 * n])))
            cand = np.tanh(x[2 * n :] + rr * g[2 * n :])
            h[r] = (1 - z) * cand + z * h[r]
            if live[t, r]:
                logit = h[r] @ pc + bc
                total += logit[cls[t, r]] - np.log(np.exp(logit).sum())
                if word[t, r] >= 0:
                    at = slice(cls[t, r] * rnnlm.SIZE, (cls[t, r] + 1) * rnnlm.SIZE)
                    logit = pw[at] @ h[r] + bw[at]
                    total += logit[word[t, r] - at.start] - np.log(np.exp(logit).sum())
    return total


def test_whole_gradient():
    """Every layer's gradient through the recurrence, in double precision, against finite differences."""
    net, rng = _net()
    cls, word, inp = _targets(net, rng, (6, 3))
    live, h = np.arange(6)[:, None] < np.array([6, 4, 1]), rng.normal(0, 0.4, (3, rnnlm.HIDDEN))
    grad, _ = rnnlm.window_gradient(net, h, inp, cls, word, live)
    start = 0
    for shape in net.shapes:
        size = int(np.prod(shape))
        at = start + np.argsort(-np.abs(grad[start : start + size]))[:4]
        for i in [*at, *(start + rng.integers(0, size, 3))]:
            keep, slope = net.flat[i], 0.0
            for sign in (1, -1):
                net.flat[i] = keep + sign * 1e-5
                slope -= sign * _slow(net, inp, cls, word, live, h) / 2e-5
            net.flat[i] = keep
            assert np.isclose(slope, grad[i], rtol=1e-4, atol=1e-6), (shape, i)
        start += size


def test_scores_of_texts():
    net, rng = _net(seed=3)
    size = np.array([1, 70, 3, 3, 1, 20])
    runs = [_targets(net, rng, (n, 1)) for n in size]
    flat = [np.concatenate([r[k][:, 0] for r in runs]) for k in (2, 0, 1)]
    want = [_slow(net, r[2], r[0], r[1], np.ones((n, 1), bool), np.zeros((1, rnnlm.HIDDEN))) for r, n in zip(runs, size, strict=True)]
    for block, most in ((512, 4096), (2, 8), (3, 1)):
        assert np.allclose(rnnlm.score_group(net, *flat, np.cumsum(size) - size, size, block, most), want, rtol=1e-4)


def test_large_logits_need_the_row_maximum():
    net, rng = _net(seed=1)
    net.p[2][...] *= 400
    cls, word, _ = _targets(net, rng, 50)
    h = rng.normal(0, 1, (50, rnnlm.HIDDEN))
    got = net.log_prob(h, cls, word)
    assert np.isfinite(got).all() and not net.safe


def test_cut_of_the_vocabulary(spark):
    rng = np.random.default_rng(1)
    rows = [(int(h), int(c), 0) for h, c in zip(rng.integers(-(2**63), 2**63 - 1, 4000), rng.zipf(1.3, 4000).clip(max=10**6), strict=True)]
    df = spark.createDataFrame(rows, "h long, c long, sp long")
    for top in (1, 100, 1500, 4000, 9000):
        got = {(r.h, r.c) for r in rnnlm.most_frequent(df, top).collect()}
        rest = {(h, c) for h, c, _ in rows} - got
        assert min(top, 4000) * 0.98 - 2 <= len(got) <= top
        assert not got or not rest or min(c for _, c in got) * 1.05 >= max(c for _, c in rest)


def test_large_ids_beside_null(spark):
    big = 9007199254740993
    docs = spark.createDataFrame([(big, "a b", "en"), (None, "a c", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in rnnlm.language_model_scores(docs, top=64, frequent=32).collect()} == {big, None}


def test_sums(spark):
    def run(it):
        for _ in it:
            pass
        for part in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.array([part, 1.0]).tobytes()], pa.binary())], ["part", "body"])

    df = spark.range(0, 40, 1, 40).mapInArrow(run, "part int, body binary").withColumn("part", F.col("part"))
    got = {r.part: list(np.frombuffer(r.body)) for r in summed(df, fan_in=3).collect()}
    assert got == {0: [0.0, 40.0], 1: [40.0, 40.0]}
