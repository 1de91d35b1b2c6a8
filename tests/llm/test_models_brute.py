"""The n-gram model and the positive-unlabelled learner against slow versions."""

import collections
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tellumen.llm import quality, toxicity
from tellumen.llm import textops as tx


def _discounts(counts):
    n = [max(1, sum(c == k for c in counts)) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [0.0, *(min(max(x, 0), m) for x, m in zip(d, (0.95, 1.9, 2.8)))]


def slow_kneser_ney(train, vocab):
    """log probability of a text by the interpolated modified Kneser-Ney bigram, from its definition."""
    words = collections.Counter(w for t in train for w in t.split())
    key = {w: int(tx.signed(tx.Words(pa.array([w])).hash)[0]) for w in words}
    known = set(sorted(words, key=lambda w: (-words[w], key[w]))[:vocab])
    sym = lambda w: w if w in known else None
    pairs = collections.Counter((u, w) for t in train for u, w in zip(["<s>", *map(sym, t.split())], map(sym, t.split())))
    d = _discounts(pairs.values())
    total, mass, cont = collections.Counter(), collections.Counter(), collections.Counter()
    for (u, w), c in pairs.items():
        total[u] += c
        mass[u] += d[min(c, 3)]
        cont[w] += 1
    e, n = _discounts(cont.values()), sum(cont.values())
    left = sum(min(c, e[min(c, 3)]) for c in cont.values()) / n

    def low(w):
        return max(cont[w] - e[min(cont[w], 3)], 0) / n + left / (len(known) + 1)

    def logp(text):
        out, u = 0.0, "<s>"
        for w in map(sym, text.split()):
            p = low(w)
            if total[u]:
                c = pairs[u, w]
                p = max(c - d[min(c, 3)], 0) / total[u] + mass[u] / total[u] * p
            if w is None:
                p /= max(1, len(words) - len(known)) + 1
            out, u = out + math.log(p), w
        return out

    return logp


def test_kneser_ney(spark):
    rng = np.random.default_rng(2)
    share = 1 / np.arange(1, 301)
    rows = [(i, " ".join(f"w{k}" for k in rng.choice(300, int(rng.integers(1, 60)), p=share / share.sum())), "en") for i in range(300)] + [(900, "w1 never w2 seen", "en"), (901, "new", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    o = {r.doc_id: r.o for r in docs.select("doc_id", F.xxhash64("doc_id").alias("o")).collect()}
    train = [t for i, t, _ in rows if i < 200 and o[i] % 5]
    for vocab, hot in ((100, 50), (10_000, 1), (100, 100_000)):
        logp = slow_kneser_ney(train, vocab)
        for r in quality.classify(docs, labels, vocab=vocab, hot=hot).collect():
            text = dict((i, t) for i, t, _ in rows)[r.doc_id]
            assert math.isclose(r.log10_prob * math.log(10), logp(text), rel_tol=1e-5), (vocab, r.doc_id)
            assert math.isclose(r.perplexity, math.exp(-logp(text) / r.n_tokens), rel_tol=1e-4) and r.kept == (r.shrunk_perplexity <= r.threshold)


def test_small_languages_blend(spark):
    """Between no documents and `least` of its own, a language's threshold moves from the pooled one to its own."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"{g}{k}" for k in rng.integers(0, 50, 30)), g) for i, g in enumerate(["en"] * 800 + ["xx"] * 60 + ["yy"] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, g in rows if g != "yy"], "doc_id long, quality int, toxic int")
    cut = lambda least: {r.lang: r.threshold for r in quality.classify(docs, labels, least=least).collect()}
    own, some, none = cut(1), cut(20), cut(10**9)
    assert none["xx"] != own["xx"] and min(none["xx"], own["xx"]) < some["xx"] < max(none["xx"], own["xx"])
    assert len({own["yy"], own["xx"], own["en"]}) == 3


def _sets(rng, n, m):
    return toxicity.Sparse([np.unique(rng.integers(0, m, rng.integers(0, 6))) for _ in range(n)])


def test_risk_and_gradient():
    """Both parts from dense matrices, and the gradient of what a step descends, by finite differences."""
    rng = np.random.default_rng(6)
    seen = set()
    for trial in range(12):
        xp, xu = _sets(rng, 20, 8), _sets(rng, 50, 8)
        w, prior = rng.normal(0, 1, 9), 0.3
        if trial % 2:
            # P apart from U: the second part of the risk is negative.
            xp = toxicity.Sparse([np.append(0, 1 + k % 7) for k in range(20)])
            xu = toxicity.Sparse([np.array([1 + k % 7]) for k in range(50)])
            w[0], w[8] = 14.0, -6.0

        def parts(w):
            dense = lambda x: np.array([[*((x.row == r) & (x.flat == f)).any(keepdims=True)] for r in range(x.n) for f in range(8)], float).reshape(x.n, 8)
            zp, zu = dense(xp) @ w[:8] + w[8], dense(xu) @ w[:8] + w[8]
            loss = lambda z: np.log1p(np.exp(-z)).mean()
            return prior * loss(zp), loss(-zu) - prior * loss(-zp)

        a, b, g = toxicity.risk(xp, xu, w, prior)
        assert np.allclose((a, b), parts(w))
        seen.add(bool(b >= 0))
        goal = lambda w: sum(parts(w)) if b >= 0 else -parts(w)[1]
        step = [(goal(w + 1e-6 * e) - goal(w - 1e-6 * e)) / 2e-6 for e in np.eye(9)]
        assert np.allclose(g, step, atol=1e-6)
    assert seen == {True, False}


def _corpus(rng, n):
    rows, toxic = [], set()
    for i in range(n):
        words = [f"w{k}" for k in rng.zipf(1.5, 25).clip(max=500)]
        if i % 20 == 0:
            toxic.add(i)
            words += [f"bad{k}" for k in rng.integers(0, 6, 3)]
        rows.append((i, " ".join(words)))
    return rows, toxic


def test_counts_and_features_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, toxic = _corpus(rng, 3000)
    copies = [(10_000 + k, "one text that makes up a third of all rows") for k in range(1500)]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string")
    once = toxicity.without_hot_copies(docs)
    assert once.count() == 3001 and once.agg(F.max("doc_id")).first()[0] == 10_000
    p = toxicity._collected(docs.filter(F.col("doc_id").isin(*sorted(toxic)[:100])))
    keys, cp = np.unique(np.concatenate(p), return_counts=True)
    n, cu = toxicity._counted(once, keys)
    sets = [set(x.tolist()) for x in toxicity._word_sets(pa.array([t for _, t in rows] + [copies[0][1]]))]
    assert n == 3001 and [sum(int(k) in s for s in sets) for k in keys] == cu.astype(int).tolist()
    chosen = {int(keys[k]) for k in toxicity.choose_features(keys, cp, cu, len(p), n)}
    for k, a, b in zip(keys, cp, cu):
        x, y = (a + 0.5) / (len(p) + 1), (b + 0.5) / (n + 1)
        z = abs(x - y) / math.sqrt(x * (1 - x) / len(p) + y * (1 - y) / n)
        assert (int(k) in chosen) == (z >= 3.5 and (a >= 3 or b >= max(3, n // 50)))


def test_held_out_documents_are_found(spark):
    """All unlabelled documents train (many groups), toxic ones of the held-out third are found, clean ones left alone."""
    rng = np.random.default_rng(8)
    rows, toxic = _corpus(rng, 12_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 12_000, 4)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels, group=1000).filter("held_out").collect()
    found = [r.predicted for r in got if r.doc_id in toxic]
    wrong = [r.predicted for r in got if r.doc_id not in toxic]
    assert np.mean(found) > 0.95 and np.mean(wrong) < 0.005 and all(0 <= r.score <= 1 for r in got)
