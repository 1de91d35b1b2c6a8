"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the presence of words, trained in numpy with Adam on the class-prior-corrected risk
    prior * E_P[loss(z)] + max(0, E_U[loss(-z)] - prior * E_P[loss(-z)]),
where a step with a negative second part climbs back on it. P: documents labelled toxic, a sample of about `most_p`
of them (smallest hashes of doc_id). U: every document that is not held out; of a text that makes up more than one
in 2,000 rows one copy, and in training each distinct set of words once. The class prior is the toxic share of the training labels. Features are words without punctuation and their first
letters that P holds and that occur in P significantly more or less often than in U, counted over all of U.

U's word sets, as numbers of the features, are written once and dealt by hash into groups of about `group` documents.
In each of two rounds every group trains from the common parameters on its own documents and all of P; the results
are averaged, weighted by documents, so the training grows with the corpus. Every whole text is scored.

Defined results: null and empty texts have no features and get the bias's score; without labels or toxic rows
every score is 0; rows that repeat a doc_id give a row each; an empty table gives no rows; extra columns are
ignored. Null doc_ids are never trained on and not held out. Long texts are read whole, one at a time at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellumen.llm import textops as tx
from tellumen.llm.common import batches, summed, table, written

U = np.uint64


def features(arr: pa.Array, prefixes: tuple = (4, 5)) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of words and of the first 4 and 5 bytes of longer ones, the row of each, and the number of rows."""
    w = tx.Words(arr, sep=tx.PUNCTUATED)
    h, doc = [w.hash], [w.doc]
    low = np.append(w.low, np.zeros(8, np.uint8))
    for n in prefixes:
        long = w.end - w.start > n
        at = w.start[long]
        head = np.full(len(at), n, U)
        for k in range(n):
            head = (head << U(8)) | low[at + k]
        h.append(tx.mix(head)), doc.append(w.doc[long])
    return np.concatenate(h), np.concatenate(doc), w.n_docs


def _word_sets(arr: pa.Array) -> list[np.ndarray]:
    h, doc, n = features(arr)
    order = np.argsort(doc, kind="stable")
    cut = np.searchsorted(doc[order], np.arange(n + 1))
    return [np.unique(h[order[cut[k] : cut[k + 1]]]) for k in range(n)]


def _collected(texts: DataFrame) -> list[np.ndarray]:
    """Distinct words of a bounded sample of texts, one array a text; equal sets once."""

    def run(it):
        for b in batches(it, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in _word_sets(b.column(0))], pa.binary())], ["w"])

    rows = texts.select("text").mapInArrow(run, "w binary").distinct().toPandas()["w"]
    return [np.frombuffer(x, U) for x in sorted(rows)]


class Sparse:
    """Rows of feature numbers."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.flat], minlength=self.n) + w[-1]

    def gradient(self, g: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)  # bincount gives integers for no features at all
        out += np.bincount(self.flat, weights=g[self.row], minlength=size)
        out[-1] += g.sum()
        return out


def choose_features(keys: np.ndarray, cp: np.ndarray, cu: np.ndarray, n_p: int, n_u: int, least: int = 3, z: float = 3.5, most: int = 4096) -> np.ndarray:
    """Numbers of the `most` (below 2 ** 15) keys whose shares in P and U differ most, by z score. cp, cu: documents that hold each key."""
    able = (cp >= least) | (cu >= max(least, n_u // 50))
    fp, fu = (cp + 0.5) / (n_p + 1), (cu + 0.5) / (n_u + 1)
    score = np.abs(fp - fu) / np.sqrt(fp * (1 - fp) / max(1, n_p) + fu * (1 - fu) / max(1, n_u))
    score = np.where(able, score, 0)
    order = np.lexsort((keys, -score))[:most]
    return np.sort(order[score[order] >= z])


def risk(xp: Sparse, xu: Sparse, w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The risk's two parts (the second before it is cut at 0) and the step's gradient."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    zp, zu = xp.scores(w), xu.scores(w)
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    gp_pos, gp_neg, gu = -prior * sigmoid(-zp) / xp.n, -prior * sigmoid(zp) / xp.n, sigmoid(zu) / xu.n
    gp, gu = (gp_pos + gp_neg, gu) if negative >= 0 else (-gp_neg, -gu)
    return positive, negative, xp.gradient(gp, len(w)) + xu.gradient(gu, len(w))


def train(xp: Sparse, xu: Sparse, w: np.ndarray, prior: float, steps: int, lr: float, l2: float = 1e-6) -> np.ndarray:
    """Weights, the bias last, after `steps` steps of Adam from w on the non-negative risk of all rows given."""
    w = w.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = risk(xp, xu, w, prior)[2]
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= lr * (1 - 0.9 * t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def without_hot_copies(docs: DataFrame, share: int = 2000) -> DataFrame:
    """docs (doc_id, text) with one row of each text that makes up more than one in `share` of all rows; fewer than
    `share` texts can, so they are broadcast."""
    th = F.xxhash64("text")
    n = docs.count()
    hot = docs.groupBy(th.alias("h")).agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("first")).filter(F.col("k") * share > n)
    return docs.join(F.broadcast(hot), th == F.col("h"), "left").filter("h IS NULL OR k = 1 OR doc_id = first").select("doc_id", "text")


def _counted(docs: DataFrame, keys: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of documents and, for each key, of those that hold it."""
    index, size = tx.HashIndex(keys), len(keys)

    def run(it):
        total = np.zeros(size + 1)
        for b in batches(it, "text"):
            total[-1] += b.num_rows
            for x in _word_sets(b.column(0)):
                at = index.find(x)
                total[at[at >= 0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "body"])

    got = summed(docs.select("text").mapInArrow(run, "part int, body binary")).collect()
    total = np.frombuffer(got[0].body) if got else np.zeros(size + 1)
    return int(total[-1]), total[:-1]


def _sets(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """key (a hash of the whole word set), w (numbers of the keys that the text holds): each word set once."""
    index = tx.HashIndex(keys)

    def run(it):
        for b in batches(it, "text"):
            sets = _word_sets(b.column(0))
            with np.errstate(over="ignore"):
                key = np.array([tx.mix(x).sum(dtype=U) for x in sets], U)
            at = [index.find(x) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(key)), pa.array([x[x >= 0].astype(np.int16).tobytes() for x in at], pa.binary())], ["key", "w"])

    return docs.select("text").mapInArrow(run, "key long, w binary").dropDuplicates(["key"])


def fit(p: list, docs: DataFrame, prior: float, group: int, rounds: int = 2, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Feature hashes, weights and bias; docs: the unlabelled documents. None without any."""
    keys, cp = np.unique(np.concatenate([*p, np.zeros(0, U)]), return_counts=True)
    docs = without_hot_copies(docs)
    n, cu = _counted(docs, keys)
    if not n:
        return None
    chosen = keys[choose_features(keys, cp, cu, len(p), n)]
    u = written(_sets(docs, chosen), "tox-sets")
    index = tx.HashIndex(chosen)
    at = [index.find(x) for x in p]
    xp = Sparse([x[x >= 0] for x in at])
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(prior / (1 - prior))
    groups = max(1, round(n / group))
    dealt = u.select(F.pmod("key", F.lit(groups)).alias("g"), "w").repartition(groups, "g").sortWithinPartitions("g")
    for k in range(rounds):

        def run(it, k=k, w=w):
            def trained(sets):
                got = train(xp, Sparse([np.frombuffer(x, np.int16) for x in sets]), w, prior, steps, 0.1 / (1 + 4 * k))
                return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.append(got * len(sets), len(sets)).tobytes()], pa.binary())], ["part", "body"])

            now, held = None, []
            for b in it:
                for g, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if g != now and held:
                        yield trained(held)
                        held = []
                    now = g
                    held.append(x)
            if held:
                yield trained(held)

        total = np.frombuffer(summed(dealt.mapInArrow(run, "part int, body binary")).first().body)
        w = total[:-1] / total[-1]
    return chosen, w[:-1], float(w[-1])


def score_texts(docs: DataFrame, keys: np.ndarray, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score."""
    index = tx.HashIndex(keys)

    def run(it):
        for b in batches(it, "text"):
            h, doc, n = features(b.column(1))
            at = index.find(h)
            hit = at >= 0
            pair = np.unique(doc[hit] * max(1, len(keys)) + at[hit])
            z = np.bincount(pair // max(1, len(keys)), weights=weights[pair % max(1, len(keys))], minlength=n) + bias
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, most_p: int = 3000, group: int = 8192, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of rows with crc32(doc_id) mod 3 = 1 are never read."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    known = labels.filter(~held & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    n = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    model = None
    if n.n and n.t:
        # A share of the hashes that holds about most_p of the toxic rows: a bounded table, and nothing is sorted.
        share = min(1 << 20, -(-(1 << 20) * most_p // n.t))
        ids = F.broadcast(known.filter("toxic = 1").select("doc_id").distinct().filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share))
        p = _collected(docs.join(ids, "doc_id", "left_semi"))
        if p:
            model = fit(p, docs.filter(~held & F.col("doc_id").isNotNull()), min(0.9, max(0.005, n.t / n.n)), group)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score")) if model is None else score_texts(docs, *model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
