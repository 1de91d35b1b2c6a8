"""Benchmark decontamination by latent semantic retrieval.

Pass 1 is a randomised SVD of the TF-IDF matrix of all passages (blocks of 32 words) over hashed words: every
passage is added with a random sign to one of `sketch` rows (a sparse test matrix), so the sketch keeps the row
space while tasks send partial sums of fixed size; word counts travel with it. The driver decomposes
the small sketch; its leading right singular vectors, scaled by idf, centred and whitened, are the projection.
Pass 2 slides windows of each item's own length over every whole text (sums of 8-word blocks in latent space),
takes windows whose cosine with the item reaches `cosine` as candidates, and checks them on words: the longest
common subsequence of item and region must reach `verbatim` of the item's words, or `paraphrase` of them while
the item's answer (its last quarter) is found too. Places where all words of an item stand in a row are candidates
as well, whatever their cosine, so that no verbatim item is missed, however short.

The benchmark is the query set; it is collected in blocks of `block` items, so the broadcast size is bounded.

Defined results: null and empty texts, of documents or items, match nothing; items under `least` words need all
their words, in their order; rows that repeat a doc_id give a hit each, told apart by the text's hash; empty tables
give no rows; extra columns are ignored. Long texts are read whole, one at a time at most; windows go by chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellumen.llm import textops as tx
from tellumen.llm.common import batches, summed, table

U = np.uint64
FEATURE_BITS, SKETCH, RANK, PASSAGE, STEP, ANCHOR = 11, 384, 192, 32, 8, 5
FEATURES = 1 << FEATURE_BITS


def _feature(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - FEATURE_BITS)).astype(np.int64)


def _sketch_rows(docs: DataFrame) -> DataFrame:
    """(part, body): rows 0..SKETCH-1 of the sketch, then the passages that hold each feature and how many there are,
    then the words of each feature."""

    def run(it):
        acc = np.zeros(SKETCH * FEATURES)
        df, count = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
        for b in batches(it, "text"):
            w = tx.Words(b.column(0))
            if not len(w):
                continue
            pos = np.arange(len(w)) - w.first[w.doc]
            new = pos % PASSAGE == 0
            row = np.cumsum(new) - 1
            seed = tx.mix(w.hash[new] + np.flatnonzero(new).astype(U))
            f = _feature(w.hash)
            sign = np.where(seed & U(1), 1.0, -1.0)
            acc += np.bincount(((seed >> U(8)) % U(SKETCH)).astype(np.int64)[row] * FEATURES + f, weights=sign[row], minlength=len(acc))
            count[:-1] += np.bincount(f, minlength=FEATURES)
            # A feature counts once a passage: repeats within a passage lie next to each other when sorted.
            held = np.sort(row * FEATURES + f)
            df[:-1] += np.bincount(held[np.append(True, held[1:] != held[:-1])] % FEATURES, minlength=FEATURES)
            df[-1] += len(seed)
        rows = [*acc.reshape(SKETCH, FEATURES), df, count]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH + 2), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["part", "body"])

    return summed(docs.select("text").mapInArrow(run, "part int, body binary"))


def latent_projection(docs: DataFrame) -> np.ndarray:
    """FEATURES x RANK float32, whitened: a passage's latent vector is the sum of its words' rows."""
    got = {r.part: np.frombuffer(r.body) for r in _sketch_rows(docs).collect()}
    if not got or got[SKETCH][-1] == 0:
        return np.zeros((FEATURES, RANK), np.float32)
    df, n, count = got[SKETCH][:-1], got[SKETCH][-1], got[SKETCH + 1][:-1]
    token = count / count.sum()
    idf = np.log((n + 1) / (df + 1)) + 0.1
    rows = np.array([got[k] for k in range(SKETCH)])
    # One half of the sketch finds the directions, the other measures passages along them without bias.
    _, s, vt = np.linalg.svd(rows[::2] * idf, full_matrices=False)
    p = (vt[: min(RANK, int((s > 1e-9 * s[0]).sum()))] * idf).T
    p -= token @ p
    p = p @ _inverse_root((p * token[:, None]).T @ p)
    # Directions in which whole passages agree (language, common words) are shrunk to the typical energy.
    energy, q = np.linalg.eigh((rows[1::2] @ p).T @ (rows[1::2] @ p))
    typical = np.median(energy)
    p = p @ q * np.where(energy > 4 * typical, np.sqrt(typical / np.maximum(energy, 1e-30)), 1.0)
    return np.pad(p, ((0, 0), (0, RANK - p.shape[1]))).astype(np.float32)


def _inverse_root(c: np.ndarray) -> np.ndarray:
    """c to the power -1/2, without the directions in which c vanishes."""
    v, q = np.linalg.eigh(c)
    ok = v > 1e-9 * max(v[-1], 1e-30)
    return q[:, ok] / np.sqrt(v[ok])


def lcs(masks: dict, m: int, words: list) -> int:
    """Length of the longest common subsequence, bit-parallel; masks: word -> bits of its places in the item."""
    full = (1 << m) - 1
    v = full
    for w in words:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` successive words from each place that has as many."""
    n = len(h) - size + 1
    acc = tx.fold(np.full(n, size, U), h[:n])
    for k in range(1, size):
        acc = tx.fold(acc, h[k : n + k])
    return acc


class Items:
    """The block of benchmark items, grouped by window length in steps."""

    def __init__(self, rows: list, proj: np.ndarray):
        w = tx.Words(pa.array([r.text for r in rows], pa.string()))
        self.ids, self.words, self.masks, self.times, self.answers = [], [], [], [], []
        latent = []
        for k, r in enumerate(rows):
            h = w.hash[w.first[k] : w.first[k + 1]]
            if not len(h):
                continue
            self.ids.append(r.item_id)
            self.words.append(h.tolist())
            self.masks.append(self._masks(h.tolist()))
            self.times.append({x: v.bit_count() for x, v in self.masks[-1].items()})
            tail = h[-max(3, len(h) // 4) :].tolist()
            self.answers.append((len(tail), self._masks(tail)))
            latent.append(proj[_feature(h)].sum(axis=0))
        self.n = np.array([len(x) for x in self.words], int)
        q = np.array(latent, np.float32).reshape(len(self.ids), RANK)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
        self.q = q
        self.groups = {}
        steps = np.maximum(1, np.rint(self.n / STEP).astype(int))
        for s in np.unique(steps):
            at = np.flatnonzero(steps == s)
            self.groups[int(s)] = (at, q[at].copy())

        # Exact runs: items by the hash of their first words, at most ANCHOR of them.
        self.arrays = [np.array(x, U) for x in self.words]
        self.anchors = {}
        for size in sorted({min(ANCHOR, len(x)) for x in self.arrays}):
            at = [k for k, x in enumerate(self.arrays) if min(ANCHOR, len(x)) == size]
            keys = np.array([runs(self.arrays[k][:size], size)[0] for k in at], U)
            order = np.argsort(keys, kind="stable")
            self.anchors[size] = (tx.HashIndex(np.unique(keys)), keys[order], np.array(at)[order])

    def exact(self, w: tx.Words) -> list[tuple[int, int, int]]:
        """(row, item, start): the first place in each text where all words of an item stand in a row."""
        out = []
        for size, (index, keys, items) in self.anchors.items():
            if len(w) < size:
                continue
            key = runs(w.hash, size)
            hit = np.flatnonzero(index.find(key) >= 0)
            hit = hit[w.doc[hit + size - 1] == w.doc[hit]]
            key = key[hit]
            lo, hi = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
            for k in range(int((hi - lo).max()) if len(hit) else 0):
                more = lo + k < hi
                for item in np.unique(items[lo[more] + k]).tolist():
                    at = hit[more][items[lo[more] + k] == item]
                    words = self.arrays[item]
                    at = at[at + len(words) <= w.first[w.doc[at] + 1]]
                    for j in range(size, len(words)):
                        at = at[w.hash[at + j] == words[j]]
                    docs, first = np.unique(w.doc[at], return_index=True)
                    out.extend(zip(docs.tolist(), [item] * len(docs), (at[first] - w.first[docs]).tolist(), strict=True))
        return out

    @staticmethod
    def _masks(words: list) -> dict:
        out: dict = {}
        for k, x in enumerate(words):
            out[x] = out.get(x, 0) | (1 << k)
        return out


HIT = "doc_id long, th long, item_id long, cosine double, lcs_share double, answer_share double, verbatim boolean, start_word long, end_word long"


def _search(docs: DataFrame, items: Items, proj: np.ndarray, cosine: float, verbatim: float, paraphrase: float, least: int) -> DataFrame:
    padded = np.vstack([proj, np.zeros((1, RANK), np.float32)])

    def run(it):
        for b in batches(it, "text"):
            w = tx.Words(b.column(1))
            if not len(w):
                continue
            count = np.diff(w.first)
            per_doc = -(-count // STEP)
            block0 = np.concatenate([[0], np.cumsum(per_doc)])
            in_doc = np.arange(block0[-1]) - np.repeat(block0[:-1], per_doc)
            opens = np.repeat(w.first[:-1], per_doc) + in_doc * STEP
            left = np.repeat(w.first[1:], per_doc) - opens
            f = _feature(w.hash)
            cum = np.zeros((block0[-1] + 1, RANK), np.float32)
            for k in range(STEP):
                cum[1:] += padded[np.where(left > k, f[np.minimum(opens + k, len(f) - 1)], FEATURES)]
            np.cumsum(cum, axis=0, out=cum)
            stop = np.repeat(block0[1:], per_doc)
            doc_of = np.repeat(np.arange(w.n_docs), per_doc)
            at = np.arange(block0[-1])
            found: dict = {}
            for steps, (cols, q) in items.groups.items():
                # Windows that begin in a text's last blocks end with the text; the first one always counts.
                every = at[(at + steps <= stop) | (in_doc == 0)]
                chunk = max(64, min(4096, (1 << 22) // len(cols)))
                for use in (every[c : c + chunk] for c in range(0, len(every), chunk)):
                    win = cum[np.minimum(use + steps, stop[use])] - cum[use]
                    norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", win, win)), 1e-9)
                    sim = win @ q.T
                    i, j = np.nonzero(sim >= cosine * norm[:, None])
                    sim, first = sim[i, j] / norm[i], in_doc[use[i]] * STEP
                    for doc, col, start, cos in zip(doc_of[use[i]].tolist(), cols[j].tolist(), first.tolist(), sim.tolist(), strict=True):
                        found.setdefault((doc, col), []).append((start, cos, steps * STEP))
            for doc, k, start in items.exact(w):
                here = w.first[doc] + start
                latent = proj[f[here : here + int(items.n[k])]].sum(axis=0)
                cos = float(latent @ items.q[k]) / max(float(np.linalg.norm(latent)), 1e-9)
                found.setdefault((doc, k), []).append((start, cos, int(items.n[k])))
            out = []
            for (doc, k), wins in found.items():
                m = int(items.n[k])
                best = None
                reach, last = max(4, m // 3), -1
                for start, cos, size in sorted(wins):
                    lo, hi = max(0, start - reach), min(int(count[doc]), start + size + reach)
                    if best and hi <= last and cos <= best[0]:
                        continue
                    text = w.hash[w.first[doc] + lo : w.first[doc] + hi].tolist()
                    # Item words that the region lacks bound the subsequence.
                    if m - sum(map(items.times[k].__getitem__, items.times[k].keys() - text)) < paraphrase * m:
                        continue
                    share = lcs(items.masks[k], m, text) / m
                    if best is None or share > best[1]:
                        size_a, masks_a = items.answers[k]
                        best = (cos, share, lcs(masks_a, size_a, text) / size_a, lo, hi)
                    last = hi
                if best is None:
                    continue
                need = 1.0 if m < least else verbatim
                if best[1] >= need or (m >= least and best[1] >= paraphrase and best[2] >= 0.6):
                    out.append((doc, items.ids[k], best[0], best[1], best[2], best[1] >= need, best[3], best[4]))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()).take(pa.array(cols[0])), b.column(2).take(pa.array(cols[0])), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:5]], pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.int64()), pa.array(cols[7], pa.int64())], [x.split()[0] for x in HIT.split(", ")])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, HIT)


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.34, verbatim: float = 0.8, paraphrase: float = 0.55, least: int = 6, block: int = 8192) -> DataFrame:
    """One row per document and benchmark item that it contains: HIT."""
    proj = latent_projection(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = -(-items.count() // block)
    out = None
    for k in range(max(1, blocks)):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))) == k).collect()
        part = _search(docs, Items(rows, proj), proj, cosine, verbatim, paraphrase, least)
        out = part if out is None else out.unionByName(part)
    return out


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
