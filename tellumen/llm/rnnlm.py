"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state.

Counts over all training documents (crc32(doc_id) mod 10 <> 0) give every word's count c, their sum N and the
number of distinct words V; one `end` is counted per text. The `top` most frequent words (a fixed number, see
most_frequent) are known by number; the first `frequent` of them are grouped into classes of 32 with a learned softmax inside each.
All other words, seen or not, fall into classes by spelling: a naive-Bayes guess of the language from the first
two and last two letters, learned from the same corpus, and the closing punctuation. Inside a spelling class a
word has (c + 0.1) / (sum over the class + 0.1), so the model is a distribution over words plus one unknown word
for each spelling class. P(word) = P(class | state) P(word | class, state).

Training is local SGD: each task trains on segments of its own documents, backpropagating through windows of 32
words with state carried between them; the parameters are then averaged, weighted by words. A hash of doc_id,
text and the segment's offset gives every segment of the corpus its one round; `rate` is the share of segments
that train, all by default. A task trains on `most` segments at a time. The volume grows with the corpus.
Scoring reads whole texts; hidden state is carried across windows from a text's first word to its end.
Rare words' counts come from a join with the count table, after the `top` words have been settled by broadcast.

Defined results: null text is empty (one token, the end); rows that repeat doc_id and text give one row; null
doc_ids count as training text and are not held out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellumen.llm import textops as tx
from tellumen.llm.common import batches, summed, table, written

U = np.uint64
HIDDEN, SIZE, WINDOW, LETTERS, ENDINGS = 32, 32, 32, 4096, 3
LN10 = float(np.log(10))


def spelling(w: tx.Words) -> np.ndarray:
    """12 bits of the last two bytes before punctuation, 12 bits of the first two, 2 bits of the ending."""
    low, s, e = w.low, w.start, w.end
    last = low[e - 1]
    ending = np.where(last == 46, 1, np.where(last == 44, 2, 0))
    e = np.where((ending > 0) & (e - s > 1), e - 1, e)
    pair = lambda a, b: ((low[a].astype(np.int64) * 61 + low[b]) * 40503 >> 4) % LETTERS
    return (pair(np.maximum(e - 2, s), e - 1) << 14) | (pair(s, np.minimum(s + 1, e - 1)) << 2) | ending


@dataclass
class Vocabulary:
    """What scoring needs of the counts; everything is of fixed size."""

    index: tx.HashIndex
    count: np.ndarray  # of the known words, by position in the index
    word: np.ndarray  # number among the frequent words, or -1
    odds: np.ndarray  # languages x 2 x LETTERS
    prior: np.ndarray
    n: float
    v: float
    ends: float
    mass: np.ndarray  # of the spelling classes
    frequent: int

    @property
    def classes(self) -> int:
        return self.frequent // SIZE

    def tail_class(self, sp: np.ndarray) -> np.ndarray:
        score = self.odds[:, 0, sp >> 14] + self.odds[:, 1, (sp >> 2) & (LETTERS - 1)] + self.prior[:, None]
        return score.argmax(axis=0) * ENDINGS + (sp & 3)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))


def count_words(docs: DataFrame, langs: list[str]) -> DataFrame:
    """(h, c, sp, body): partial counts of words per task, and per task one row with spelling statistics."""

    def run(it):
        stats = np.zeros((len(langs) + 1, 2, LETTERS))
        texts, held = 0, [[], [], []]

        def merged():
            h, at, back = np.unique(np.concatenate(held[0]), return_index=True, return_inverse=True)
            return h, np.bincount(back, weights=np.concatenate(held[1])), np.concatenate(held[2])[at]

        def out(h, c, sp):
            return pa.RecordBatch.from_arrays([pa.array(tx.signed(h)), pa.array(c.astype(np.int64)), pa.array(sp.astype(np.int64)), pa.nulls(len(h), pa.binary())], ["h", "c", "sp", "body"])

        for b in batches(it, "text"):
            w = tx.Words(b.column(0))
            texts += b.num_rows
            if not len(w):
                continue
            sp = spelling(w)
            at = pa.array(langs, pa.string()) if langs else pa.array([""], pa.string())
            lang = pc.fill_null(pc.index_in(b.column(1), at), len(langs)).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lang[w.doc] * LETTERS
            stats[:, 0] += np.bincount(flat + (sp >> 14), minlength=stats[:, 0].size).reshape(-1, LETTERS)
            stats[:, 1] += np.bincount(flat + ((sp >> 2) & (LETTERS - 1)), minlength=stats[:, 1].size).reshape(-1, LETTERS)
            h, first, c = np.unique(w.hash, return_index=True, return_counts=True)
            for col, x in zip(held, (h, c.astype(float), sp[first]), strict=True):
                col.append(x)
            if sum(map(len, held[0])) > 3_000_000:
                h, c, sp = merged()
                held = [[h], [c], [sp]]
                if len(h) > 1_500_000:
                    yield out(h, c, sp)
                    held = [[], [], []]
        if held[0]:
            yield out(*merged())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([texts], pa.int64()), pa.nulls(1, pa.int64()), pa.array([stats.tobytes()], pa.binary())], ["h", "c", "sp", "body"])

    return docs.select("text", "lang").mapInArrow(run, "h long, c long, sp long, body binary")


def most_frequent(counts: DataFrame, top: int) -> DataFrame:
    """The `top` rows of highest count; counts within a sixteenth of an octave tie, smaller high bits of the hash go
    first. Two histograms of fixed size (by count, then by hash inside the count where the limit falls) give the
    cut, so that no task or driver sorts more than the result: a sort with a limit would send `top` rows per task."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    bits = F.shiftrightunsigned("h", 48).cast("int")
    size = sorted(((r.k, r.n) for r in counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    above, cut = 0, None
    for k, n in size:
        if above + n > top:
            cut = k
            break
        above += n
    if cut is None:
        return counts
    least, room = -1, top - above
    for r in sorted(counts.filter(step == cut).groupBy(bits.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()):
        if r.n > room:
            break
        least, room = r.k, room - r.n
    return counts.filter((step > cut) | ((step == cut) & (bits <= least)))


def build_vocabulary(docs: DataFrame, top: int, frequent: int, most_langs: int) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary and the count table (h, c, sp) of all training words."""
    langs = [r.lang for r in docs.filter("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()]
    parts = written(count_words(docs, langs), "lm-parts")
    counts = written(parts.filter("body IS NULL").groupBy("h").agg(F.sum("c").alias("c"), F.min("sp").alias("sp")), "lm-counts")
    stats_rows = summed(parts.filter("body IS NOT NULL").select(F.lit(0).alias("part"), "body")).collect()
    shape = (len(langs) + 1, 2, LETTERS)
    stats = np.frombuffer(stats_rows[0].body).reshape(shape) if stats_rows else np.zeros(shape)
    ends = parts.filter("body IS NOT NULL").agg(F.sum("c")).first()[0] or 0
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    odds = np.log((stats + 0.5) / (stats.sum(axis=2, keepdims=True) + 0.5 * LETTERS))
    prior = np.log((stats[:, 0].sum(axis=1) + 1) / (stats[:, 0].sum() + len(stats)))
    known = most_frequent(counts, top).toPandas()
    order = np.argsort(known["h"].to_numpy(np.int64).view(U))
    h, c, sp = (known[k].to_numpy(np.int64)[order] for k in ("h", "c", "sp"))
    voc = Vocabulary(tx.HashIndex(h.view(U)), c.astype(float), np.full(len(h), -1), odds, prior, float((total[0] or 0) + ends), float(total[1] + (ends > 0)), float(ends), np.zeros(0), frequent)
    # The end is word 0; then the most frequent words by likely language, so that a class is of one language.
    first = np.argsort(-c, kind="stable")[: frequent - 1]
    first = first[np.lexsort((-c[first], voc.tail_class(sp[first]) // ENDINGS))]
    voc.word[first] = np.arange(1, len(first) + 1)
    taken = h[first]

    def mass(it):
        acc = np.zeros(len(prior) * ENDINGS)
        for b in it:
            x, c, sp = (b.column(k).to_numpy() for k in range(3))
            for i in range(0, len(x), 1 << 16):
                rest = ~np.isin(x[i : i + (1 << 16)], taken)
                acc += np.bincount(voc.tail_class(sp[i : i + (1 << 16)][rest]), weights=c[i : i + (1 << 16)][rest] + 0.1, minlength=len(acc))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([acc.tobytes()], pa.binary())], ["part", "body"])

    got = summed(counts.mapInArrow(mass, "part int, body binary")).collect()
    voc.mass = (np.frombuffer(got[0].body) if got else np.zeros(len(prior) * ENDINGS)) + 0.1
    return voc, counts


class Gru:
    """Parameters in one flat vector: input table, recurrence, class layer, word layer."""

    def __init__(self, voc: Vocabulary, flat: np.ndarray | None = None, seed: int = 1):
        self.tail, self.frequent, self.classes = len(voc.mass), voc.frequent, voc.classes
        k = self.classes + self.tail
        self.shapes = [(self.frequent + self.tail, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (HIDDEN, k), (k,), (self.frequent, HIDDEN), (self.frequent,)]
        sizes = [int(np.prod(s)) for s in self.shapes]
        if flat is None:
            rng = np.random.default_rng(seed)
            word = np.full(self.frequent, 0.1)
            word[0] += voc.ends
            at = voc.word >= 0
            word[voc.word[at]] += voc.count[at]
            c = np.concatenate([word.reshape(-1, SIZE).sum(axis=1), voc.mass])
            parts = [rng.normal(0, 0.1, sizes[0]), rng.normal(0, 1 / np.sqrt(HIDDEN), sizes[1]), np.zeros(sizes[2]), np.log(c / c.sum()), np.zeros(sizes[4]), np.log(word)]
            flat = np.concatenate(parts)
        self.flat = flat.astype(np.float32)
        self.p = self.views(self.flat)

    def views(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes:
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s))
            at += n
        return out

    def targets(self) -> tuple[np.ndarray, np.ndarray]:
        """Class and word of each input number."""
        k = np.arange(self.frequent + self.tail)
        own = k < self.frequent
        return np.where(own, k // SIZE, k - self.frequent + self.classes), np.where(own, k, -1)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        """One step for all rows: x = input rows of the table. Returns the new state, [r z], n and the candidate's
        recurrent part."""
        g = h @ self.p[1]
        rz = x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
        np.negative(rz, rz)
        np.exp(rz, rz)
        rz += 1
        np.reciprocal(rz, rz)
        gn = g[:, 2 * HIDDEN :]
        n = rz[:, :HIDDEN] * gn
        n += x[:, 2 * HIDDEN :]
        np.tanh(n, n)
        new = h - n
        new *= rz[:, HIDDEN:]
        new += n
        return new, rz, n, gn

    def log_prob(self, h: np.ndarray, cls: np.ndarray, word: np.ndarray, grads: list | None = None, chunk: int = 4096) -> np.ndarray | tuple:
        """Natural log probability of class and, for frequent words, of the word in it. With grads: also the
        gradient of the negative sum by h, parameter gradients added in place. Rows go by chunks that fit the cache."""
        out, dh = np.empty(len(h), h.dtype), np.empty_like(h) if grads is not None else None
        # While no logit can leave exp's range, a softmax needs no row maximum, which costs more than the exp.
        top = float(np.abs(h).max()) if len(h) else 0.0
        self.safe = all(top * float(np.abs(w).sum(axis=k).max()) + float(np.abs(b).max()) < 80 for w, b, k in ((self.p[2], self.p[3], 0), (self.p[4], self.p[5], 1)))
        for i in range(0, len(h), chunk):
            rows = slice(i, i + chunk)
            got = self._chunk(h[rows], cls[rows], word[rows], grads)
            out[rows] = got[0]
            if grads is not None:
                dh[rows] = got[1]
        return out if grads is None else (out, dh)

    def _softmax(self, z: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """z becomes exp(z), less its row's maximum where that is needed; the picked entries' log probabilities and
        the row sums."""
        if not self.safe:
            z -= z.max(axis=1, keepdims=True)
        chosen = z[np.arange(len(z)), pick]
        np.exp(z, z)
        total = z @ np.ones(z.shape[1], z.dtype)
        return chosen - np.log(total), total

    def _chunk(self, h, cls, word, grads):
        z = h @ self.p[2]
        z += self.p[3]
        out, total = self._softmax(z, cls)
        dh = None
        if grads is not None:
            z /= total[:, None]
            z[np.arange(len(h)), cls] -= 1
            dh = z @ self.p[2].T
            for i in range(0, len(h), 512):
                grads[2] += h[i : i + 512].T @ z[i : i + 512]
            grads[3] += np.ones(len(h), h.dtype) @ z
        inside = np.flatnonzero(cls < self.classes)
        if not len(inside):
            return out, dh
        # Rows in the order of their class, so that each class is one product and everything else one pass.
        inside = inside[np.argsort(cls[inside].astype(np.int16), kind="stable")]
        c, hs = cls[inside], h[inside]
        cut = np.searchsorted(c, np.arange(self.classes + 1))
        blocks = [(k, slice(cut[k], cut[k + 1]), slice(k * SIZE, (k + 1) * SIZE)) for k in np.flatnonzero(np.diff(cut))]
        z = self.p[5].reshape(-1, SIZE)[c]
        for _, at, words in blocks:
            z[at] += hs[at] @ self.p[4][words].T
        pick = word[inside] - c * SIZE
        lp, total = self._softmax(z, pick)
        out[inside] += lp
        if grads is not None:
            z /= total[:, None]
            z[np.arange(len(z)), pick] -= 1
            back = np.empty_like(hs)
            for _, at, words in blocks:
                back[at] = z[at] @ self.p[4][words]
                grads[4][words] += z[at].T @ hs[at]
                grads[5][words] += np.ones(at.stop - at.start, z.dtype) @ z[at]
            dh[inside] += back
        return out, dh


def encode(w: tx.Words, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: position among the known words or -1, number among the frequent or -1, class, input number."""
    at = voc.index.find(w.hash)
    word = np.where(at >= 0, voc.word[np.maximum(at, 0)] if len(voc.word) else -1, -1)
    cls = np.where(word >= 0, word // SIZE, 0)
    tail = word < 0
    if tail.any():
        t = voc.tail_class(spelling(w)[tail])
        cls[tail] = voc.classes + t
    return at, word, cls, np.where(tail, voc.frequent + cls - voc.classes, word)


def batch_cuts(n: int, first: int, most: int, growth: int = 16) -> list[int]:
    """Where the batches of n segments begin, and n: they grow from `first` to `most`, as late steps need less noise."""
    out, size = [0], first
    while out[-1] < n:
        out.append(min(n, out[-1] + size))
        size = min(most, size + growth)
    return out


def train_segments(net: Gru, seq: np.ndarray, size: np.ndarray, lr: float, batch: tuple[int, int], seed: int) -> None:
    """Adam over batches of segments, window by window with carried state. seq: runs of input numbers, one after the
    other, each with the number before it in front; size: targets a run. Runs of like sizes share a batch, so that
    little is padded; the batches come in a random order. batch: the first and the largest batch's segments."""
    rng = np.random.default_rng(seed)
    begin = np.cumsum(size + 1) - (size + 1)
    order = np.argsort(size + rng.random(len(size)), kind="stable")
    cut = batch_cuts(len(size), *batch)
    groups = [order[i:j] for i, j in zip(cut, cut[1:])]
    if len(groups) > 1:
        # Small batches first, each with a random stretch of sizes.
        place = rng.permutation(len(size))[: len(groups)].argsort()
        width, at, groups = np.diff(cut), 0, [None] * len(groups)
        for k in place.argsort():
            groups[k] = order[at : at + width[k]]
            at += width[k]
    cls_of, word_of = net.targets()
    adam = Adam(net.flat, lr, sum(-(-int(size[g].max()) // WINDOW) for g in groups))
    for rows in groups:
        length = size[rows]
        h = np.zeros((len(rows), HIDDEN), np.float32)
        for t0 in range(0, int(length.max()), WINDOW):
            t = np.arange(t0, min(t0 + WINDOW, int(length.max())) + 1)[:, None]
            ids = seq[begin[rows] + np.minimum(t, length)]
            live = t[:-1] < length
            grad, h = window_gradient(net, h, ids[:-1], cls_of[ids[1:]], word_of[ids[1:]], live)
            adam.step(grad, int(live.sum()))


def window_gradient(net: Gru, h: np.ndarray, x_at: np.ndarray, cls: np.ndarray, word: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the live words' negative log probability by all parameters, truncated at the window's begin, and
    the state after it. Arrays are time-major."""
    span, n_rows = x_at.shape
    kind = h.dtype
    hs, r, z, by_n, by_z, by_r = (np.empty((span + (k == 0), n_rows, HIDDEN), kind) for k in range(6))
    hs[0] = h
    for k in range(span):
        hs[k + 1], rz, cand, gn = net.step(net.p[0].take(x_at[k], axis=0), hs[k])
        r[k], z[k] = rz[:, :HIDDEN], rz[:, HIDDEN:]
        # What the step's dh will be multiplied with, while all of it is in the cache.
        np.multiply(cand, cand, out=by_n[k])
        np.subtract(1, by_n[k], out=by_n[k])
        keep = 1 - z[k]
        by_n[k] *= keep
        np.subtract(hs[k], cand, out=by_z[k])
        keep *= z[k]
        by_z[k] *= keep
        np.subtract(1, r[k], out=by_r[k])
        by_r[k] *= r[k]
        by_r[k] *= gn
    grad = np.zeros_like(net.flat)
    g = net.views(grad)
    if live.all():
        dh_out = net.log_prob(hs[1:].reshape(-1, HIDDEN), cls.ravel(), word.ravel(), g)[1].reshape(span, n_rows, HIDDEN)
    else:
        dh_out = np.zeros((span, n_rows, HIDDEN), kind)
        _, dh_out[live] = net.log_prob(hs[1:][live], cls[live], word[live], g)
    dx = np.empty((span, n_rows, 3 * HIDDEN), kind)
    dg = np.empty_like(dx)
    back = np.zeros_like(h)
    recur = np.ascontiguousarray(net.p[1].T)
    for k in range(span - 1, -1, -1):
        dh = dh_out[k]
        dh += back
        dr, dz, dn = (dx[k, :, j * HIDDEN : (j + 1) * HIDDEN] for j in range(3))
        np.multiply(dh, by_n[k], out=dn)
        np.multiply(dh, by_z[k], out=dz)
        np.multiply(dn, by_r[k], out=dr)
        dg[k, :, : 2 * HIDDEN] = dx[k, :, : 2 * HIDDEN]
        np.multiply(dn, r[k], out=dg[k, :, 2 * HIDDEN :])
        # Step by step: a product with as many rows as the whole window has costs more than its parts.
        g[1][...] += hs[k].T @ dg[k]
        back = dg[k] @ recur
        dh *= z[k]
        back += dh
    flat_at, flat_dx = x_at.ravel(), dx.reshape(-1, 3 * HIDDEN)
    by = np.argsort(flat_at.astype(np.int16) if net.shapes[0][0] < 1 << 15 else flat_at, kind="stable")
    ids = flat_at[by]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    g[0][ids[first]] += np.add.reduceat(flat_dx[by], first, axis=0)
    return grad, hs[-1]


class Adam:
    """Updates in place; the rate falls to a tenth over `steps`, a step's gradient is the mean over its words with
    its norm cut at 1."""

    def __init__(self, flat: np.ndarray, lr: float, steps: int):
        self.flat, self.lr, self.steps, self.t = flat, lr, steps, 0
        self.m, self.v, self.buffer = (np.zeros_like(flat) for _ in range(3))

    def step(self, grad: np.ndarray, words: int) -> None:
        norm = float(np.sqrt(grad @ grad)) / max(1, words)
        grad *= np.float32(min(1.0, 1.0 / max(norm, 1e-9)) / max(1, words))
        self.t += 1
        t, buf = self.t, self.buffer
        self.m *= np.float32(0.9)
        np.multiply(grad, np.float32(0.1), out=buf)
        self.m += buf
        self.v *= np.float32(0.999)
        np.multiply(grad, grad, out=buf)
        buf *= np.float32(0.001)
        self.v += buf
        np.sqrt(self.v, out=buf)
        buf *= np.float32(1 / np.sqrt(1 - 0.999**t))
        buf += np.float32(1e-8)
        np.divide(self.m, buf, out=buf)
        buf *= np.float32(self.lr * (1 - 0.9 * t / (self.steps + 1)) / (1 - 0.9**t))
        self.flat -= buf


def sequences(w: tx.Words, voc: Vocabulary) -> tuple[np.ndarray, tuple, np.ndarray, np.ndarray]:
    """Each text's words and its end as one run: the words' positions in it, (input, class, word) of every place,
    the runs' sizes and the words' positions among the known ones."""
    at, word, cls, inp = encode(w, voc)
    size = np.diff(w.first) + 1
    place = np.arange(len(w)) + w.doc
    inputs, target_c, target_w = (np.zeros(int(size.sum()), np.int32) for _ in range(3))
    target_c[place], target_w[place], inputs[place + 1] = cls, word, inp
    inputs[np.cumsum(size) - size] = 0
    return at, (inputs, target_c, target_w), size, cls


def segments(text: pa.Array, key: np.ndarray, voc: Vocabulary, rounds: int, rate: float, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all segments (see train_segments), their sizes, and the round in which each trains (or -1). key: a
    hash of each row's doc_id and text."""
    w = tx.Words(text)
    _, _, _, inp = encode(w, voc)
    size = np.diff(w.first) + 1
    # Each text is 0, its words' numbers, and the end's number, 0.
    run = np.zeros(len(w) + 2 * len(size), np.uint16)
    run[np.arange(len(w)) + 2 * w.doc + 1] = inp
    pieces = -(-size // segment)
    doc = np.repeat(np.arange(len(size)), pieces)
    j = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.minimum(segment, size[doc] - j * segment)
    draw = tx.mix(key[doc] ^ tx.mix((j * segment).astype(U) + U(1)))
    turn = np.where((draw >> U(32)) < U(round(rate * 2**32)), ((draw & U(2**32 - 1)) % U(rounds)).astype(np.int64), -1)
    begin = (np.cumsum(size + 1) - (size + 1))[doc] + j * segment
    at = np.arange(int((length + 1).sum())) - np.repeat(np.cumsum(length + 1) - (length + 1) - begin, length + 1)
    return run[at], length, turn


def chosen(seq: np.ndarray, length: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs that are taken."""
    return seq[np.repeat(take, length + 1)], length[take]


def drawn_segments(text: pa.Array, key: np.ndarray, voc: Vocabulary, k: int, rounds: int, rate: float, segment: int):
    """(input, class, word) of each segment that trains in round k."""
    seq, length, turn = segments(text, key, voc, rounds, rate, segment)
    seq, length = chosen(seq, length, turn == k)
    cls_of, word_of = Gru(voc).targets()
    stop = np.cumsum(length + 1)
    for b, e in zip(stop - length - 1, stop, strict=True):
        yield seq[b : e - 1], cls_of[seq[b + 1 : e]], word_of[seq[b + 1 : e]]


class LocalTraining:
    """One task's training: segments are held until there are `most`, then trained on."""

    def __init__(self, voc: Vocabulary, flat: np.ndarray, k: int, rounds: int, batch: tuple[int, int], most: int):
        self.net, self.k, self.rounds, self.batch, self.most = Gru(voc, flat), k, rounds, batch, most
        self.held, self.words, self.groups = [], 0, 0

    def add(self, seq: np.ndarray, length: np.ndarray) -> None:
        self.held.append((seq, length))
        if sum(len(x) for _, x in self.held) >= self.most:
            self._train(self.most)

    def _train(self, least: int) -> None:
        seq, length = (np.concatenate(x) for x in zip(*self.held, strict=True))
        while len(length) >= least:
            now, n = length[: self.most], int(length[: self.most].sum()) + min(self.most, len(length))
            batch = self.batch if not self.groups and not self.k else (self.batch[1], self.batch[1])
            train_segments(self.net, seq[:n], now, 0.02 / (self.k + 1), batch, seed=self.k + self.rounds * self.groups)
            seq, length = seq[n:], length[self.most :]
            self.words, self.groups = self.words + int(now.sum()), self.groups + 1
        self.held = [(seq, length)] if len(length) else []

    def result(self) -> pa.RecordBatch:
        """Parameters times words, and the words."""
        if self.held:
            self._train(1)
        return _body(0, np.append(self.net.flat.astype(np.float64) * self.words, self.words))


def _body(part: int, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([b"".join(x.tobytes() for x in arrays)], pa.binary())], ["part", "body"])


def train(docs: DataFrame, voc: Vocabulary, rate: float, rounds: int, segment: int = 256, batch: tuple[int, int] = (32, 256), most: int = 4096) -> Gru:
    """The first round reads the texts, trains on its own segments and writes those of later rounds as numbers."""
    net, rows = Gru(voc), docs.select("text", F.xxhash64("doc_id", "text").alias("key"))
    for k in range(rounds):
        flat = net.flat

        def from_texts(it, flat=flat):
            local = LocalTraining(voc, flat, 0, rounds, batch, most)
            for b in batches(it, "text"):
                seq, length, turn = segments(b.column(0), b.column(1).to_numpy().view(U), voc, rounds, rate, segment)
                local.add(*chosen(seq, length, turn == 0))
                for later in range(1, rounds):
                    mine, size = chosen(seq, length, turn == later)
                    if len(size):
                        yield _body(later, np.array([len(size)], np.int32), size.astype(np.int32), mine)
            yield local.result()

        def from_numbers(it, k=k, flat=flat):
            local = LocalTraining(voc, flat, k, rounds, batch, most)
            for b in it:
                for body in b.column(0):
                    x = body.as_buffer()
                    n = int(np.frombuffer(x, np.int32, 1)[0])
                    local.add(np.frombuffer(x, np.uint16, offset=4 * n + 4), np.frombuffer(x, np.int32, n, 4).astype(np.int64))
            yield local.result()

        if k == 0:
            first = written(rows.mapInArrow(from_texts, "part int, body binary"), "lm-round")
            sums = first.filter("part = 0")
        else:
            sums = first.filter(F.col("part") == k).select("body").mapInArrow(from_numbers, "part int, body binary")
        got = summed(sums).collect()
        total = np.frombuffer(got[0].body) if got else np.zeros(len(flat) + 1)
        if total[-1] > 0:
            net = Gru(voc, total[:-1] / total[-1])
    return net


def score_group(net: Gru, inp: np.ndarray, cls: np.ndarray, word: np.ndarray, first: np.ndarray, size: np.ndarray, block: int = 512, most: int = 4096) -> np.ndarray:
    """Sum of natural log probabilities of each text: blocks of texts side by side, longest first, state carried on;
    a window is as long as `most` words of the live texts."""
    order, out = np.argsort(-size, kind="stable"), np.zeros(len(size))
    for b in range(0, len(order), block):
        rows = order[b : b + block]
        begin, length = first[rows], size[rows]
        alive = len(rows) - np.searchsorted(length[::-1], np.arange(int(length[0])), side="right")
        h, t = np.zeros((len(rows), HIDDEN), np.float32), 0
        total = np.zeros(len(rows))
        while t < len(alive):
            span = min(max(1, most // int(alive[t])), len(alive) - t)
            n = alive[t : t + span]
            hidden, at, text = np.empty((int(n.sum()), HIDDEN), np.float32), [], []
            done = 0
            for k, m in enumerate(n):
                place = begin[:m] + (t + k)
                h = net.step(net.p[0].take(inp[place], axis=0), h[:m])[0]
                hidden[done : done + m] = h
                at.append(place)
                done += m
            place = np.concatenate(at)
            text = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            total += np.bincount(text, weights=net.log_prob(hidden, cls[place], word[place]), minlength=len(rows))
            t += span
        out[rows] = total
    return out


OUT = "doc_id long, th long, h long, n long, known long, base double, score double"


def score_texts(docs: DataFrame, voc: Vocabulary, net: Gru, most_words: int = 1_000_000) -> DataFrame:
    """OUT: per text one row with h null, and one row for each of its words outside the `top` (n times), whose
    in-class part and base score are still open; its `score` holds the log10 of the class mass."""
    names = [x.split()[0] for x in OUT.split(", ")]
    in_class = np.log((voc.count + 0.1)) if len(voc.count) else np.zeros(1)
    log_mass = np.log(voc.mass)

    def run(it):
        group: list = []

        def flush():
            size = np.concatenate([g[3] for g in group])
            first = np.cumsum(size) - size
            lp = score_group(net, *(np.concatenate([g[k] for g in group]) for k in (0, 1, 2)), first, size)
            ids, ths, base, known, fixed = (np.concatenate([g[k] for g in group]) for k in (4, 5, 6, 7, 8))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ths), pa.nulls(len(ids), pa.int64()), pa.array(size), pa.array(known), pa.array(base), pa.array((lp + fixed) / LN10)], names)

        held = 0
        for b in batches(it, "text"):
            w = tx.Words(b.column(1))
            at, (inputs, target_c, target_w), size, cls = sequences(w, voc)
            got = at >= 0
            rare = got & (cls >= voc.classes)
            base = np.bincount(w.doc[got], weights=voc.base(voc.count[at[got]]), minlength=w.n_docs) + voc.base(np.array([voc.ends]))
            fixed = np.bincount(w.doc[rare], weights=in_class[at[rare]] - log_mass[cls[rare] - voc.classes], minlength=w.n_docs)
            known = np.bincount(w.doc[got], minlength=w.n_docs) + int(voc.ends > 0)
            ids, ths = pc.fill_null(b.column(0), -(2**63)).to_numpy(), b.column(2).to_numpy()
            group.append((inputs, target_c, target_w, size, ids, ths, base, known, fixed))
            held += int(size.sum())
            lost = np.flatnonzero(~got)
            if len(lost):
                order = lost[np.lexsort((w.hash[lost], w.doc[lost]))]
                new = np.ones(len(order), bool)
                new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
                one = order[new]
                n = np.diff(np.append(np.flatnonzero(new), len(order)))
                d = w.doc[one]
                yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(ths[d]), pa.array(tx.signed(w.hash[one])), pa.array(n), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.float64()), pa.array(log_mass[cls[one] - voc.classes] / LN10)], names)
            if held >= most_words:
                yield flush()
                group.clear()
                held = 0
        if group:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, OUT)


def language_model_scores(docs: DataFrame, top: int = 1 << 18, frequent: int = 1024, rate: float = 1.0, rounds: int = 2, most_langs: int = 8) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    docs = docs.select("doc_id", "text", "lang")
    training = docs.filter(~held)
    voc, counts = build_vocabulary(training, top, frequent, most_langs)
    net = train(training, voc, rate, rounds)
    rows = written(score_texts(docs, voc, net), "lm-rows")
    rare = rows.filter("h IS NOT NULL").select("doc_id", "th", "h", "n", "score")
    c = F.coalesce("c", F.lit(0))
    denominator = voc.n + 0.1 * (voc.v + 1)
    rare = rare.join(counts.select("h", "c"), "h", "left").groupBy("doc_id", "th").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("r_known"),
        F.sum(F.col("n") * F.log10((c + 0.1) / denominator)).alias("r_base"),
        F.sum(F.col("n") * (F.log10(c + 0.1) - F.col("score"))).alias("r_score"),
    )
    # Rows that repeat a document have equal values; its rare words came once for each.
    whole = rows.filter("h IS NULL").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("copies"), *[F.first(k).alias(k) for k in ("n", "known", "base", "score")])
    out = whole.join(rare, ["doc_id", "th"], "left")
    more = lambda k: F.coalesce(F.col(k) / F.col("copies"), F.lit(0.0))
    out = out.withColumn("doc_id", F.when(F.col("doc_id") > -(2**63), F.col("doc_id")))
    return out.select("doc_id", held.alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + more("r_known").cast("long")).alias("n_known"), F.lit(int(voc.n)).cast("long").alias("train_tokens"), (F.col("base") + more("r_base")).alias("base_score"), (F.col("score") + more("r_score")).alias("score"))


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
