"""Quality by an interpolated modified Kneser-Ney bigram model trained on trusted text.

Trusted text: documents labelled quality 1. N-grams are counted on four fifths of them, by the hash of doc_id; the
other fifth is held out for the languages' means and thresholds, so that each trusted document is in one or the
other. Words are the `vocab` most frequent of the counting part; all others share one symbol, whose probability is
divided by the number of word types it stands for. N-gram counts, context totals, continuation counts and the three
discounts come from Spark aggregations. Texts meet their labels in a join; a bit table of fixed size, broadcast,
keeps most texts without a label out of its shuffle.

Scoring is a sharded join of counts. The model's n-gram table is cut into shards by n-gram hash; each slice of
documents sends one packed row of n-gram codes to each shard and gets one packed row of partial sums back, which
are added per slice. The interpolated lower order needs only vectors of vocabulary size and is added before the
join; the `hot` most frequent n-grams (a fixed number) are looked up there too, so that no shard is hot.
A document's mean log probability, shrunk by `prior` tokens to its language's mean, is compared with a low
quantile of the held-out trusted documents of its language. Mean and quantile of a language with k of these move
to those of all languages by the weight 1 - k / `least`, which ends at `least` documents, where they are its own.

Defined results: null and empty texts have no tokens and are rejected; null lang is a language of its own;
rows that repeat doc_id and text give one row; without trusted documents everything with words is kept; an empty
table gives no rows; extra columns are ignored. Long texts are read whole, one at a time at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellumen.llm import textops as tx
from tellumen.llm.common import batches, table, written

U = np.uint64


def _symbols(w: tx.Words, index: tx.HashIndex, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and left context of each word: 0..vocab-1 known words, vocab the rest, vocab + 1 a text's begin."""
    at = index.find(w.hash)
    sym = np.where(at < 0, vocab, at)
    left = np.empty_like(sym)
    left[1:] = sym[:-1]
    left[w.first[:-1][np.diff(w.first) > 0]] = vocab + 1
    return sym, left


def _sieve(ids: DataFrame, column: str, most: int = 26) -> np.ndarray:
    """A bit table of two positions per hash in `column`, 16 bits a hash but at most 2 ** most, packed in bytes."""
    bits = min(most, max(16, int(16 * ids.count()).bit_length()))
    at = ids.select(F.explode(F.array(F.col(column), F.shiftright(column, 32))).alias("at")).select(F.col("at").bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    got = at.groupBy(F.shiftright("at", 3).cast("int").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, CAST(at & 7 AS INT))")).alias("set")).toArrow()
    table_ = np.zeros(1 << (bits - 3), np.uint8)
    table_[got.column("byte").to_numpy()] = got.column("set").to_numpy()
    return table_


def _sifted(docs: DataFrame, column: str, sieve: np.ndarray) -> DataFrame:
    """The rows whose hash in `column` has both positions set: all that the sieve was made from, and a few more."""

    def run(it):
        mask = len(sieve) * 8 - 1
        for b in batches(it, "text"):
            h = b.column(b.schema.get_field_index(column)).to_numpy()
            hit = np.ones(len(h), bool)
            for at in (h & mask, (h >> 32) & mask):
                hit &= (sieve[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            if hit.any():
                yield b.filter(pa.array(hit))

    return docs.mapInArrow(run, docs.schema)


def _most_frequent(counts: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows of largest c, ties to the smaller key. Only rows of the sixteenths of an octave of c that reach k
    are sorted, so that not every partition sends k rows."""
    step = F.floor(F.log2("c") * 16)
    have = 0
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.s):
        have += r.n
        if have >= k:
            counts = counts.filter(step >= r.s)
            break
    return counts.orderBy(F.desc("c"), key).limit(k)


def _word_counts(texts: DataFrame) -> DataFrame:
    def run(it):
        for b in batches(it, "text"):
            h, c = np.unique(tx.Words(b.column(0)).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(h)), pa.array(c)], ["h", "c"])

    return texts.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _discounts(n: dict) -> np.ndarray:
    """What counts of 0, 1, 2 and 3 or more lose, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (max(1, n.get(k, 0)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0, [0, 0.95, 1.9, 2.8])


class Model:
    """Modified Kneser-Ney: vectors over the vocabulary, discounts, the hottest n-grams."""

    def __init__(self, keys: np.ndarray, types: int):
        self.vocab, self.index = len(keys), tx.HashIndex(keys)
        self.base = self.vocab + 2
        self.spread = np.log(max(1, types - self.vocab) + 1.0)

    def fit(self, grams: DataFrame) -> None:
        v = self.base
        left, right = F.floor(F.col("code") / v), F.col("code") % v
        n = {r.k: r.n for r in grams.groupBy(F.least("c", F.lit(5)).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
        self.discount = _discounts(n)
        d = self.discount
        off = F.when(F.col("c") == 1, float(d[1])).when(F.col("c") == 2, float(d[2])).otherwise(float(d[3]))
        self.total, mass, cont = np.zeros(v), np.zeros(v), np.zeros(v)
        for r in grams.groupBy(left.alias("u")).agg(F.sum("c").alias("c"), F.sum(off).alias("d")).collect():
            self.total[int(r.u)], mass[int(r.u)] = r.c, r.d
        for r in grams.groupBy(right.alias("w")).agg(F.count(F.lit(1)).alias("n")).collect():
            cont[int(r.w)] = r.n
        seen = np.maximum(self.total, 1)
        self.log_back = np.where(self.total > 0, np.log(np.maximum(mass, 1e-9) / seen), 0.0)
        # The lower order has its own discounts, from the counts of continuation counts; it backs off to uniform.
        less = _discounts({k: int((cont == k).sum()) for k in (1, 2, 3, 4)})[np.minimum(cont, 3).astype(int)]
        left_over = np.minimum(less, cont).sum() / max(cont.sum(), 1) if cont.sum() else 1.0
        p = np.maximum(cont - less, 0) / max(cont.sum(), 1) + left_over / (self.vocab + 1)
        self.log_cont = np.log(p)
        self.log_cont[self.vocab] -= self.spread

    def gain(self, code: np.ndarray, c: np.ndarray) -> np.ndarray:
        """What a counted n-gram's log probability has over the interpolated lower order alone."""
        u, w = code // self.base, code % self.base
        own = np.maximum(c - self.discount[np.minimum(c, 3)], 0) / self.total[u]
        # The undivided lower order of the shared symbol: its division applies to the whole probability.
        log_low = self.log_back[u] + self.log_cont[w] + np.where(w == self.vocab, self.spread, 0.0)
        return np.log1p(own / np.exp(log_low))


def fit(texts: DataFrame, vocab: int, hot: int) -> tuple[Model, DataFrame, np.ndarray, np.ndarray]:
    """The model, its n-gram table (code, c), and the hot n-grams' codes and gains. texts: trusted `text`."""
    counts = written(_word_counts(texts), "kn-words")
    top = _most_frequent(counts, "h", vocab).select("h").toPandas()["h"].to_numpy(np.int64)
    model = Model(np.sort(top.view(U)), counts.count())

    def grams(it):
        for b in batches(it, "text"):
            sym, left = _symbols(tx.Words(b.column(0)), model.index, model.vocab)
            code, c = np.unique(left * model.base + sym, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(c, pa.int64())], ["code", "c"])

    table_ = written(texts.select("text").mapInArrow(grams, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")), "kn-grams")
    model.fit(table_)
    first = _most_frequent(table_, "code", hot).toPandas()
    order = np.argsort(first["code"].to_numpy())
    codes = first["code"].to_numpy(np.int64)[order]
    return model, table_, codes, model.gain(codes, first["c"].to_numpy(np.int64)[order])


def _shard(code: np.ndarray, shards: int) -> np.ndarray:
    return (tx.mix(code.astype(U)) % U(shards)).astype(np.int64)


PACK = "shard int, kind int, part int, slice int, keys binary, vals binary, info array<struct<doc_id:long,th:long,lang:string,n:long,base:double>>"


def log_probabilities(docs: DataFrame, model: Model, grams: DataFrame, hot_code: np.ndarray, hot_gain: np.ndarray, shards: int) -> DataFrame:
    """doc_id, th (hash of the text), lang, n (words), logp (natural log)."""
    names = [x.split()[0] for x in PACK.split(", ", 6)]
    types = [pa.int32()] * 4 + [pa.binary()] * 2
    info_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("th", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("base", pa.float64())]))
    hot = tx.HashIndex(np.zeros(0, U)) if not len(hot_code) else None

    def rows(out):
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols[:6], types, strict=True)], pa.array(cols[6], info_type)], names)

    def requests(it):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches(it, "text")):
            w = tx.Words(b.column(1))
            sym, left = _symbols(w, model.index, model.vocab)
            code = left * model.base + sym
            value = model.log_back[left] + model.log_cont[sym]
            ask = model.total[left] > 0
            if hot is None:
                at = np.minimum(np.searchsorted(hot_code, code), len(hot_code) - 1)
                hit = hot_code[at] == code
                value = value + np.where(hit, hot_gain[at], 0.0)
                ask &= ~hit
            base = np.bincount(w.doc, weights=value, minlength=w.n_docs)
            n = np.diff(w.first)
            info = [{"doc_id": d, "th": t, "lang": g, "n": int(c), "base": float(v)} for d, t, g, c, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), n, base, strict=True)]
            out = [((part + k) % shards, 2, part, k, b"", np.zeros(w.n_docs).tobytes(), info)]
            code, doc = code[ask], w.doc[ask]
            to = _shard(code, shards)
            order = np.argsort(to, kind="stable")
            code, doc, to = code[order], doc[order], to[order]
            cut = np.searchsorted(to, np.arange(shards + 1))
            for s in range(shards):
                i, j = cut[s], cut[s + 1]
                if j > i:
                    out.append((s, 1, part, k, code[i:j].astype(np.uint32).tobytes(), np.bincount(doc[i:j], minlength=w.n_docs).astype(np.int32).tobytes(), None))
            yield rows(out)

    def dealt(held):
        code = np.concatenate([k for k, _ in held])
        to, gain = _shard(code, shards), model.gain(code, np.concatenate([c for _, c in held]))
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(shards + 1))
        code, gain = code[order].astype(np.uint32), gain[order].astype(np.float32)
        return rows([(s, 0, 0, 0, code[i:j].tobytes(), gain[i:j].tobytes(), None) for s, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i])

    def pieces(it):
        # About 2 ** 20 n-grams at a time: a row for each shard holds many of them.
        held, n = [], 0
        for b in it:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
                n += b.num_rows
            if n >= 1 << 20:
                yield dealt(held)
                held, n = [], 0
        if held:
            yield dealt(held)

    def answers(it):
        now, code, gain, ready = None, [], [], False
        for b in it:
            out = []
            for s, kind, part, k, keys, vals, info in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if kind == 2:
                    out.append((s, kind, part, k, keys, vals, info))
                    continue
                if s != now:
                    now, code, gain, ready = s, [], [], False
                if kind == 0:
                    code.append(np.frombuffer(keys, np.uint32))
                    gain.append(np.frombuffer(vals, np.float32))
                    continue
                if not ready:
                    code = np.concatenate([*code, np.zeros(0, np.uint32)])
                    gain = np.concatenate([*gain, np.zeros(0, np.float32)])
                    order = np.argsort(code)
                    code, gain, ready = code[order], gain[order].astype(float), True
                ask, per = np.frombuffer(keys, np.uint32), np.frombuffer(vals, np.int32)
                if len(code):
                    at = np.minimum(np.searchsorted(code, ask), len(code) - 1)
                    got = np.where(code[at] == ask, gain[at], 0.0)
                    out.append((s, 3, part, k, b"", np.bincount(np.repeat(np.arange(len(per)), per), weights=got, minlength=len(per)).tobytes(), None))
            if out:
                yield rows(out)

    def total(t: pa.Table) -> pa.Table:
        info = [x for x in t.column("info").to_pylist() if x is not None][0]
        gain = sum(np.frombuffer(x, float) for x in t.column("vals").to_pylist())
        cols = {c: [x[c] for x in info] for c in ("doc_id", "th", "lang", "n")}
        logp = np.array([x["base"] for x in info]) + gain
        return pa.table({"doc_id": pa.array(cols["doc_id"], pa.int64()), "th": pa.array(cols["th"], pa.int64()), "lang": pa.array(cols["lang"], pa.string()), "n": pa.array(cols["n"], pa.int64()), "logp": pa.array(logp)})

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"), "lang").mapInArrow(requests, PACK)
    joined = grams.mapInArrow(pieces, PACK).unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    back = joined.mapInArrow(answers, PACK)
    out = back.groupBy("part", "slice").applyInArrow(lambda t: total(t), "doc_id long, th long, lang string, n long, logp double")
    # Rows that repeat a document have equal values.
    return out.groupBy("doc_id", "th").agg(F.first("lang").alias("lang"), F.first("n").alias("n"), F.first("logp").alias("logp"))


def _low_quantile(held: DataFrame, keys: list[str], low: float, whole: int = 10000) -> DataFrame:
    """keys, cut (the exact quantile `low` of s, interpolated), k (rows). Of a group of more than `whole` rows only
    those up to an approximate quantile well above `low` are gathered."""
    size = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.percentile_approx("s", min(1.0, 2 * low + 0.001), 10000).alias("bound"))
    few = held.join(F.broadcast(size), keys) if keys else held.crossJoin(F.broadcast(size))
    few = few.filter((F.col("k") <= whole) | (F.col("s") <= F.col("bound")))
    at = F.lit(low) * (F.col("k") - 1)
    down = F.floor(at).cast("int")
    value = lambda i: F.get("few", i)
    few = few.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("few"), F.max("k").alias("k"))
    return few.select(*keys, (value(down) + (at - down) * (F.coalesce(value(down + 1), value(down)) - value(down))).alias("cut"), "k")


def classify(docs: DataFrame, labels: DataFrame, fit_docs: int | None = None, vocab: int = 16384, hot: int = 65536, prior: float = 20.0, low: float = 0.003, least: int = 50) -> DataFrame:
    """doc_id, th, lang, n_tokens, log10_prob, perplexity (null without words), shrunk_perplexity (what is compared),
    threshold, kept. docs: doc_id, text, lang. fit_docs: only the smallest so many hashes of doc_id are counted from, and
    all other trusted documents are held out; None: no such bound."""
    shards = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    trusted = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = written(trusted.withColumn("o", F.xxhash64("doc_id")), "kn-trusted")
    counted = trusted
    if fit_docs is not None:
        # Only hashes below a bound that holds `fit_docs` of them, with some to spare, are sorted.
        share = min(1.0, (1.1 * fit_docs + 1000) / max(1, trusted.count()))
        near = trusted.filter(F.col("o") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64))))
        counted = near.orderBy("o", "doc_id").limit(fit_docs)
    counted = counted.filter(F.pmod("o", F.lit(5)) != 0)
    counted = counted if fit_docs is None else written(counted, "kn-counted")
    texts = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("o", F.xxhash64("doc_id"))
    # Written once, since words and n-grams are counted in two passes. The ids grow with the input: no broadcast.
    texts = written(_sifted(texts, "o", _sieve(counted, "o")).join(counted.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select("text"), "kn-texts")
    scores = written(log_probabilities(docs, *fit(texts, vocab, hot), shards), "kn-scores").withColumn("lang", F.coalesce("lang", F.lit("")))
    held = scores.filter("n > 0").join(trusted, "doc_id", "left_semi").join(counted, "doc_id", "left_anti")
    held = written(held.select("lang", "n", "logp"), "kn-held")
    mean = lambda: (F.sum("logp") / F.sum("n")).alias("mu")
    mu = held.groupBy("lang").agg(mean(), F.count(F.lit(1)).alias("k"))
    everywhere = held.agg(mean().alias("mu_all"))
    # A language's own value as far as it has documents, all languages' for the rest.
    own = F.least(F.lit(1.0), F.coalesce("k", F.lit(0)) / F.lit(float(least)))
    blended = lambda x, y: F.when(own > 0, own * F.col(x) + (1 - own) * F.col(y)).otherwise(F.col(y))
    shrunk = (F.col("logp") + prior * F.col("mu")) / (F.col("n") + prior)
    scored = lambda df: df.join(F.broadcast(mu), "lang", "left").crossJoin(F.broadcast(everywhere)).withColumn("mu", blended("mu", "mu_all")).drop("k").withColumn("s", shrunk)
    held = scored(held).select("lang", "s")
    cut = _low_quantile(held, ["lang"], low)
    everywhere_cut = _low_quantile(held, [], low).agg(F.max("cut").alias("cut_all"))
    out = scored(scores).join(F.broadcast(cut), "lang", "left").crossJoin(F.broadcast(everywhere_cut))
    cut = blended("cut", "cut_all")
    return out.select(
        "doc_id",
        "th",
        F.nullif("lang", F.lit("")).alias("lang"),
        F.col("n").alias("n_tokens"),
        (F.col("logp") / float(np.log(10))).alias("log10_prob"),
        F.when(F.col("n") > 0, F.exp(F.least(-F.col("logp") / F.col("n"), F.lit(700.0)))).alias("perplexity"),
        F.exp(F.least(-F.col("s"), F.lit(700.0))).alias("shrunk_perplexity"),
        F.exp(F.least(-cut, F.lit(700.0))).alias("threshold"),
        (F.col("n") > 0) & F.coalesce(F.col("s") >= cut, F.lit(True)),
    ).toDF("doc_id", "th", "lang", "n_tokens", "log10_prob", "perplexity", "shrunk_perplexity", "threshold", "kept")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("th")
