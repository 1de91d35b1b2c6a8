"""Near-duplicate detection with HyperMinHash sketches.

One pass makes each document's set of word-shingle hashes. The top bits of a hash choose one of 256 buckets;
of each bucket's smallest hash the register keeps the count of leading zeros (6 bits) and the next 10 bits as
mantissa. Empty buckets are densified: each borrows from the non-empty bucket that comes first in a fixed random
order of its own, so small sets collide with probability close to their Jaccard similarity as well.
Documents with equal sets are one class. Classes are banded on compressed registers; each member of a band is
compared with two pivots (the smallest id, and the first in a hash order), never all pairs, and what stays in
different components is then compared across components (bands of more than `small` members in blocks, of which
only links leave). Candidates pass the collision-corrected estimate with
a margin of five standard deviations, then are confirmed on full sets made from the whole texts again.

Chance of missing a pair at the threshold by banding: below 1e-6 for 0.85 (7 registers a band, 36 bands) and
3e-6 for 0.8 (6 and 42).

Defined results: null and empty texts have an empty set, are linked with nothing and are their own component;
texts of fewer words than a shingle have their whole word sequence as one shingle; rows that repeat a doc_id
with the same set give one row; rows of one doc_id with different sets are one document, which has the links of
all its texts, and give a row for each set; extra columns are ignored; an empty table gives no rows. doc_id null
rows are left out of linking and returned with a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellumen.llm import textops as tx
from tellumen.llm.common import batches, table, written
from tellumen.llm.components import connected_components

BUCKET_BITS, LZ_BITS, MANTISSA_BITS = 8, 6, 10
BUCKETS = 1 << BUCKET_BITS
U = np.uint64
#: A random order of all buckets for each bucket, for densification.
PRIORITY = np.argsort(np.argsort(tx.coefficients(BUCKETS * BUCKETS, salt=7).reshape(BUCKETS, BUCKETS), axis=1), axis=1)


def encode(lowest: np.ndarray) -> np.ndarray:
    """Registers of the smallest hash in each bucket: leading zeros after the bucket bits, then mantissa."""
    rest = lowest << U(BUCKET_BITS)
    width = np.frexp(np.maximum(rest, U(1)).astype(np.float64))[1]
    lz = np.minimum(64 - width, (1 << LZ_BITS) - 1).astype(U)
    mantissa = (rest << np.minimum(lz + U(1), U(63))) >> U(64 - MANTISSA_BITS)
    return ((lz << U(MANTISSA_BITS)) | mantissa).astype(np.uint16)


def sketch(unique_sorted: np.ndarray) -> np.ndarray:
    """256 registers of a non-empty sorted set of hashes."""
    bucket = (unique_sorted >> U(64 - BUCKET_BITS)).astype(np.int64)
    filled, first = np.unique(bucket, return_index=True)
    out = np.zeros(BUCKETS, np.uint16)
    out[filled] = encode(unique_sorted[first])
    if len(filled) < BUCKETS:
        empty = np.setdiff1d(np.arange(BUCKETS), filled, assume_unique=True)
        out[empty] = out[filled[np.argmin(PRIORITY[np.ix_(empty, filled)], axis=1)]]
    return out


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from matching registers, less the matches expected by accident: two independent
    minima share leading zeros and mantissa with chance 0.7213 nm / (n + m)^2 / 2^mantissa."""
    match = (x == y).mean(axis=1)
    accident = 0.7213 * n * m / (n + m) ** 2 / (1 << MANTISSA_BITS)
    return (match - accident) / (1 - accident)


def _sets(arr: pa.Array, ngram: int) -> Iterator[np.ndarray]:
    w = tx.Words(arr)
    s, begin = tx.shingles(w, ngram)
    for k in range(w.n_docs):
        yield np.unique(s[begin[k] : begin[k + 1]])


def sketches(docs: DataFrame, ngram: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (a 128-bit digest of the set), regs."""

    def run(it):
        for b in batches(it, "text"):
            n, d1, d2, regs = [], [], [], []
            for u in _sets(b.column(1), ngram):
                n.append(len(u))
                with np.errstate(over="ignore"):
                    d1.append(tx.mix(u).sum(dtype=U))
                    d2.append(tx.mix(u ^ U(0x5851F42D4C957F2D)).sum(dtype=U))
                regs.append(sketch(u).tobytes() if len(u) else None)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(tx.signed(np.array(d1, U))), pa.array(tx.signed(np.array(d2, U))), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "regs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, regs binary")


def bands(classes: DataFrame, rows: int) -> DataFrame:
    """band (hash of the band's number and registers), rep, n."""
    count = BUCKETS // rows
    coef = tx.coefficients(count * rows, salt=11).reshape(1, count, rows)

    def run(it):
        for b in it:
            if b.num_rows:
                for c in (b.slice(i, 2048) for i in range(0, b.num_rows, 2048)):
                    regs = np.frombuffer(b"".join(c.column(2).to_pylist()), np.uint16).reshape(c.num_rows, BUCKETS)
                    with np.errstate(over="ignore"):
                        h = tx.mix(((regs[:, : count * rows].reshape(-1, count, rows).astype(U) + U(1)) * coef).sum(axis=2, dtype=U) + np.arange(count, dtype=U) * U(0x9E3779B97F4A7C15))
                    rep = np.repeat(c.column(0).to_numpy(), count)
                    n = np.repeat(c.column(1).to_numpy(), count)
                    yield pa.RecordBatch.from_arrays([pa.array(tx.signed(h.ravel())), pa.array(rep), pa.array(n)], ["band", "rep", "n"])

    return classes.select("rep", "n", "regs").mapInArrow(run, "band long, rep long, n long")


def _similar_size(n: str, m: str, percent: int):
    return (F.least(n, m) * 100) >= (F.greatest(n, m) * percent)


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose corrected estimate is within five standard deviations of the threshold or above it."""
    side = lambda k: classes.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("regs").alias(f"r_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    t = percent / 100

    def run(it):
        for big in it:
            for b in (big.slice(i, 4096) for i in range(0, big.num_rows, 4096)):
                get = lambda k, b=b: b.column(b.schema.get_field_index(k))
                x, y = (np.frombuffer(b"".join(get(k).to_pylist()), np.uint16).reshape(b.num_rows, BUCKETS) for k in ("r_a", "r_b"))
                n, m = (get(k).to_numpy().astype(float) for k in ("n_a", "n_b"))
                free = np.minimum(np.minimum(n, m), BUCKETS)
                ok = estimate(x, y, n, m) >= t - 5 * np.sqrt(t * (1 - t) / free)
                yield pa.RecordBatch.from_arrays([get("a").filter(pa.array(ok)), get("b").filter(pa.array(ok))], ["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |A and B| >= percent * |A or B| on full sets."""
    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(it):
        for b in batches(it, "t_a"):
            ok = []
            for u, v in zip(_sets(b.column(2), ngram), _sets(b.column(3), ngram), strict=True):
                inter = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(100 * inter >= percent * (len(u) + len(v) - inter) and inter > 0)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return both.select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long")


def _groups(it, keys: int) -> Iterator[pa.Table]:
    """Tables of adjacent rows that agree in the first `keys` columns."""
    held: list = []
    for b in it:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(keys)])
        cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1), b.num_rows]
        if held and any(held[-1].column(i)[0].as_py() != b.column(i)[0].as_py() for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            held.append(b.slice(i, j - i))
            if j < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def across(members: DataFrame, texts: DataFrame, ngram: int, percent: int, block: int = 1024) -> DataFrame:
    """Links between different components of one band. members: band, rep, n, c, m (the band's size). A band's
    members are dealt into blocks and every two blocks meet in a task; only links leave it. The sets are exact."""
    blocks = F.ceil(F.col("m") / block).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "rep", "c")
    dealt = dealt.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("band", "bi", "bj", "own", "rep", "c", "text")
    dealt = dealt.repartition("band", "bi", "bj").sortWithinPartitions("band", "bi", "bj")

    def run(it):
        for t in _groups(it, 3):
            bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
            own, rep, c = (t.column(k).to_numpy() for k in ("own", "rep", "c"))
            sets = [u for b in batches(iter(t.to_batches()), "text") for u in _sets(b.column(6), ngram)]
            size = np.array([len(u) for u in sets])
            begin = np.cumsum(size) - size
            vals, at = np.unique(np.concatenate(sets), return_inverse=True)
            comps, times = np.unique(c, return_counts=True)
            found = set()
            for i in np.flatnonzero(c != comps[times.argmax()]):
                mark = np.zeros(len(vals), np.int64)
                mark[at[begin[i] : begin[i] + size[i]]] = 1
                inter = np.add.reduceat(mark[at], begin)
                ok = (100 * inter >= percent * (size + size[i] - inter)) & (c != c[i])
                if bi != bj:
                    ok &= own != own[i]
                found.update((min(rep[i], rep[j]), max(rep[i], rep[j])) for j in np.flatnonzero(ok))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _one_document(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of doc_ids that have several sets; rarely any."""
    several = sets.groupBy("doc_id").agg(F.collect_set(F.struct("d1", "d2", F.col("n_shingles").alias("n"))).alias("c")).filter(F.size("c") > 1)
    several = several.select("doc_id", F.explode("c").alias("c")).select("doc_id", "c.*")
    reps = several.join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"]).select("doc_id", "rep")
    least = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return reps.join(least, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, ngram: int = 5, percent: int = 80, rows: int | None = None, small: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of the graph that links documents whose shingle sets
    reach `percent`, confirmed on full sets."""
    rows = rows or (7 if percent >= 85 else 6)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = written(sketches(docs, ngram).dropDuplicates(["doc_id", "d1", "d2", "n_shingles"]), "mh-sketch")
    sets = sk.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(sets.groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs")), "mh-class")
    banded = written(bands(classes, rows), "mh-band")
    pivots = banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.struct("rep", "n")).alias("p0"),
        F.min(F.struct(F.xxhash64(F.lit(1), "rep").alias("o"), "rep", "n")).alias("p1"),
    ).filter("members > 1")
    near = banded.join(pivots, "band")
    near = near.select("band", "rep", "n", F.explode(F.array(*[F.struct(F.col(f"p{k}.rep").alias("rep"), F.col(f"p{k}.n").alias("n")) for k in range(2)])).alias("p"))
    order = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    first = near.filter((F.col("rep") != F.col("p.rep")) & _similar_size("n", "p.n", percent)).select(*order("rep", "p.rep")).distinct()
    first = written(estimated(first, classes, percent), "mh-pairs")
    hot = banded.join(pivots.select("band"), "band", "left_semi").select("rep").distinct()
    texts = docs.join(hot.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    texts = written(texts.withColumn("th", F.xxhash64("text")).dropDuplicates(["doc_id", "th"]).drop("th"), "mh-text")
    links = written(confirmed(first, texts, ngram, percent).distinct().unionByName(_one_document(sets, classes)), "mh-links")
    labels = connected_components(links)
    # What pivots have not joined: members of one band in different components. Bands with equal members count once.
    named = written(banded.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component"), "mh-named")
    mixed = named.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"), *[F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"s{k}") for k in (1, 2)])
    mixed = written(mixed.filter("lo < hi").dropDuplicates(["m", "s1", "s2"]).select("band", "m"), "mh-mixed")
    x, y = (named.join(mixed.filter(F.col("m") <= small), "band").alias(k) for k in "xy")
    cross = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.c") < F.col("y.c")) & _similar_size("x.n", "y.n", percent))
    cross = cross.select(*order("x.rep", "y.rep")).distinct().join(first, ["a", "b"], "left_anti")
    more = confirmed(written(estimated(cross, classes, percent), "mh-cross"), texts, ngram, percent)
    more = written(more.unionByName(across(named.join(mixed.filter(F.col("m") > small), "band"), texts, ngram, percent)), "mh-links")
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))
    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(named, ["d1", "d2", "n_shingles"], "left").select("doc_id", "n_shingles", "component_id")
    lone = sk.filter("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), ngram=3, percent=85)
