"""Line dedup with content-defined chunks of lines.

Lines are hashed; a rolling hash over the last two line hashes ends a chunk where it hits a fixed residue, so
boundaries depend on nearby lines alone and survive insertions elsewhere. A line of `long_words` words or more
is a chunk of its own. Beside the chunks, every line opens and closes a window: the fewest lines from it on, or
up to it, that hold `long_words` words. A window depends on its own lines alone, and the windows inside a shared
run of whole lines with `long_words` words or more cover all of the run's lines that have words, whatever stands
before and after it. Windows, and chunks that span two lines or hold a long line, are candidates where they occur
more than once in the corpus: the first occurrence (smallest doc_id, then position) is left, the lines of every
other one are removed after its bytes have been compared with the first's. Each removed line thus has an equal
one at an earlier place, and the first of equal lines is never removed. An occurrence that overlaps the first one
in its own document loses only the lines behind it. A passage that fills only a part of its line is no candidate,
and neither are lines without any word; no chunk is too short otherwise.

Passes: (1) hashes of every document's chunks and windows; (2) a count by hash; (3) the candidates' bytes against
the first occurrence's; (4) the removal, joined by doc_id. Texts move by doc_id once, candidate bytes by hash once;
chunks that hold a large share of all occurrences are broadcast and salted instead.

Defined results: null text stays null with no chunks; empty text has one empty line, never removed; rows that
repeat a doc_id are told apart by their text's hash, and of equal rows the first chunk stays in each; a document
all of whose chunks go has the empty text; an empty table gives no rows; other columns pass through, also such
as clash with internal names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellumen.llm import textops as tx
from tellumen.llm.common import batches, table, written

U = np.uint64
BASE, BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class Chunks:
    """Chunks and lines of one slice of texts, and the runs of lines that can be removed, with byte ranges and hashes."""

    def __init__(self, arr: pa.Array, mean: int, long_words: int):
        data, off = tx.buffers(arr)
        n_docs = len(off) - 1
        # Lines: a break at each LF and at each document's end.
        lf = np.flatnonzero(data == 10)
        doc_of_lf = np.searchsorted(off, lf, side="right") - 1
        doc = np.concatenate([np.arange(n_docs), doc_of_lf])
        begin, end = np.concatenate([off[:-1], lf + 1]), np.concatenate([off[1:], lf])
        begin, end = begin[np.lexsort((begin, doc))], end[np.lexsort((end, doc))]
        doc = np.sort(doc)
        inside = data != 10
        h = np.full(len(begin), tx.mix(U(1)), U)
        full = end > begin
        h[full] = tx.span_hash(data, inside, begin[full], end[full])
        word = tx.Words(arr, lower=False)
        words = np.searchsorted(word.start, end) - np.searchsorted(word.start, begin)
        first = np.ones(len(begin), bool)
        first[1:] = doc[1:] != doc[:-1]
        with np.errstate(over="ignore"):
            roll = tx.mix(h + np.where(first, U(0), np.roll(h, 1)) * U(0x9E3779B97F4A7C15))
        long = words >= long_words
        stop = (roll % U(mean) == 0) | long
        opens = first.copy()
        opens[1:] |= stop[:-1] | long[1:]
        at = np.flatnonzero(opens)
        last = np.append(at[1:], len(begin)) - 1
        self.data, self.begin, self.end = data, begin, end
        #: Each document's first line and first chunk, n_docs + 1 each; each chunk's first line.
        self.line = np.searchsorted(doc, np.arange(n_docs + 1))
        self.chunk = np.searchsorted(doc[at], np.arange(n_docs + 1))
        self.opens = at
        # Candidates (first line, last line): chunks of two lines or one long line, and windows.
        total = np.concatenate([[0], np.cumsum(words)])
        able = ((last > at) | long[at]) & (total[last + 1] > total[at])
        some = np.flatnonzero(words > 0)
        to = np.searchsorted(total, total[some] + long_words) - 1
        since = np.searchsorted(total, total[some + 1] - long_words, side="right") - 1
        ahead = to < self.line[doc[some] + 1]
        behind = since >= self.line[doc[some]]
        i = np.concatenate([at[able], some[ahead], since[behind]])
        j = np.concatenate([last[able], to[ahead], some[behind]])
        wide = j > i
        wide[: int(able.sum())] = True
        self.i, self.j = np.divmod(np.unique(i[wide] * len(begin) + j[wide]), max(1, len(begin)))
        self.n_bytes = end[self.j] - begin[self.i]
        self.of = doc[self.i]
        # A run's hash from sums of line hashes times powers of an odd number, moved back by the power's inverse.
        with np.errstate(over="ignore"):
            power, back = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(len(begin), x, U)])) for x in (BASE, BACK))
            acc = np.concatenate([np.zeros(1, U), np.add.accumulate(h * power[:-1])])
            self.hash = tx.mix((acc[self.j + 1] - acc[self.i]) * back[self.i] + (self.j - self.i + 1).astype(U))


def _key(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))


def dedup_lines(docs: DataFrame, mean: int = 3, long_words: int = 50, hot_share: int = 2000, salts: int = 32) -> DataFrame:
    """docs with `text` replaced, plus ld_chunks and ld_removed (chunks in all, chunks that lost lines)."""
    args = (mean, long_words)

    def hashes(it):
        for b in batches(it, "text"):
            c = Chunks(b.column(1), *args)
            d = pa.array(c.of)
            pos, n = c.i - c.line[c.of], c.j - c.i + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(d), b.column(2).take(d), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(tx.signed(c.hash)), pa.array(c.n_bytes)], ["doc_id", "th", "pos", "n", "h", "n_bytes"])

    keyed = _key(docs)
    occ = written(keyed.filter("text IS NOT NULL").mapInArrow(hashes, "doc_id long, th long, pos int, n int, h long, n_bytes long"), "ld-chunks")
    multi = occ.groupBy("h", "n_bytes").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("doc_id", "th", "pos")).alias("first")).filter("k > 1")
    multi = written(multi, "ld-multi")
    # Chunks that hold one in hot_share of all occurrences, so fewer than hot_share of them, are broadcast to their
    # occurrences; those of all others are too few to fill a task.
    much = multi.agg(F.sum("k")).first()[0] or 0
    hot = F.broadcast(multi.filter(F.col("k") * hot_share > much).withColumn("hot", F.lit(True)))
    cold = multi.filter(F.col("k") * hot_share <= much).withColumn("hot", F.lit(False))
    keys = ["h", "n_bytes"]
    found = occ.join(hot, keys).unionByName(occ.join(hot, keys, "left_anti").join(cold, keys))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    skip = F.when(own, F.greatest(F.lit(0), F.col("first.pos") + F.col("n") - F.col("pos"))).otherwise(0)
    cand = found.select("doc_id", "th", F.struct("pos", "n", "h", (own & (F.col("pos") == F.col("first.pos"))).alias("one"), skip.alias("skip"), "hot").alias("c"))
    cand = written(cand.groupBy("doc_id", "th").agg(F.collect_list("c").alias("cs")), "ld-cand")

    def bytes_of(it):
        for b in batches(it, "text"):
            c = Chunks(b.column(1), *args)
            rows = [[], [], [], [], [], [], [], []]
            for k, (doc, th, cs) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                for x in cs:
                    i = c.line[k] + x["pos"]
                    body = c.data[c.begin[i] : c.end[i + x["n"] - 1]].tobytes()
                    for col, v in zip(rows, (doc, th, x["pos"] + x["skip"], x["pos"] + x["n"], x["h"], x["one"], x["hot"], body), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()), strict=True)], ["doc_id", "th", "pos", "stop", "h", "one", "hot", "body"])

    null_safe = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["th"] == y["th"])
    both = keyed.join(cand, null_safe(keyed, cand), "inner").select(keyed["doc_id"], "text", keyed["th"], "cs")
    body = written(both.mapInArrow(bytes_of, "doc_id long, th long, pos int, stop int, h long, one boolean, hot boolean, body binary"), "ld-bytes")
    # The first occurrence's bytes meet the others' by hash; a hot chunk's in `salts` tasks.
    salt = lambda spread: F.when(F.col("hot"), spread).otherwise(0).cast("int")
    ones = body.filter("one").dropDuplicates(["h"]).select("h", F.explode(F.sequence(F.lit(0), salt(F.lit(salts - 1)))).alias("salt"), F.col("body").alias("kept_body"))
    gone = body.filter("NOT one").withColumn("salt", salt(F.pmod(F.xxhash64("doc_id", "pos"), F.lit(salts)))).join(ones, ["h", "salt"]).filter("body = kept_body").groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "stop")).alias("gone"))
    names = [f"ld_{k}_{c}" for k, c in enumerate(docs.columns)]
    wide = docs.toDF(*names).withColumns({"ld__id": F.col(names[docs.columns.index("doc_id")]).cast("long"), "ld__th": F.xxhash64(names[docs.columns.index("text")])})
    wide = wide.join(gone.withColumnsRenamed({"doc_id": "g_id", "th": "g_th"}), F.col("ld__id").eqNullSafe(F.col("g_id")) & (F.col("ld__th") == F.col("g_th")), "left")
    text = names[docs.columns.index("text")]

    def cut(it):
        for b in batches(it, text):
            col = b.column(b.schema.get_field_index(text))
            c = Chunks(col, *args)
            new, total, removed = [], [], []
            for k, gone_k in enumerate(b.column(b.schema.get_field_index("gone")).to_pylist()):
                if not col[k].is_valid:
                    new.append(None), total.append(0), removed.append(0)
                    continue
                total.append(int(c.chunk[k + 1] - c.chunk[k]))
                if not gone_k:
                    new.append(col[k].as_py()), removed.append(0)
                    continue
                at, n = c.line[k], c.line[k + 1] - c.line[k]
                drop = np.zeros(n, bool)
                for x in gone_k:
                    drop[x["pos"] : x["stop"]] = True
                removed.append(int(np.logical_or.reduceat(drop, c.opens[c.chunk[k] : c.chunk[k + 1]] - at).sum()))
                kept = [c.data[c.begin[i] : c.end[i]].tobytes() for i in at + np.flatnonzero(~drop)]
                new.append(b"\n".join(kept).decode())
            cols = [pa.array(new, col.type) if n == text else b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, "ld__total", "ld__removed"])

    fields = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True))
    out = wide.select(*names, "gone").mapInArrow(cut, f"{fields}, ld__total long, ld__removed long")
    return out.toDF(*docs.columns, "ld_chunks", "ld_removed")


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
