"""Approximate nearest neighbours over learned partitions.

On a bounded sample (about `fit_rows` vectors, those of smallest hashes of vec_id) a neighbour graph is built by
brute force and cut into balanced parts: capacity-bounded assignment to cluster centres, then capacity-bounded label
propagation along the graph. A small network learns the parts of a vector's neighbours. Every row is indexed in its
most probable part; a query goes to as many parts as hold `goal` of the true neighbours of a quarter of the sample
that neither graph, parts nor network have seen, and is ranked there by exact cosine in double precision. There are
two parts at least; a part holds about four times the square root of all rows, until the sample bounds their number
(16 rows of it a part), from where on parts grow with the rows.

Rows of a part are dealt into blocks by hash. A task reads a block's index rows, which it holds, and then the
queries that visit the part, which stream past, so that neither a large part nor many queries fill a task, and no
index row is copied. Each block returns its best k for a query, which are merged.

Defined results: vectors that are null, empty, zero, of another length than most of the sample, or hold null or
non-finite components take no part, neither as query nor as candidate; ties go to the smaller vec_id; equal
vectors are candidates like others; a query's own vec_id is never returned; rows that repeat a vec_id are one
candidate and one query, with the largest score among their rows; with fewer than k candidates all are returned
that the visited parts hold; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellumen.llm.common import table, written


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def neighbour_graph(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Numbers of the k nearest rows of each row of unit vectors, itself left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), block):
        s = x[i : i + block] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _within_capacity(score: np.ndarray, capacity: int) -> np.ndarray:
    """Rows to parts by score, surest rows first, at most `capacity` rows a part."""
    best = np.sort(score, axis=1)
    order = np.argsort(-(best[:, -1] - best[:, -2]), kind="stable") if score.shape[1] > 1 else np.arange(len(score))
    room, out = np.full(score.shape[1], capacity), np.empty(len(score), np.int64)
    rank = np.argsort(-score, axis=1, kind="stable")
    for r in order:
        for part in rank[r]:
            if room[part]:
                out[r], room[part] = part, room[part] - 1
                break
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    capacity = int(np.ceil(len(x) / parts * slack))
    centre = x[rng.choice(len(x), parts, replace=False)]
    for _ in range(rounds):
        part = _within_capacity(x @ centre.T, capacity)
        for p in range(parts):
            if (part == p).any():
                centre[p] = x[part == p].mean(axis=0)
        centre = _unit(centre)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
        part = _within_capacity(votes + 1e-3 * (x @ centre.T) + 0.5 * np.eye(parts)[part], capacity)
    return part


class Router:
    """One hidden layer, trained on the parts of each vector's neighbours (itself included)."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, steps: int = 800, batch: int = 256, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, p = x.shape[1], target.shape[1]
        w = [rng.normal(0, np.sqrt(2 / d) * np.sqrt(d) / 4, (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, p)), np.zeros(p)]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for t in range(1, steps + 1):
            at = rng.integers(0, len(x), min(batch, len(x)))
            a = x[at] @ w[0] + w[1]
            h = np.maximum(a, 0)
            z = h @ w[2] + w[3]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (q / q.sum(axis=1, keepdims=True) - target[at]) / len(at)
            dh = (dz @ w[2].T) * (a > 0)
            for k, g in enumerate((x[at].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] -= 0.005 * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
        self.w = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]


def fit_index(x: np.ndarray, parts: int, goal: float, k: int = 5) -> tuple[Router, int]:
    """The router and how many parts a query visits, measured on the last quarter of x, which is not fitted on."""
    x = _unit(x)
    fit = x[: max(2, len(x) - len(x) // 4)]
    graph = neighbour_graph(fit, 10)
    part = balanced_partition(fit, graph, parts)
    target = np.zeros((len(fit), parts))
    np.add.at(target, (np.repeat(np.arange(len(fit)), graph.shape[1]), part[graph].ravel()), 1.0 / max(1, graph.shape[1]))
    target = 0.5 * target + 0.5 * np.eye(parts)[part]
    router = Router(fit, target)
    scores = router.scores(x)
    home = scores.argmax(axis=1)
    place = np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1)
    near = neighbour_graph(x, k)
    at = np.take_along_axis(place, home[near], axis=1)[len(fit) :]
    visits = next(m for m in range(1, parts + 1) if m == parts or (len(at) and (at < m).mean() >= goal))
    return router, visits


def _valid(col: Column) -> Column:
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return col.isNotNull() & (F.size(col) > 0) & ~F.exists(col, bad) & F.exists(col, lambda v: v != 0)


class Block:
    """Index rows of one block, by vec_id; rows of one vec_id count as one candidate."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.norm = rows[order], np.sqrt((rows[order] * rows[order]).sum(axis=1))
        self.ids, self.first = np.unique(ids[order], return_index=True)
        self.end = np.append(self.first[1:], len(ids))

    def best(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
        """query, candidate, score of the best k candidates of each query; exact scores, ties to smaller ids."""
        out, norm = ([], [], []), np.sqrt((q * q).sum(axis=1))
        for i in range(0, len(q), 256):
            s = (q[i : i + 256] @ self.rows.T) / np.outer(norm[i : i + 256], self.norm)
            if len(self.ids) < len(self.rows):
                s = np.maximum.reduceat(s, self.first, axis=1)
            s[ids[i : i + 256, None] == self.ids[None, :]] = -np.inf
            for a in range(len(s)):
                floor = np.partition(s[a], -k)[-k] if len(self.ids) > k else -np.inf
                at = np.flatnonzero((s[a] >= floor - 1e-9) & (s[a] > -np.inf))
                exact = np.array([self._exact(c, q[i + a], norm[i + a]) for c in at])
                pick = np.lexsort((self.ids[at], -exact))[:k] if len(at) else []
                out[0].extend([ids[i + a]] * len(pick)), out[1].extend(self.ids[at[pick]]), out[2].extend(exact[pick])
        return out

    def _exact(self, c: int, q: np.ndarray, norm: float) -> float:
        rows = slice(self.first[c], self.end[c])
        return float(((self.rows[rows] * q).sum(axis=1) / (self.norm[rows] * norm)).max())


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, fit_rows: int = 8192, part_rows: int | None = None, goal: float = 0.97, block: int = 32768) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id, embedding."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & _valid(F.col("v")))
    done = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(done)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    # The share of hashes that holds the sample: a sort with a limit would send `fit_rows` vectors from every task.
    cut = min(1 << 20, -(-(1 << 20) * fit_rows // max(1, rows.count())) + 1)
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < cut).withColumn("o", F.xxhash64(F.lit(3), "vec_id")).collect()
    sample = sorted(sample, key=lambda r: (r.o, r.vec_id))
    if len(sample) < 2:
        return ranked(spark.createDataFrame([], schema))
    sizes, times = np.unique([len(r.v) for r in sample], return_counts=True)
    dim = int(sizes[times.argmax()])
    x = np.array([r.v for r in sample if len(r.v) == dim])
    if len(x) < 2:
        return ranked(spark.createDataFrame([], schema))
    rows = rows.filter(F.size("v") == dim)
    n = rows.count()
    parts = int(max(2, min(n // (part_rows or max(1, int(4 * n**0.5))), len(x) // 16)))
    router, visits = fit_index(x, parts, goal, k)

    def matrix(column: pa.Array, n: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(n, dim)

    def route(it, most):
        for b in it:
            if b.num_rows:
                best = np.argsort(-router.scores(_unit(matrix(b.column(1), b.num_rows))), axis=1, kind="stable")[:, :most]
                at = pa.array(np.repeat(np.arange(b.num_rows), best.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(best.ravel(), pa.int32())], ["vec_id", "v", "part"])

    routed = "vec_id long, v array<double>, part int"
    index = written(rows.mapInArrow(lambda it: route(it, 1), routed), "ann-index")
    # One row a part: a fixed number.
    blocks = {int(r.part): int(-(-r.n // block)) for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    count = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
    salt = F.pmod(F.xxhash64("vec_id"), count[F.col("part")]).cast("int").alias("salt")
    every = F.explode(F.sequence(F.lit(0), count[F.col("part")].cast("int") - 1)).alias("salt")
    asked = rows.filter(is_query).mapInArrow(lambda it: route(it, visits), routed).filter(count[F.col("part")].isNotNull())
    both = index.select("part", salt, F.lit(0).alias("kind"), "vec_id", "v").unionByName(asked.select("part", every, F.lit(1).alias("kind"), "vec_id", "v"))

    def search(it):
        now, held = None, None
        for b in it:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in range(3)])
            cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), b.num_rows]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                part, salt, kind = keys[:, i]
                ids, v = b.column(3).to_numpy()[i:j], matrix(b.column(4).slice(i, j - i), j - i)
                if now != (part, salt):
                    now, held = (part, salt), []
                if kind == 0:
                    held.append((ids, v))
                    continue
                if isinstance(held, list):
                    held = Block(*(np.concatenate(c) for c in zip(*held, strict=True))) if held else None
                if held is not None:
                    out = held.best(ids, v, k)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = both.repartition("part", "salt").sortWithinPartitions("part", "salt", "kind").mapInArrow(search, schema)
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))


def op10_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
