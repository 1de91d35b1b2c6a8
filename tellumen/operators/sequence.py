"""A small recurrent classifier over window tensors: one gated recurrent layer and a linear head, in numpy, trained
where the windows are.

Windows come flattened in full (time-major columns). A hash holds out a validation share of the train windows. In each
round every task trains a few epochs on its own windows from the common parameters with Adam on the cross-entropy,
positives weighted by the ratio of classes; the parameters are averaged, weighted by windows, and the validation loss
decides when to stop and which parameters stay. The driver holds one parameter vector and numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellumen.functions.scalars import zero_missing
from tellumen.session import materialised


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Net:
    """Parameters in one vector: input and recurrent weights of update, reset and candidate, biases, head."""

    def __init__(self, features: int, hidden: int, flat: np.ndarray | None = None, seed: int = 0):
        self.h = hidden
        self.shapes = [(features, 3 * hidden), (hidden, 3 * hidden), (3 * hidden,), (hidden,), (1,)]
        self.flat = np.random.default_rng(seed).uniform(-1, 1, sum(int(np.prod(s)) for s in self.shapes)) / np.sqrt(hidden) if flat is None else flat.copy()

    def views(self, flat: np.ndarray) -> list[np.ndarray]:
        cut = np.cumsum([0, *[int(np.prod(s)) for s in self.shapes]])
        return [flat[a:b].reshape(s) for a, b, s in zip(cut, cut[1:], self.shapes)]

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of x (rows, steps, features)."""
        wx, wh, b, head, bias = self.views(self.flat)
        n, h = self.h, np.zeros((len(x), self.h))
        for t in range(x.shape[1]):
            a, g = x[:, t] @ wx + b, h @ wh
            zr = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            cand = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
            if keep is not None:
                keep.append((h, z, r, cand, g[:, 2 * n :]))
            h = (1 - z) * cand + z * h
        if keep is not None:
            keep.append(h)
        return h @ head + bias

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: float) -> tuple[float, np.ndarray]:
        """Mean weighted cross-entropy and its gradient."""
        keep: list = []
        z = self.forward(x, keep)
        by = np.where(y > 0, weight, 1.0)
        loss = float((by * (np.logaddexp(0, z) - y * z)).mean())
        dz = by * (_sigmoid(z) - y) / len(y)
        grad = np.zeros_like(self.flat)
        gx, gh, gb, ghead, gbias = self.views(grad)
        _, wh, _, head, _ = self.views(self.flat)
        ghead += keep[-1].T @ dz
        gbias += dz.sum()
        dh = np.outer(dz, head)
        for t in range(x.shape[1] - 1, -1, -1):
            h, u, r, cand, rec = keep[t]
            dc = dh * (1 - u) * (1 - cand * cand)
            da = np.concatenate([dh * (h - cand) * u * (1 - u), dc * rec * r * (1 - r), dc], axis=1)
            dg = da.copy()
            dg[:, 2 * self.h :] *= r
            gx += x[:, t].T @ da
            gb += da.sum(axis=0)
            gh += h.T @ dg
            dh = dh * u + dg @ wh.T
        return loss, grad


class SequenceModel:
    """fit() and score() over columns c_t0, d_t0, ..., c_t1, ... (flattening "full") of `features` features."""

    def __init__(self, columns: list[str], features: int, hidden: int = 32, lr: float = 1e-2, rounds: int = 12, epochs: int = 5, batch: int = 256, held: float = 0.15, patience: int = 2, seed: int = 0):
        if not columns or len(columns) % features:
            raise ValueError(f"{len(columns)} columns are not whole steps of {features} features")
        self.columns, self.features, self.hidden, self.lr, self.rounds, self.epochs, self.batch, self.held, self.patience, self.seed = columns, features, hidden, lr, rounds, epochs, batch, held, patience, seed
        self.flat: np.ndarray | None = None
        self.constant: float | None = None
        self.history: list[float] = []

    def _tensor(self, b: pa.RecordBatch) -> np.ndarray:
        at = [b.schema.get_field_index(c) for c in self.columns]
        return np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in at], axis=1).reshape(b.num_rows, -1, self.features)

    def _filled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: zero_missing(F.col(c).cast("double")) for c in self.columns})

    def fit(self, df: DataFrame) -> "SequenceModel":
        held = F.pmod(F.xxhash64(F.lit(self.seed), *self.columns), F.lit(10_000)) < int(self.held * 10_000)
        rows = materialised(self._filled(df).select(F.col("y").cast("double").alias("y"), held.alias("held"), *self.columns), "gru-windows")
        n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not n:
            raise ValueError("no training windows")
        if len(n) < 2:
            self.constant = next(iter(n))
            return self
        weight, best, since = max(n[0.0] / n[1.0], 1.0), np.inf, 0
        flat = Net(self.features, self.hidden, seed=self.seed).flat
        for k in range(self.rounds):

            def run(it, k=k, flat=flat):
                parts = [(b.column(0).to_numpy(), self._tensor(b)) for b in it if b.num_rows]
                if not parts:
                    return
                y, x = (np.concatenate(c) for c in zip(*parts, strict=True))
                net, rng = Net(self.features, self.hidden, flat), np.random.default_rng(k)
                m, v, t = np.zeros_like(flat), np.zeros_like(flat), 0
                for _ in range(self.epochs):
                    order = rng.permutation(len(y))
                    for i in range(0, len(order), self.batch):
                        at, t = order[i : i + self.batch], t + 1
                        g = net.gradient(x[at], y[at], weight)[1]
                        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                        net.flat -= self.lr / (1 + k / 4) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                yield pa.RecordBatch.from_arrays([pa.array([(net.flat * len(y)).tobytes()], pa.binary()), pa.array([float(len(y))])], ["body", "n"])

            flat = _average(rows.filter("NOT held").drop("held").mapInArrow(run, "body binary, n double"), flat)
            loss = self._loss(rows.filter("held").drop("held"), flat, weight)
            self.history.append(loss)
            if not loss >= best - 1e-5:
                best, since, self.flat = loss, 0, flat
            else:
                since += 1
                if since >= self.patience:
                    break
        self.flat = flat if self.flat is None else self.flat
        return self

    def _loss(self, rows: DataFrame, flat: np.ndarray, weight: float) -> float:
        def run(it):
            net = Net(self.features, self.hidden, flat)
            for b in it:
                if b.num_rows:
                    y, z = b.column(0).to_numpy(), net.forward(self._tensor(b))
                    yield pa.RecordBatch.from_arrays([pa.array([float((np.where(y > 0, weight, 1.0) * (np.logaddexp(0, z) - y * z)).sum())]), pa.array([float(len(y))])], ["s", "n"])

        r = rows.mapInArrow(run, "s double, n double").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
        return r.s / r.n if r.n else float("nan")

    def score(self, df: DataFrame) -> DataFrame:
        """df with p."""
        if self.constant is not None:
            return df.withColumn("p", F.lit(self.constant))
        if self.flat is None:
            raise RuntimeError("fit() comes before score()")
        flat, names = self.flat, df.columns

        def run(it):
            net = Net(self.features, self.hidden, flat)
            for b in it:
                x = np.nan_to_num(self._tensor(b), nan=0.0, posinf=0.0, neginf=0.0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_sigmoid(net.forward(x)))], [*names, "p"])

        wide = df.withColumns({c: F.col(c).cast("double") for c in self.columns})
        return wide.mapInArrow(run, T.StructType([*wide.schema.fields, T.StructField("p", T.DoubleType())]))


def _average(parts: DataFrame, before: np.ndarray, fan_in: int = 32) -> np.ndarray:
    """Mean of the tasks' parameters by windows, added up in two levels."""

    def add(t: pa.Table) -> pa.Table:
        body = sum(np.frombuffer(x.as_py()) for x in t.column("body"))
        return pa.table({"g": pa.array([0], pa.int32()), "body": pa.array([body.tobytes()], pa.binary()), "n": pa.array([float(np.sum(t.column("n").to_numpy()))])})

    kind = "g int, body binary, n double"
    some = parts.withColumn("g", F.floor(F.spark_partition_id() / fan_in).cast("int")).groupBy("g").applyInArrow(lambda t: add(t), kind)
    got = some.groupBy("g").applyInArrow(lambda t: add(t), kind).collect()
    return np.frombuffer(got[0].body) / got[0].n if got else before
