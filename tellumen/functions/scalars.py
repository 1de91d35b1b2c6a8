"""Column functions that panel, stage and score operators share; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *keys: str | Column) -> Column:
    """A uniform in [0, 1) fixed by seed and keys: 13 hex digits of md5, exact in a double."""
    cols = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *cols)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2**52))


def searchsorted(edges: Column, x: Column, right: bool = True, bits: int = 11) -> Column:
    """Number of ascending edges <= x (right) or < x, by binary search over fewer than 2 ** bits edges."""
    steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])

    def step(acc, s):
        edge = F.get(edges, acc + s - 1)
        below = edge <= x if right else edge < x
        return F.when((acc + s <= F.size(edges)) & below, acc + s).otherwise(acc)

    return F.when(x.isNotNull() & edges.isNotNull(), F.aggregate(steps, F.lit(0), step))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(z: Column, bound: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-clip(z, -bound, bound)))


def zero_missing(x: Column) -> Column:
    """0 for null, NaN and infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def row_mean(*cols: str) -> Column:
    """Mean over the columns that are not null; null if none is."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.try_divide(total, sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)))


def row_max(*cols: str) -> Column:
    """Greatest of the columns that are not null."""
    return F.greatest(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])


def stage_label(stage: Column, edges: list[float]) -> Column:
    """s{i}[lo,hi) for stage i of the given edges."""
    ends = ["-inf", *[f"{e:g}" for e in edges], "inf"]
    names = F.array(*[F.lit(f"s{k}[{ends[k]},{ends[k + 1]})") for k in range(len(edges) + 1)])
    return F.get(names, stage)


def fingerprint(*keys: str) -> Column:
    """First 12 hex digits of SHA-1 over the sorted, pipe-joined keys of a group of drives."""
    names = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    return F.substring(F.sha1(F.array_join(F.array_sort(F.collect_set(names)), "|")), 1, 12)


def valid_scores(p: str = "p", y: str = "y") -> Column:
    """True, or an error when a probability lies outside [0, 1] or a label is not 0 or 1."""
    ok = F.col(p).between(0, 1) & F.col(y).isin(0, 1)
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("probability or label out of range")))


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f names it: inside a lambda nothing else keeps a common
    subexpression from being computed again for every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def median(arr: Column) -> Column:
    def middle(s):
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    return bind(F.sort_array(arr), middle)


def spread(arr: Column) -> Column:
    """Population standard deviation of an array."""
    n = F.size(arr)
    mean = F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / n
    return bind(mean, lambda m: F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / n))
