"""Checks and projections of whole frames: columns that exist, schemas, strict lookups, best rows, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that df has, in the order asked for."""
    return df.select(*[c for c in columns if c in df.columns])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def require_day(df: DataFrame, column: str = "ds") -> DataFrame:
    """df, or a TypeError unless column is a date or a timestamp."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{column} is {kind.simpleString()}, not a date")
    return df


def drop_features(df: DataFrame, names: list[str]) -> DataFrame:
    """df without features and what was derived from them (name_...)."""
    return df.drop(*[c for c in df.columns if any(c == n or c.startswith(f"{n}_") for n in names)])


def best_row(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The row of each group (of all, without any) whose order is greatest; an aggregation, not a sort."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def only(df: DataFrame):
    """The only row of df; none or several are a KeyError."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise KeyError(f"{'no' if not rows else 'more than one'} row")
    return rows[0]


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, least, greatest of a sweep's value."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def verdict(n: Column, enough: int = 500, thin: int = 100) -> Column:
    return F.when(n >= enough, "OK").when(n >= thin, "THIN").otherwise("TOO FEW")
