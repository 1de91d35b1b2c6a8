"""Driver tables as fleet telemetry: P1 a daily panel per drive, P2 scored windows, both as DataFrames and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["model", "disk_id"]
FEATURES = ["n_1", "r_1", "n_2", "r_2"]

#: The panel in SQL that Spark and DuckDB both run. r_9 is the drive's age in events.
PANEL_SQL = """
day AS (SELECT user_id AS disk_id, CAST(ts AS DATE) AS ds, count(*) AS n, avg(value) AS m, max(value) AS hi,
    sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS err,
    max(CASE WHEN event_type = 'error' AND value >= 150 THEN 1 ELSE 0 END) AS broke
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id, CAST(ts AS DATE)),
panel AS (SELECT concat('M', substr('ABC', CAST(disk_id % 3 AS INT) + 1, 1), CAST(CAST(floor(disk_id / 3) AS BIGINT) % 2 + 1 AS VARCHAR(1))) AS model,
    disk_id, ds, CAST(n AS DOUBLE) AS n_1, m AS r_1, hi AS n_2, CAST(err AS DOUBLE) AS r_2,
    CAST(sum(n) OVER (PARTITION BY disk_id ORDER BY ds) AS DOUBLE) AS r_9,
    min(CASE WHEN broke = 1 THEN ds END) OVER (PARTITION BY disk_id) AS failure_time
  FROM day)"""

#: Scored windows: y about one in six, p a mix of hashed uniforms, part by drive.
_U = "CAST(conv(substr(md5(concat_ws('|', '{salt}', {key})), 1, 13), 16, 10) AS BIGINT) / 4503599627370496.0D"
_UD = "('0x' || substr(md5(concat_ws('|', '{salt}', {key})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_ROW = "CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING)"


def _scored(u: str) -> str:
    a, b, c = (u.format(salt=s, key=k) for s, k in (("u", _ROW), ("v", _ROW), ("part", "CAST(l_suppkey AS STRING)")))
    return f"""
scored AS (SELECT l_suppkey AS drive, substr('ABC', CAST(l_suppkey % 3 AS INT) + 1, 1) AS vendor,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS y,
    CAST(l_linenumber % 4 AS INT) AS stage, l_orderkey, l_linenumber, l_shipdate,
    round(0.65 * {a} + CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 0.35 ELSE 0.0 END * {b}, 4) AS p,
    CASE WHEN {c} < 0.3 THEN 'cal' ELSE 'test' END AS part
  FROM lineitem)"""


SCORED_SPARK = _scored(_U).replace("0.65", "0.65D").replace("0.35 ", "0.35D ").replace("0.0 END", "0.0D END").replace("< 0.3 ", "< 0.3D ")
SCORED_SQL = _scored(_UD).replace("STRING", "VARCHAR").replace("0.65", "0.65::DOUBLE").replace("0.35 ", "0.35::DOUBLE ").replace("0.0 END", "0.0::DOUBLE END").replace("< 0.3 ", "< 0.3::DOUBLE ")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {PANEL_SQL.replace('FROM events', 'FROM {events}').replace('VARCHAR(1)', 'STRING')} SELECT * FROM panel", events=read(spark, sf_dir, "events"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {SCORED_SPARK.replace('FROM lineitem', 'FROM {lineitem}')} SELECT * FROM scored", lineitem=read(spark, sf_dir, "lineitem"))


def missing(c: str):
    """Null, or NaN."""
    return F.col(c).isNull() | F.isnan(c)
