"""What the training-data operators share: table access, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is named, a temporary folder in local mode; an error elsewhere."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="tellumen-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches(it: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches that hold about `most` bytes of `column` (one row at least), so that
    memory is bounded by the longest text and not by the number of rows in a batch."""
    for batch in it:
        n = batch.num_rows
        if not n:
            continue
        k = batch.schema.get_field_index(column)
        arr = batch.column(k)
        sizes = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False)
        begin = size = 0
        for i in range(n):
            if i > begin and size + sizes[i] > most:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += int(sizes[i])
        yield batch.slice(begin, n - begin)


def summed(parts: DataFrame, fan_in: int = 16, levels: int = 4) -> DataFrame:
    """(part, body): vectors of doubles per task, added by part in a tree: no group holds more than `fan_in` vectors
    up to fan_in ** levels tasks (65,536), beyond which the last level's groups grow. Bodies are float64 on return."""

    def add(t: pa.Table) -> pa.Table:
        bodies = t.column("body")
        total = np.frombuffer(bodies[0].as_py(), np.float64).copy()
        for x in bodies[1:]:
            total += np.frombuffer(x.as_py(), np.float64)
        return t.slice(0, 1).set_column(t.schema.get_field_index("body"), "body", pa.array([total.tobytes()], pa.binary()))

    out = parts.select("part", F.spark_partition_id().alias("g"), "body")
    for _ in range(levels):
        out = out.withColumn("g", F.floor(F.col("g") / fan_in).cast("int")).groupBy("part", "g").applyInArrow(lambda t: add(t), "part int, g int, body binary")
    return out.groupBy("part").applyInArrow(lambda t: add(t), "part int, g int, body binary").select("part", "body")
