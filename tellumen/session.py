"""Session factory and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tellumen", cores: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time, AQE on and console noise off. On a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if not os.environ.get("SPARK_MASTER_URL"):
        builder = builder.master(f"local[{cores}]")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("TELLUMEN_DRIVER_MEMORY", "8g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is named, a temporary one in local mode and an error elsewhere."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tellumen-"))
    return sc.getCheckpointDir()


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again, for plans that go over it several times."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
