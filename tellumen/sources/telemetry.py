"""Telemetry in and out: daily CSV, failure tables, exports with checks, prediction dumps, resumable job tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellumen.functions.scalars import uniform
from tellumen.operators.labels import vendor
from tellumen.sources.fleet import KEY, missing

META = ["disk_id", "ds", "model"]


def read_daily_csv(spark: SparkSession, paths: list[str], features: list[str]) -> DataFrame:
    """Daily files of one or more folders as strings, matched to names by each file's header; clean with
    parse_days() and to_double()."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*META, *features)])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(paths)


def find_failures(spark: SparkSession, root: str, *patterns: str) -> DataFrame:
    """Failure tables anywhere under root, by the first pattern that any file matches; none is an error."""
    patterns = patterns or ("*failure*.csv",)
    for pattern in patterns:
        if not files_under(spark, root, pattern).isEmpty():
            return spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root)
    raise FileNotFoundError(f"no {' or '.join(patterns)} under {root}")


def files_under(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length of the files under root that match; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")


def locate_export(spark: SparkSession, root: str, pattern: str = "*.parquet") -> str:
    """The first folder under root, by name, that holds files of an export; none is an error."""
    found = files_under(spark, root, pattern).agg(F.min(F.regexp_replace("path", "/[^/]*$", "")).alias("folder")).first().folder
    if found is None:
        raise FileNotFoundError(f"no {pattern} under {root}")
    return found


def count_csv(spark: SparkSession, paths: list[str]) -> int:
    """Rows of CSV files less their headers; no column is parsed."""
    return spark.read.option("header", True).csv(paths).count()


def inspect_raw(spark: SparkSession, path: str, rows: int = 1000) -> DataFrame:
    """column, n, n_null over the first `rows` rows of a raw file."""
    df = spark.read.option("header", True).csv(path).limit(rows)
    counts = df.select([F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "n_null")
    return counts.crossJoin(df.agg(F.count(F.lit(1)).alias("n")))


def load_slim(spark: SparkSession, path: str, drives: int | None = None, keep_failed: bool = True, seed: int = 42) -> DataFrame:
    """A slim export, or the rows of a sample of its drives (all failed ones and `drives` others, or in proportion)."""
    from tellumen.operators.sampling import sample_drives

    df = spark.read.parquet(path)
    if drives is None:
        return df
    every = df.groupBy(*KEY).agg(F.max(F.col("failure_time").isNotNull().cast("int")).alias("drive_label"))
    return df.join(sample_drives(every, drives, keep_failed, seed).select(*KEY), KEY, "left_semi")


def clean_failures(df: DataFrame) -> DataFrame:
    """model, disk_id, failure_time of the rows in which all three can be read."""
    return df.select("model", F.expr("try_cast(disk_id AS bigint)").alias("disk_id"), F.try_to_timestamp(F.col("failure_time")).alias("failure_time")).dropna()


def parse_days(df: DataFrame, column: str = "ds") -> DataFrame:
    """column as a date from yyyymmdd digits; rows that hold none go."""
    return df.withColumn(column, F.to_date(F.try_to_timestamp(F.col(column).cast("string"), F.lit("yyyyMMdd")))).filter(F.col(column).isNotNull())


def to_double(df: DataFrame, meta: list[str]) -> DataFrame:
    """Every column outside meta as a double; what cannot be read is null."""
    return df.select(*[F.col(c) if c in meta else F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in df.columns])


def merge_failures(df: DataFrame, failures: DataFrame) -> DataFrame:
    """Adds failure_time, fractional days_to_failure and failure_event. The failure table is a row per failed drive;
    the optimiser broadcasts it when its size allows."""
    out = df.join(failures.select(*KEY, "failure_time"), KEY, "left")
    days = (F.unix_micros(F.col("failure_time").cast("timestamp")) - F.unix_micros(F.col("ds").cast("timestamp"))) / F.lit(86400e6)
    return out.withColumn("days_to_failure", days).withColumn("failure_event", F.coalesce(F.col("days_to_failure") <= 0, F.lit(False)).cast("tinyint"))


def compare_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, columns, verdict (SAME, REORDERED, DIFFERENT SET) against the first file by name; reads one line a file."""
    line = spark.read.text(paths).withColumn("file", F.col("_metadata.file_path")).filter("_metadata.file_block_start = 0")
    heads = line.groupBy("file").agg(F.first("value").alias("head"))
    first = heads.agg(F.min_by("head", "file").alias("ref"))
    cols = lambda c: F.array_sort(F.split(c, ","))
    verdict = F.when(F.col("head") == F.col("ref"), "SAME").when(cols(F.col("head")) == cols(F.col("ref")), "REORDERED").otherwise("DIFFERENT SET")
    return heads.crossJoin(F.broadcast(first)).select("file", F.split("head", ",").alias("columns"), verdict.alias("verdict"))


def write_panel(df: DataFrame, path: str, codec: str = "snappy", overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "error").option("compression", codec).parquet(path)


def append_panel(df: DataFrame, path: str, codec: str = "snappy") -> None:
    """Adds df to a panel in the order and types of what is there; a column that is missing is an error, a new one is
    left out. The first call writes df as it is."""
    spark = df.sparkSession
    try:
        first = spark.read.parquet(path).schema
    except AnalysisException:
        return write_panel(df, path, codec)
    lost = [f.name for f in first if f.name not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in first]).write.mode("append").option("compression", codec).parquet(path)


def export_slim(df: DataFrame, path: str, features: list[str], codec: str = "zstd", overwrite: bool = False) -> None:
    """Key, failure time, features and whole days to failure in single precision, partitioned by model and sorted by
    drive and day; files are split by drive, so one large model is not one task."""
    dtf = ((F.unix_micros(F.col("failure_time").cast("timestamp")) - F.unix_micros(F.col("ds").cast("timestamp"))) / F.lit(86400e6)).cast("int").cast("float")
    slim = df.select(*KEY, "ds", "failure_time", *[F.col(c).cast("float").alias(c) for c in features], dtf.alias("days_to_failure"))
    slim.repartition("model", F.pmod(F.hash("disk_id"), F.lit(64))).sortWithinPartitions("model", "disk_id", "ds").write.mode("overwrite" if overwrite else "error").option("compression", codec).partitionBy("model").parquet(path)


def export_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Per model: drives, rows, failed drives, first and last day, whether every feature is there in over half of the rows."""
    there = F.greatest(*[F.avg(missing(c).cast("double")) for c in features]) if len(features) > 1 else F.avg(missing(features[0]).cast("double"))
    return df.groupBy("model").agg(F.count_distinct("disk_id").alias("drives"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.when(F.col("failure_time").isNotNull(), F.col("disk_id"))).alias("failed"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"), (there < 0.5).alias("usable"))


def check_export(df: DataFrame, reference: DataFrame, features: list[str]) -> DataFrame:
    """export_profile joined with reference values (drives, n_rows, failed by model), a flag for each."""
    ref = reference.select("model", *[F.col(c).alias(f"{c}_ref") for c in ("drives", "n_rows", "failed")])
    out = export_profile(df, features).join(ref, "model")
    return out.withColumns({f"{c}_ok": F.col(c) == F.col(f"{c}_ref") for c in ("drives", "n_rows", "failed")})


def check_contract(df: DataFrame, n_rows: int, failed: int) -> DataFrame:
    """One row of what was found; an error when rows or failed drives differ from the contract."""
    got = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.when(F.col("failure_time").isNotNull(), F.struct(*KEY))).alias("failed"), F.count_distinct(F.struct(*KEY)).alias("drives"))
    r = got.first()
    if (r.n_rows, r.failed) != (n_rows, failed):
        raise ValueError(f"contract broken: {r.n_rows} rows and {r.failed} failed drives, not {n_rows} and {failed}")
    return got


def write_dump(frames: dict[str, DataFrame], meta: DataFrame, path: str) -> None:
    """cal, test and train predictions beside one row of metadata as JSON."""
    for part, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{part}")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_dump(spark: SparkSession, path: str, part: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{part}")


def dump_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other has not, repeats counted; empty when a dump was regenerated alike."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def write_csv(df: DataFrame, path: str) -> None:
    """A small result table as one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def pending(requested: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells still to be run: those requested less those done."""
    return requested.join(done.select(*keys).distinct(), keys, "left_anti")


def write_report(rows: DataFrame, path: str) -> None:
    """Rows of report() as lines of text, a section after the other."""
    line = F.concat(F.col("section"), F.lit("\t"), F.col("metric"), F.lit("\t"), F.col("value").cast("string"))
    rows.orderBy("section", "metric").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    """An experiment's settings as one JSON record."""
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in sorted(config.items())]).coalesce(1).write.mode("overwrite").json(path)


def report(df: DataFrame, section: str) -> DataFrame:
    """One row of numbers as (section, metric, value)."""
    return df.select([F.col(c).cast("double").alias(c) for c in df.columns]).unpivot([], df.columns, "metric", "value").withColumn("section", F.lit(section))


def synthetic(spark: SparkSession, drives: int = 400, days: int = 180, failure_scale: float = 1.0, censor_rate: float = 0.28, post_failure_days: int = 20, seed: int = 42) -> DataFrame:
    """Invented telemetry of six models: hash-seeded, so that it does not depend on partitioning. A 30-day quadratic
    ramp precedes each failure; one value in a hundred is missing; vendors differ by an offset."""
    u = lambda salt, *k: uniform(f"{seed}-{salt}", *k)
    models = F.array(*[F.lit(m) for m in ("MA1", "MA2", "MB1", "MB2", "MC1", "MC2")])
    d = spark.range(drives).select((F.col("id") + 1000).alias("disk_id"), F.get(models, F.floor(u("model", "id") * 6).cast("int")).alias("model"))
    v = vendor()
    # Failure shares and offsets by vendor.
    share = F.when(v == "A", 0.05).when(v == "B", 0.10).otherwise(0.20) * failure_scale
    offset = F.when(v == "A", 0.0).when(v == "B", 3.0).otherwise(-2.5)
    d = d.withColumns({"fails": u("fails", "disk_id") < share, "at": (F.lit(30) + u("at", "disk_id") * (days - 30)).cast("int"), "cut": u("cut", "disk_id") < censor_rate, "left": (F.lit(30) + u("left", "disk_id") * (days - 30)).cast("int"), "offset": offset})
    end = F.when(F.col("fails"), F.least(F.col("at") + post_failure_days, F.lit(days - 1))).when(F.col("cut"), F.col("left")).otherwise(F.lit(days - 1))
    d = d.withColumn("failure_time", F.when(F.col("fails"), F.date_add(F.lit("2018-01-01").cast("date"), F.col("at"))))
    x = d.withColumn("t", F.explode(F.sequence(F.lit(0), end.cast("int")))).withColumn("ds", F.date_add(F.lit("2018-01-01").cast("date"), F.col("t")))
    near = F.when(F.col("fails"), F.greatest(F.lit(0.0), 1 - F.greatest(F.col("at") - F.col("t"), F.lit(0)) / 30.0)).otherwise(0.0)
    noise = lambda c: u(c, "disk_id", "t") - 0.5
    gone = lambda c, e: F.when(u(f"gone-{c}", "disk_id", "t") >= 0.01, e).alias(c)
    dtf = F.datediff("failure_time", "ds").cast("double")
    return x.select("disk_id", "ds", "model", gone("n_1", 100 + F.col("offset") - 25 * near * near + noise("n_1")), gone("r_1", 400 * near * near + 10 * noise("r_1")), gone("n_2", 50 + F.col("offset") + noise("n_2")), gone("r_2", F.col("t") * 0.1 + noise("r_2")), (F.col("t") * 24.0).alias("r_9"), "failure_time", dtf.alias("days_to_failure"), F.coalesce(dtf <= 0, F.lit(False)).cast("tinyint").alias("failure_event"))


def write_synthetic(spark: SparkSession, path: str, codec: str = "snappy", **options) -> None:
    synthetic(spark, **options).write.mode("error").option("compression", codec).parquet(path)
