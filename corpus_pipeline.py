"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Each stage takes all that its predecessor kept and returns it as `documents` has it (the last one adds the mix's
columns). Stages are written to the shared folder between calls by run(), or by the caller that uses STAGES.

Defined results: documents with a null or empty text are rejected by the first stage; rows that repeat a doc_id stay
apart by their text in every stage, and equal rows stay equal until the mix, which counts each of them; null doc_ids
are judged by their text and take part in all stages but near-dedup, which keeps them; a text that line dedup has
emptied stays, with no tokens; an empty table gives no rows; extra columns pass through to the end, as long as they
are not named epoch, domain or tokens, which the last stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellumen.llm.common import table, written
from tellumen.llm.decontam import contaminated
from tellumen.llm.linededup import dedup_lines
from tellumen.llm.minhash import near_duplicates
from tellumen.llm.mixing import mix_sources
from tellumen.llm.quality import classify


def _same(docs: DataFrame, other: DataFrame, *more):
    cond = docs["doc_id"].eqNullSafe(other["k_id"])
    for m in more:
        cond &= m
    return cond


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; ids are matched together with the text's hash."""
    kept = classify(docs, table(spark, sf_dir, "labels")).filter("kept").select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"))
    return docs.join(kept, _same(docs, kept, F.xxhash64(docs["text"]) == kept["k_th"]), "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that an earlier document holds; n_chars follows the text."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles at similarity 0.8 or more."""
    gone = near_duplicates(docs, ngram=5, percent=80).filter("NOT kept").select(F.col("doc_id").alias("k_id"))
    return docs.join(gone, _same(docs, gone), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; ids are matched together with the text's hash."""
    gone = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")).distinct()
    return docs.join(gone, _same(docs, gone, F.xxhash64(docs["text"]) == gone["k_th"]), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, once for each epoch taken, with epoch, domain and tokens. Rows that repeat doc_id and
    text are one document here, which the mix may take several times."""
    mix = mix_sources(docs).select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"), "epoch", "domain", "tokens")
    once = docs.withColumn("k__th", F.xxhash64("text")).dropDuplicates(["doc_id", "k__th"])
    both = once.join(mix, _same(once, mix, once["k__th"] == mix["k_th"]))
    return both.select(*[once[c] for c in docs.columns], mix["epoch"], mix["domain"], mix["tokens"])


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
]

#: SQL cannot express the quality model; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
