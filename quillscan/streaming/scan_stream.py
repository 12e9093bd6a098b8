"""Structured streaming over files and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.operators import detectors


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files that arrive in ``folder``, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_findings(files: DataFrame) -> DataFrame:
    """Findings of arriving files. The detectors look at one file at a time, so the stream keeps no state."""
    return detectors.one_pass(files, numbered=False).where("kind = 'finding'").select("unit", "path", *(c for c in detectors.FINDING if c != "sure"))


def _marked(df: DataFrame, at: str, late: str) -> DataFrame:
    """``df`` with a watermark on ``at``; times without zone are taken in the session's zone."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def windowed_counts(findings: DataFrame, at: str = "recorded_at", late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Findings per hour and severity; rows later than the watermark are dropped."""
    return _marked(findings, at, late).groupBy(F.window(at, width).alias("window"), F.lower(F.trim("severity")).alias("severity")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "severity", "n")


def without_redelivery(findings: DataFrame, at: str = "recorded_at", late: str = "2 hours") -> DataFrame:
    """The first delivery of each finding within the watermark."""
    return _marked(findings, at, late).dropDuplicatesWithinWatermark(["repo", "scan_id", "id"])
