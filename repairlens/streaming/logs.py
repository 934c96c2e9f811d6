"""Streams of test logs: witnesses as they come, and failures by stage in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repairlens.operators.logs import failure_stage, normalize_logs
from repairlens.operators.witnesses import build_witnesses

SCHEMA = "run_id long, at timestamp, log_text string"


def follow_logs(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of logs from JSON lines (run_id, at, log_text) that are put into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def stream_witnesses(logs: DataFrame) -> DataFrame:
    """Witnesses of a stream of logs, one row a log; keeps no state, so any sink and output mode append."""
    return build_witnesses(logs)


def stage_counts(logs: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, stage, n): logs by failure stage in windows of event time; rows later than ``late`` are dropped, and windows close by then."""
    staged = failure_stage(normalize_logs(logs.withWatermark("at", late)))
    return staged.groupBy(F.window("at", window).alias("w"), "stage").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "stage", "n")
