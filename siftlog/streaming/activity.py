"""The row-level features and the hourly report over a growing source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.operators.features import add_base_features
from siftlog.session import prepare
from siftlog.sources.jsonl import CORRUPT, canonical, record_schema, resolve_source


def stream_records(spark: SparkSession, path: str | None = None) -> DataFrame:
    """New JSONL files of a folder as typed records with base features.

    Bad lines stay in `_corrupt_record`: one of them must not end the stream.
    """
    reader = prepare(spark).readStream.schema(record_schema(corrupt=True))
    lines = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(resolve_source(path))
    return add_base_features(canonical(lines))


def hourly_stream(records: DataFrame, late: str = "1 hour") -> DataFrame:
    """Records and error signals per hour; rows later than `late` are left out.

    Unlike the report, an hour without records has no row.
    """
    timed = records.filter(F.col("normalized_timestamp").isNotNull()).withWatermark("normalized_timestamp", late)
    counted = timed.groupBy(F.window("normalized_timestamp", "1 hour").alias("hour")).agg(
        F.count("event_id").alias("logs"), F.count_if(F.col("severity_score") >= 2).alias("error_signals")
    )
    return counted.select(F.col("hour.start").alias("hour_start"), "logs", "error_signals")
