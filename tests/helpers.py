"""Small builders the tests share."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

START = datetime(2017, 1, 1)
SIGNAL_SCHEMA = (
    "event_id string, normalized_timestamp timestamp, component string, severity_score int, "
    "is_anomaly boolean, is_signal boolean"
)


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def signals(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (minutes or none, component, severity, anomaly); ids follow the order given."""
    data = [
        (f"{i:06d}", None if minutes is None else at(minutes), component, score, flag, True)
        for i, (minutes, component, score, flag) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SIGNAL_SCHEMA)


def utc(value: datetime) -> datetime:
    return value
