"""Row-level features of log records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.functions import text
from siftlog.functions.metrics import Leaf, discover_leaves, flatten_metrics, has_metric, metrics_text

# The features that every record has, in their order.
BASE_FEATURES = ("message_length", "word_count", "severity_score", "hour", "minute", "second")


def add_base_features(logs: DataFrame) -> DataFrame:
    """Severity, message sizes, metric presence and time of day; no job, one projection."""
    message, time = F.col("message"), F.col("normalized_timestamp")
    scored = logs.withColumns(
        {
            "severity_score": text.severity_score(message),
            "message_length": text.message_length(message),
            "word_count": text.word_count(message),
            "has_metric": has_metric(metrics_text(logs)),
            "hour": F.hour(time),
            "minute": F.minute(time),
            "second": text.seconds_of_minute(time),
        }
    )
    return scored.withColumn("severity", text.severity_label(F.col("severity_score")))


def build_features(logs: DataFrame, leaves: list[Leaf] | None = None) -> DataFrame:
    """Base features, and a `metric_*` column per leaf of the metrics objects.

    Leaves are discovered in one pass unless given, for instance those chosen
    when the detectors were fitted.
    """
    found = discover_leaves(logs) if leaves is None else leaves
    return flatten_metrics(add_base_features(logs), found)
