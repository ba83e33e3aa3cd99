"""Log records derived from the `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.operators.ensemble import DETECTORS, SIGNAL_SEVERITY, combine
from siftlog.operators.features import add_base_features
from siftlog.operators.incidents import build_incidents
from siftlog.operators.matrix import fit_scaling
from siftlog.plans.detection import ROW
from siftlog.session import prepare, spread, stage, times_dropped

COMPONENT = "CASE WHEN user_id % 50 = 0 THEN 'unknown' ELSE concat('svc-', cast(user_id % 8 AS string)) END"
MESSAGE = """
CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN concat('Fatal crash in handler ', cast(user_id AS string))
     WHEN event_type = 'error' AND event_id % 5 = 1 THEN 'connection TIMEOUT while saving'
     WHEN event_type = 'error' THEN concat('save failed  code ', props)
     WHEN event_type = 'click' AND event_id % 7 = 0 THEN 'warning: slow click'
     WHEN event_type = 'view' AND event_id % 11 = 0 THEN ''
     ELSE concat(event_type, ' by user ', cast(user_id AS string)) END
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per event, with `value` as an extra column."""
    return spread(table(spark, sf_dir, "events")).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("normalized_timestamp"),
        F.expr(COMPONENT).alias("component"),
        F.expr(MESSAGE).alias("message"),
        F.col("event_type").alias("parsed_message_type"),
        F.col("props").alias("extracted_metrics"),
        "value",
    )


def simple_scores(logs: DataFrame) -> DataFrame:
    """Features and three scores with an exact SQL equal: distances from the mean in deviations.

    They stand in for the detectors where a report is checked value by value.
    """
    features = add_base_features(logs)
    scaling = fit_scaling(features, ("message_length", "value", "second"))
    deviations = [
        F.round(F.abs((F.col(name) - F.lit(mean)) / F.lit(spread)), 6)
        for name, mean, spread in zip(scaling.names, scaling.means, scaling.deviations)
    ]
    scored = features.withColumns({f"{name}_score": value for name, value in zip(DETECTORS, deviations)})
    return scored.withColumn(ROW, F.monotonically_increasing_id())


_tables: dict[tuple, DataFrame] = {}


def version(spark: SparkSession, sf_dir: str) -> tuple:
    """Place, size and time of the files of `events`, so that nothing is kept when they change or staged tables go."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = [files.getFileStatus(path), *files.listStatus(path)]
    return (times_dropped(spark), tuple(sorted((str(file.getPath()), file.getLen(), file.getModificationTime()) for file in listed)))


def kept(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A stage table, built once per application and state of the data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name, version(spark, sf_dir))
    if key not in _tables:
        _tables[key] = stage(build(), name)
    return _tables[key]


def simple_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored table of the simple scores."""
    scores = kept(spark, sf_dir, "simple-scores", lambda: simple_scores(event_logs(spark, sf_dir)))
    return kept(spark, sf_dir, "simple-scored", lambda: combine(scores, ROW).scored.drop(ROW))


def simple_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "simple-incidents", lambda: build_incidents(simple_scored(spark, sf_dir)))


def severity_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose signal is their severity alone."""
    features = add_base_features(event_logs(spark, sf_dir))
    return features.withColumns({"is_anomaly": F.lit(False), "is_signal": F.col("severity_score") >= SIGNAL_SEVERITY})
