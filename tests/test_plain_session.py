"""The detectors on a session with Spark's own settings."""

import os

import pytest

from siftlog.plans import checks, event_logs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def plain(spark):
    option = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(option)
    spark.conf.set(option, "false")
    checks._detections.clear()
    event_logs._tables.clear()
    yield spark
    spark.conf.set(option, before)


@pytest.mark.parametrize("name", ["a6_density_clusters", "detected_records", "a20_model_record", "a21_accessors"])
def test_detectors_run(plain, name):
    assert checks.QUERIES[name](plain, FOLDER).count() > 0


def test_vectors_of_different_lengths(spark):
    from siftlog.operators.density import centroids

    rows = spark.createDataFrame([([1.0, 2.0], 0), ([1.0, 2.0, 9.0], 0)], "features array<double>, label long")
    with pytest.raises(ValueError, match="2 to 3"):
        centroids(rows)


def test_few_metrics_come_in_order_of_appearance(spark):
    from siftlog.functions import metrics
    from test_features import logs

    for keys in ("zyxwv", "zyxwvutsrqpo"):
        text = "{" + ", ".join(f'"{key}": 1' for key in keys) + "}"
        assert [leaf.column for leaf in metrics.numeric_leaves(logs(spark, [("m", text)]))] == [f"metric_{key}" for key in keys[:8]]


def test_hours_with_a_stray_year(spark):
    from pyspark.sql import functions as F

    from siftlog.plans import reports

    rows = spark.createDataFrame([("a", "1969-01-01 00:30:00", False), ("b", "2017-01-01 05:00:00", True)], "event_id string, t string, is_anomaly boolean")
    view = rows.select("event_id", F.to_timestamp("t").alias("normalized_timestamp"), "is_anomaly")
    found = reports.hourly_activity(view)
    assert found.count() == (48 * 365 + 12) * 24 + 6
    assert found.filter("logs > 0").count() == 2


def test_staged_tables_can_be_removed(spark):
    from siftlog.session import drop_staged, shared_dir, stage

    stage(spark.range(3), "numbers")
    first = checks.QUERIES["a13_votes"](spark, FOLDER).count()
    folder = f"{shared_dir(spark)}/siftlog/{spark.sparkContext.applicationId}"
    assert len(os.listdir(folder)) > 1
    drop_staged(spark)
    assert not os.path.exists(folder)
    assert checks.QUERIES["a13_votes"](spark, FOLDER).count() == first
