import pytest
from pyspark.sql import functions as F

from helpers import at
from siftlog.plans import reports

SCHEMA = (
    "event_id string, normalized_timestamp timestamp, component string, parsed_message_type string, message string, "
    "severity string, severity_score int, anomaly_score double, is_anomaly boolean, is_signal boolean, anomaly_votes int, "
    "isolation_forest_anomaly boolean, autoencoder_anomaly boolean, hdbscan_anomaly boolean, ensemble_anomaly boolean, "
    "isolation_forest_score double, autoencoder_score double, hdbscan_score double, ensemble_score double"
)
LABELS = ("Normal", "Low", "Medium", "High")


@pytest.fixture(scope="module")
def scored(spark):
    rows = []
    for i in range(60):
        one, two, three = i % 2 == 0, i % 3 == 0, i % 5 == 0
        votes = one + two + three
        minutes = None if i == 59 else 200.0 * (i // 20) + i
        rows.append(
            (f"{i:03d}", None if minutes is None else at(minutes), f"c{i % 4}", f"t{i % 2}", None if i == 7 else f"Message {i}.", LABELS[i % 4], i % 4)
            + (float(i), two, two or i % 4 >= 2, votes, one, two, three, votes >= 2, 0.1, float(i), 0.3, i / 60)
        )
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_facets_and_filters(scored):
    assert [row[0] for row in reports.facet_values(scored, "component").collect()] == ["c0", "c1", "c2", "c3"]
    assert reports.filter_records(scored).count() == 60
    assert reports.filter_records(scored, [], [], "All").count() == 60
    assert reports.filter_records(scored, ["c1", "c2"], ["t1"]).count() == 15
    assert [reports.filter_records(scored, min_severity=s).count() for s in ("Low", "Medium", "High")] == [45, 30, 15]


def test_overview_counts_all_incidents(spark, scored):
    view = reports.filter_records(scored, ["c0"])
    assert reports.overview(view, spark.range(9)).first().asDict() == {
        "processed_logs": 15,
        "anomalies": 5,
        "error_signals": 0,
        "incidents": 9,
    }


def test_hours_without_records_are_filled(scored):
    found = reports.hourly_activity(scored).collect()
    assert [row.logs for row in found] == [20, 0, 0, 20, 0, 0, 0, 19]
    assert sum(row.anomalies for row in found) == 20
    assert found[1].hour_start == at(60)


def test_component_reports(scored):
    assert reports.component_activity(scored, 2).count() == 2
    assert reports.most_affected(scored).first().component == "c0"


def test_search_is_a_regular_expression(scored):
    assert reports.search_messages(scored, r"message 1\d\.").count() == 10
    # 5 and 50 to 59: the dot stands for the blank.
    assert reports.search_messages(scored, "e.5").count() == 11
    assert reports.search_messages(scored, r"e\.5").count() == 0
    assert reports.search_messages(scored, "").count() == 60
    assert reports.search_messages(scored, ".*").count() == 60
    assert reports.search_messages(scored, "M").count() == 59


def test_pages(scored):
    assert [row.event_id for row in reports.record_page(scored, 3).collect()] == ["000", "001", "002"]
    assert reports.log_page(scored, 0).count() == 1
    assert reports.log_page(scored, 5_000).count() == 60
    assert reports.log_page(scored).filter("event_id = '059'").first().normalized_timestamp == "NaT"
    assert reports.log_page(scored, 1).first().normalized_timestamp == "2017-01-01 00:00:00+00:00"


def test_votes(scored):
    histogram = reports.vote_histogram(scored)
    assert [tuple(row) for row in histogram.collect()] == [("0 / 3", 16), ("1 / 3", 28), ("2 / 3", 14), ("3 / 3", 2)]
    none = reports.vote_histogram(scored.filter("anomaly_votes = 1")).collect()
    assert [row.records for row in none] == [0, 28, 0, 0]


def test_model_counts_and_agreement(scored):
    assert tuple(reports.model_counts(scored).first()) == (30, 20, 12, 16)
    agreement = {row.pair: row.agreement_pct for row in reports.pairwise_agreement(scored).collect()}
    assert agreement["Isolation Forest vs Autoencoder"] == 50.0
    assert agreement["Autoencoder vs HDBSCAN"] == 60.0


def test_consensus(scored):
    found = reports.consensus_anomalies(scored, 5).collect()
    assert [row.event_id for row in found] == ["054", "050", "048", "045", "042"]


def test_plot_sample(scored):
    assert reports.plot_sample(scored).count() == 60
    assert reports.plot_sample(scored, "autoencoder_score", "autoencoder_anomaly", size=10).columns == [
        "normalized_timestamp",
        "autoencoder_score",
        "autoencoder_anomaly",
        "component",
        "parsed_message_type",
        "message",
    ]


def test_summary(spark, scored):
    found = reports.summary(scored, spark.range(3)).first().asDict()
    expected = scored.agg(F.count_if("is_signal")).first()[0]
    assert found == {"total_logs": 60, "anomalies": 20, "signals": expected, "components": 4, "incidents": 3}
