import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import at
from siftlog.operators import evidence

LOG_SCHEMA = (
    "event_id string, normalized_timestamp timestamp, component string, parsed_message_type string, message string, "
    "severity string, severity_score int, is_anomaly boolean"
)
INCIDENT_SCHEMA = (
    "incident_id string, start_time timestamp, end_time timestamp, severity string, primary_component string, event_count long"
)


@pytest.fixture
def logs(spark):
    rows = [(f"{i:04d}", at(i / 10), f"c{i % 3}", "it's" if i % 4 else "x", f"say \"{i}\"", "High", i % 4, i % 5 == 0) for i in range(900)]
    return spark.createDataFrame(rows, LOG_SCHEMA)


@pytest.fixture
def found_incidents(spark):
    rows = [
        ("INC-00000", at(1.05), at(1.55), "High", "c1", 3),
        ("INC-00001", at(3), at(60), "Low", "c2", 9),
        ("INC-00002", at(62), at(62), "Low", "c2", 1),
        ("INC-00003", at(62.01), at(62.02), "Low", "c2", 1),
        ("INC-00004", None, None, "Low", "c2", 1),
    ]
    return spark.createDataFrame(rows, INCIDENT_SCHEMA)


def test_first_rows_in_the_span(logs, found_incidents):
    found = evidence.evidence(logs, found_incidents).orderBy("incident_id", "place").collect()
    by_incident = {}
    for row in found:
        by_incident.setdefault(row.incident_id, []).append((row.place, row.event_id))
    assert by_incident["INC-00000"] == [(i + 1, f"{11 + i:04d}") for i in range(5)]
    assert by_incident["INC-00001"] == [(i + 1, f"{30 + i:04d}") for i in range(40)]
    assert by_incident["INC-00002"] == [(1, "0620")]
    assert set(by_incident) == {"INC-00000", "INC-00001", "INC-00002"}


def test_as_of_join_against_all_pairs(spark, monkeypatch):
    """Incidents of very different lengths, many on one range's border, records on their first and last instants."""
    monkeypatch.setattr(evidence, "RANGE_SPANS", 3)
    draw = random.Random(4)
    spans, now = [], 0.0
    for i in range(40):
        begin = now + draw.choice([2.0, 3.5, 60.0])
        now = begin + draw.choice([0.0, 0.5, 2_000_000.0 if i == 17 else 7.0])
        spans.append((f"INC-{i:05d}", begin, now))
    times = [t + d for _, a, b in spans for t in (a, b) for d in (-0.25, 0.0, 0.25)] + [a + (b - a) * draw.random() for _, a, b in spans for _ in range(3)] + [0.5] * 50
    incidents = spark.createDataFrame([(name, at(a), at(b), "Low", "c", 1) for name, a, b in spans], INCIDENT_SCHEMA)
    logs = spark.createDataFrame([(f"{i:05d}", at(t), "c", "t", "m", "Low", 0, False) for i, t in enumerate(times)] + [("none", None, "c", "t", "m", "Low", 0, False)], LOG_SCHEMA)
    found = evidence.rows_in_span(logs, incidents)
    assert "explode" not in found._jdf.queryExecution().toString().lower()
    pairs = sorted((row.incident_id, row.event_id) for row in found.collect())
    assert pairs == sorted((name, f"{i:05d}") for name, a, b in spans for i, t in enumerate(times) if at(a) <= at(t) <= at(b))
    assert evidence.rows_in_span(logs, incidents.limit(0)).count() == 0


def test_one_incident(logs, found_incidents):
    rows = evidence.incident_evidence(logs, found_incidents, "INC-00000").collect()
    assert len(rows) == 5 and rows[0].normalized_timestamp == at(1.1)
    assert rows[0].__fields__ == list(evidence.EVIDENCE_COLUMNS)


def test_limit_applies_before_the_shuffle(logs, found_incidents):
    plan = evidence.evidence(logs, found_incidents)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_summary(logs, found_incidents):
    found = evidence.evidence(logs, found_incidents)
    texts = {row.incident_id: row.summary for row in evidence.summaries(found_incidents, found).collect()}
    assert len(texts) == 5
    text = texts["INC-00000"]
    assert text.startswith("### Incident Summary\n\n**INC-00000** is a **High** incident affecting\n**c1** from **2017-01-01 00:01:03+00:00** to")
    # Rows 11 to 15: components c2 c0 c1 c2 c0, types it's x it's it's it's.
    assert "Dominant components: `{'c2': 2, 'c0': 2, 'c1': 1}`" in text
    assert "Dominant message types: `{\"it's\": 4, 'x': 1}`" in text
    assert "Evidence records: **5**" in text and "Anomalous records: **1**" in text and "Error/failure signals: **3**" in text
    assert "Evidence records: **0**" in texts["INC-00003"] and "`{}`" in texts["INC-00003"]


def test_prompt(logs, found_incidents):
    found = evidence.evidence(logs, found_incidents)
    prompts = {row.incident_id: row.prompt for row in evidence.prompts(found_incidents, found).collect()}
    metadata = json.loads(prompts["INC-00000"].split("Incident metadata:\n")[1].split("\n\nEvidence:")[0])
    assert metadata["incident_id"] == "INC-00000" and metadata["event_count"] == 3
    rows = json.loads(prompts["INC-00000"].split("Evidence:\n")[1].split("\n\nReturn:")[0])
    assert len(rows) == 5 and rows[0]["message"] == 'say "11"' and rows[0]["normalized_timestamp"] == "2017-01-01 00:01:06+00:00"
    assert json.loads(prompts["INC-00003"].split("Evidence:\n")[1].split("\n\nReturn:")[0]) == []


def test_counts_match_a_plain_join(logs, found_incidents):
    plain = logs.join(found_incidents, F.col("normalized_timestamp").between(F.col("start_time"), F.col("end_time")))
    assert evidence.rows_in_span(logs, found_incidents).count() == plain.count()
