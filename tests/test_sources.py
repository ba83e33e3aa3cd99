import json

import pytest
from pyspark.sql import functions as F

from siftlog.sources import jsonl, profile


def record(**fields) -> str:
    base = {
        "event_id": "1",
        "normalized_timestamp": "2017-01-01T00:00:00Z",
        "component": "A",
        "message": "hello",
        "parsed_message_type": "x",
    }
    return json.dumps({k: v for k, v in {**base, **fields}.items() if v != "absent"})


def test_blank_lines_are_skipped_and_bad_lines_fail(spark, lines_file):
    good = lines_file(record(), "", "   ", record(event_id="2"))
    assert jsonl.load_logs(spark, good).count() == 2
    bad = lines_file(record(), "{bad json", "[1]", name="bad.jsonl")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        jsonl.scan_jsonl(spark, bad).collect()
    kept = jsonl.scan_jsonl(spark, bad, tolerant=True).select("event_id", jsonl.CORRUPT).collect()
    assert {(row[0], row[1]) for row in kept} == {("1", None), (None, "{bad json"), (None, "[1]")}


def test_empty_source_and_missing_columns_raise(spark, lines_file):
    with pytest.raises(ValueError, match="no records"):
        jsonl.load_logs(spark, lines_file("", " "))
    incomplete = lines_file(record(component="absent", message="absent"), name="incomplete.jsonl")
    with pytest.raises(ValueError, match=r"\['component', 'message'\]"):
        jsonl.load_logs(spark, incomplete)


def test_a_required_key_may_be_absent_from_some_records(spark, lines_file):
    path = lines_file(record(), record(event_id="2", component="absent"), record(event_id="3", component=None))
    found = {row.event_id: row.component for row in jsonl.load_logs(spark, path).collect()}
    assert found == {"1": "A", "2": "unknown", "3": "unknown"}


def test_unknown_keys_are_kept(spark, lines_file):
    path = lines_file(record(host="a", trace_id={"z": 1, "b": [2]}, Component="C"), record(event_id="2"))
    found = {row[0]: row[1] for row in jsonl.load_logs(spark, path).selectExpr("event_id", "to_json(other_fields)").collect()}
    assert json.loads(found["1"]) == {"host": "a", "trace_id": {"z": 1, "b": [2]}, "Component": "C"}
    assert json.loads(found["2"]) == {}


def test_fields_may_appear_late(spark, lines_file):
    late = lines_file(*[record(component="absent")] * 5, record())
    assert jsonl.missing_fields(jsonl.present_fields(spark, late)) == []
    never = lines_file(*[record(component="absent")] * 5, name="never.jsonl")
    assert jsonl.missing_fields(jsonl.present_fields(spark, never)) == ["component"]


def test_defaults_and_types(spark, lines_file):
    path = lines_file(record(message=None, parsed_message_type=None), record(event_id=7, message=5, component=True))
    rows = {row.event_id: row for row in jsonl.load_logs(spark, path).collect()}
    assert (rows["1"].message, rows["1"].parsed_message_type) == ("", "unknown")
    assert (rows["7"].message, rows["7"].component) == ("5", "true")


def test_times_become_utc_instants(spark, lines_file):
    times = ["2017-01-01T05:30:00+05:30", "2017-01-01T00:00:00.25Z", "2017-01-01 00:00:00", "2017-01-01", "nonsense", None]
    path = lines_file(*[record(event_id=str(i), normalized_timestamp=t) for i, t in enumerate(times)])
    found = jsonl.load_logs(spark, path).withColumn("micros", F.unix_micros("normalized_timestamp"))
    midnight = 1483228800000000
    assert {r.event_id: r.micros for r in found.collect()} == {
        "0": midnight,
        "1": midnight + 250000,
        "2": midnight,
        "3": midnight,
        "4": None,
        "5": None,
    }
    ordered = [r.event_id for r in jsonl.in_time_order(found).collect()]
    assert ordered == ["0", "2", "3", "1", "4", "5"]


def test_source_selection(monkeypatch):
    monkeypatch.delenv(jsonl.SOURCE_SETTING, raising=False)
    assert jsonl.resolve_source() == jsonl.DEFAULT_SOURCE
    monkeypatch.setenv(jsonl.SOURCE_SETTING, "/logs/a.jsonl")
    assert jsonl.resolve_source() == "/logs/a.jsonl"
    assert jsonl.resolve_source("/logs/b.jsonl") == "/logs/b.jsonl"


def test_export_writes_times_as_text(spark, lines_file, tmp_path):
    path = lines_file(record(), record(event_id="2", normalized_timestamp="2017-01-01T00:00:00.5Z"), record(event_id="3", normalized_timestamp="?"))
    out = str(tmp_path / "out")
    jsonl.write_jsonl(jsonl.load_logs(spark, path).select("event_id", "normalized_timestamp"), out)
    found = {row.event_id: row.normalized_timestamp for row in spark.read.json(out).collect()}
    assert found == {"1": "2017-01-01 00:00:00+00:00", "2": "2017-01-01 00:00:00.500000+00:00", "3": "NaT"}


def test_tables_are_written_by_day(spark, lines_file, tmp_path):
    path = lines_file(record(), record(event_id="2", normalized_timestamp="2017-01-02T00:00:00Z"), record(event_id="3", normalized_timestamp="?"))
    out = str(tmp_path / "table")
    logs = jsonl.load_logs(spark, path).select(*jsonl.REQUIRED_FIELDS)
    jsonl.write_table(logs, out)
    back = spark.read.parquet(out)
    assert back.filter("log_date = date'2017-01-02'").count() == 1
    assert back.count() == 3


def test_profile(spark, lines_file):
    lines = [
        record(),
        record(event_id="2", component="absent"),
        record(event_id="3", component=None, message="absent"),
        record(event_id="4", component="B"),
        record(event_id="5", component="B"),
        "",
        "   ",
        "{bad json",
        "[1]",
        record() + " and more",
        "{'event_id': '6'}",
        record()[:-1],
    ]
    found = profile.tally(profile.read_lines(spark, lines_file(*lines)))
    assert profile.line_counts(found).first().asDict() == {"records": 5, "invalid_lines": 5, "components": 4}
    top = [(row["value"], row["records"]) for row in profile.top_values(found, "component").collect()]
    assert top[0] == ("B", 2) and set(top[1:]) == {("A", 1), ("MISSING", 1), (None, 1)}
    assert {tuple(row) for row in profile.absent_fields(found).collect()} == {("component", 1), ("message", 1)}
