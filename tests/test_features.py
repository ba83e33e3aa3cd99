import json
import math

import pytest
from pyspark.sql import functions as F

from siftlog.functions import metrics, text
from siftlog.operators import features, matrix

LOG_SCHEMA = "event_id string, normalized_timestamp timestamp, component string, message string, parsed_message_type string, extracted_metrics string"


def logs(spark, rows):
    """Rows of (message, metrics); one second apart."""
    data = [(str(i), message, kind) for i, (message, kind) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id string, message string, extracted_metrics string").select(
        "event_id",
        (F.timestamp_micros(F.lit(1483228800000000) + F.col("event_id").cast("long") * 1000000)).alias("normalized_timestamp"),
        F.lit("A").alias("component"),
        "message",
        F.lit("x").alias("parsed_message_type"),
        "extracted_metrics",
    )


def test_database_error(spark):
    row = features.build_features(logs(spark, [("database error occurred", "{}")])).first()
    assert (row.severity, row.severity_score, row.message_length, row.word_count, row.has_metric) == ("Medium", 2, 23, 3, False)
    assert (row.hour, row.minute, row.second) == (0, 0, 0.0)


@pytest.mark.parametrize(
    ("message", "score"),
    [
        ("FATAL: disk", 3),
        ("it crashed", 3),
        ("crashes often", 0),
        ("kernel panic!", 3),
        ("an exception, an error", 3),
        ("timed out", 0),
        ("request timeout", 3),
        ("Permission denied", 3),
        ("user_error", 0),
        ("errors", 0),
        ("NOT FOUND", 2),
        ("not  found", 0),
        ("failure", 2),
        ("failing", 0),
        ("unable to warn", 2),
        ("warn", 1),
        ("Warning: x", 1),
        ("warnings", 0),
        ("éerror", 0),
        ("erroré", 0),
        ("«invalid»", 2),
        ("", 0),
    ],
)
def test_severity(spark, message, score):
    row = spark.createDataFrame([(message,)], "m string").select(text.severity_score(F.col("m")).alias("s")).first()
    assert row.s == score


def test_lengths_and_words_follow_unicode(spark):
    cases = ["a b", "  a\tb\n", "a b", "\U0001f600 ok", "a\x1cb", "", " 　 ", "a​b"]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, m string")
    found = frame.select("i", text.message_length(F.col("m")).alias("n"), text.word_count(F.col("m")).alias("w")).collect()
    for row in found:
        assert row.n == len(cases[row.i])
        assert row.w == len(cases[row.i].split())


def test_quoted(spark):
    cases = ["plain", "it's", 'say "x"', "it's \"x\"", "back\\slash", "two\nlines\t"]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, m string")
    for row in frame.select("i", text.quoted(F.col("m")).alias("q")).collect():
        assert row.q == repr(cases[row.i])


NESTED = '{"z": 1, "io": {"read": 2.5, "deep": {"x": 3}}, "ok": true, "mixed": 1, "name": "n", "list": [1]}'
OTHER = '{"z": 4, "io": {"read": 5}, "mixed": "text", "name": null}'


def test_metric_presence(spark):
    rows = [("m", NESTED), ("m", "{}"), ("m", None), ("m", "5"), ("m", "[1]"), ("m", '"text"')]
    frame = logs(spark, rows)
    found = frame.select("event_id", metrics.has_metric(metrics.metrics_text(frame)).alias("h")).collect()
    assert {int(r.event_id) for r in found if r.h} == {0}


def test_metrics_kept_as_variant_or_struct(spark):
    frame = logs(spark, [("m", NESTED), ("m", "{}")])
    variant = frame.withColumn("extracted_metrics", F.parse_json("extracted_metrics"))
    struct = frame.withColumn("extracted_metrics", F.from_json("extracted_metrics", "z long"))
    for kept in (variant, struct):
        found = features.build_features(kept).orderBy("event_id").collect()
        assert [row.has_metric for row in found] == [True, False]
        assert [row.metric_z for row in found] == [1.0, None]
    without = frame.drop("extracted_metrics")
    assert features.build_features(without).filter("has_metric").count() == 0


def test_flattening(spark):
    found = features.build_features(logs(spark, [("m", NESTED), ("m", OTHER), ("m", None)])).orderBy("event_id").collect()
    assert [row["metric_io.read"] for row in found] == [2.5, 5.0, None]
    assert [row["metric_io.deep.x"] for row in found] == [3.0, None, None]
    assert [row["metric_mixed"] for row in found] == ["1", "text", None]
    assert [row["metric_name"] for row in found] == ["n", None, None]


def test_unusual_metric_names(spark):
    frame = logs(spark, [("m", json.dumps({"a b": 1, "x.y": 2, "it's": 3, 'q"r': 4, "OBJECT<z": 5, "1st": {"in ner": 6}, "`": 7}))])
    flat = features.build_features(frame).first().asDict()
    names = {"a b": 1, "x.y": 2, "it's": 3, 'q"r': 4, "OBJECT<z": 5, "1st.in ner": 6, "`": 7}
    assert {k: flat["metric_" + k] for k in names} == names


def test_metric_names_with_both_quotes(spark):
    both = "it's \"q\""
    frame = logs(spark, [("m", json.dumps({"a": 1, both: 2, "up": {both: {"z": 3, both: 4, "b": 5}}})), ("m", json.dumps({both: 7})), ("m", json.dumps({"up": 1}))])
    assert [leaf.keys for leaf in metrics.numeric_leaves(frame)] == [("a",), (both,)]
    frame = frame.limit(2)
    names = [leaf.column for leaf in metrics.numeric_leaves(frame)]
    assert names == [f"metric_{name}" for name in ("a", both, f"up.{both}.z", f"up.{both}.{both}", f"up.{both}.b")]
    found = features.build_features(frame).orderBy("event_id").collect()
    assert [[row[name] for name in names] for row in found] == [[1, 2, 3, 4, 5], [None, 7, None, None, None]]


def test_numeric_leaves(spark):
    frame = logs(spark, [("m", NESTED), ("m", OTHER)])
    assert {leaf.column for leaf in metrics.numeric_leaves(frame)} == {"metric_z", "metric_io.read", "metric_io.deep.x"}
    everywhere = logs(spark, [("m", '{"b": true, "n": 1}'), ("m", '{"b": false}')])
    assert {leaf.column for leaf in metrics.numeric_leaves(everywhere)} == {"metric_b", "metric_n"}


def test_first_eight_metrics_in_order_of_appearance(spark):
    first = '{"k9": 1, "sub": {"y": 1, "x": 2}, "k1": 2}'
    later = "{" + ", ".join(f'"k{i}": {i}' for i in range(12)) + "}"
    names = [leaf.column for leaf in metrics.numeric_leaves(logs(spark, [("m", first), ("m", later)]))]
    assert names == ["metric_k9", "metric_k1", "metric_sub.y", "metric_sub.x", "metric_k0", "metric_k2", "metric_k3", "metric_k4"]


def test_feature_columns_of_a_flat_table(spark):
    flat = features.build_features(logs(spark, [("m", NESTED)]))
    names = matrix.feature_columns(flat)
    assert names[:6] == list(features.BASE_FEATURES)
    assert set(names[6:]) == {"metric_z", "metric_io.read", "metric_io.deep.x", "metric_ok", "metric_mixed"}
    with pytest.raises(ValueError):
        matrix.feature_columns(spark.createDataFrame([("a",)], "x string"))


def test_flat_columns_come_before_metrics_objects(spark):
    rows = logs(spark, [("m", '{"a": 1, "flat": 5, "b": 2.5}'), ("n", '{"a": 3, "flat": 6, "b": 1}')])
    flat = rows.withColumns({"metric_flat": F.lit(2.0), "metric_text": F.lit("x"), "metric_on": F.lit(True), "metric_gap": F.when(F.col("event_id") == "0", True)})
    choice = matrix.choose_features(flat)
    assert choice.names[6:] == ("metric_flat", "metric_on", "metric_a", "metric_b")
    assert [matrix.choose_features(flat, n).names[6:] for n in (1, 3)] == [("metric_flat",), ("metric_flat", "metric_on", "metric_a")]
    made = features.build_features(flat, list(choice.leaves)).orderBy("event_id").select(matrix.matrix(choice.names[6:])).collect()
    assert [row[0] for row in made] == [[2.0, 1.0, 1.0, 2.5], [2.0, 1.0, 3.0, 1.0]]


def test_cleaning_and_scaling(spark):
    rows = [(1.0, 5.0), (math.inf, 5.0), (-math.inf, 5.0), (math.nan, 5.0), (None, 5.0), (7.0, 5.0)]
    frame = spark.createDataFrame(rows, "a double, b double")
    assert sorted(row[0][0] for row in frame.select(matrix.matrix(["a"])).collect()) == [0, 0, 0, 0, 1, 7]
    scaling = matrix.fit_scaling(frame, ["a", "b"])
    values = [1, 0, 0, 0, 0, 7]
    mean = sum(values) / 6
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / 6)
    found = [row[0] for row in frame.select(scaling.scaled()).collect()]
    assert all(pair[1] == 0 for pair in found)
    assert [pair[0] for pair in found] == pytest.approx([(v - mean) / spread for v in values])


def test_samples_do_not_depend_on_the_layout(spark):
    frame = spark.range(20_000).select(F.col("id").cast("string").alias("event_id"))
    one = matrix.sample_rows(frame, 500)
    other = matrix.sample_rows(frame.repartition(7, F.rand(3)), 500)
    taken = {row.event_id for row in one.collect()}
    assert len(taken) == 500 and taken == {row.event_id for row in other.collect()}
    assert taken != {row.event_id for row in matrix.sample_rows(frame, 500, seed=1).collect()}
    assert matrix.sample_rows(frame, 30_000).count() == 20_000
    # One key for all rows leaves the hash bound too few or too many rows.
    alike = spark.range(5_000).select(F.lit("same").alias("event_id"), "id")
    assert matrix.sample_rows(alike, 100).count() == 100
