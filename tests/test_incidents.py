from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import at, signals
from siftlog.operators import incidents
from siftlog.operators.features import build_features


def brute_force(rows, gap=5.0):
    """The rules, one signal after the other. Rows as in `signals`."""
    keyed = [(f"{i:06d}", *row) for i, row in enumerate(rows)]
    keyed.sort(key=lambda r: (r[1] is None, r[1] if r[1] is not None else 0, r[0]))
    groups, previous = [], None
    for row in keyed:
        opens = False
        if previous is not None and row[1] is not None and previous[1] is not None:
            pause = (at(row[1]) - at(previous[1])) / timedelta(minutes=1)
            opens = pause > gap or (row[2] != previous[2] and pause > 1)
        if opens or not groups:
            groups.append([])
        groups[-1].append(row)
        previous = row
    found = {}
    for number, group in enumerate(groups):
        times = [at(r[1]) for r in group if r[1] is not None]
        counts = {}
        for r in group:
            counts[r[2]] = counts.get(r[2], 0) + 1
        listed = sorted(counts, key=lambda c: -counts[c])[:8]
        start, end = (min(times), max(times)) if times else (None, None)
        found[f"INC-{number:05d}"] = (
            start,
            end,
            round((end - start) / timedelta(minutes=1), 2) if times else None,
            len(group),
            ", ".join(listed),
            listed[0],
            {3: "High", 2: "Medium"}.get(max(r[3] for r in group), "Low"),
            sum(r[4] for r in group),
        )
    return found


COLUMNS = ("start_time", "end_time", "duration_minutes", "event_count", "affected_components", "primary_component", "severity", "anomaly_count")


def built(frame, gap=5.0):
    return {row.incident_id: tuple(row[name] for name in COLUMNS) for row in incidents.build_incidents(frame, gap).collect()}


def test_golden_case(spark):
    data = [(str(i), at(i / 60), "A", "save failed" if i in (5, 6, 7) else "normal event", "x", "{}") for i in range(20)]
    logs = spark.createDataFrame(
        data, "event_id string, normalized_timestamp timestamp, component string, message string, parsed_message_type string, extracted_metrics string"
    )
    scored = build_features(logs).withColumns({"is_anomaly": F.lit(False), "is_signal": F.col("severity_score") >= 2})
    assert built(scored) == {"INC-00000": (at(5 / 60), at(7 / 60), 0.03, 3, "A", "A", "Medium", 0)}


@pytest.mark.parametrize(
    ("rows", "sizes"),
    [
        ([(0, "A", 2, False), (5, "A", 2, False)], [2]),
        ([(0, "A", 2, False), (5.001, "A", 2, False)], [1, 1]),
        ([(0, "A", 2, False), (1, "B", 2, False)], [2]),
        ([(0, "A", 2, False), (1.001, "B", 2, False)], [1, 1]),
        ([(0, "A", 2, False), (1.001, "A", 2, False)], [2]),
        ([(0, "A", 2, False), (9, "A", 2, False), (None, "B", 3, True)], [1, 2]),
        ([(None, "A", 2, False), (None, "B", 2, False)], [2]),
    ],
)
def test_boundaries(spark, rows, sizes):
    found = built(signals(spark, rows))
    assert [found[f"INC-{i:05d}"][3] for i in range(len(found))] == sizes
    assert found == brute_force(rows)


def random_rows(seed, count, span, hot=0.0, nulls=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(count):
        minutes = round(float(rng.uniform(0, span)) * 4) / 4
        if rng.random() < hot:
            minutes = span / 2
        if rng.random() < nulls:
            minutes = None
        rows.append((minutes, f"c{rng.integers(0, 12)}", int(rng.integers(0, 4)), bool(rng.random() < 0.3)))
    return rows


@pytest.mark.parametrize(
    ("seed", "count", "span", "hot", "nulls", "gap"),
    [(1, 400, 3_000, 0, 0, 5.0), (2, 400, 600, 0.35, 0, 5.0), (3, 300, 2_000, 0.1, 0.3, 5.0), (4, 300, 20_000, 0, 0.01, 30.0)],
)
def test_against_brute_force(spark, seed, count, span, hot, nulls, gap):
    rows = random_rows(seed, count, span, hot, nulls)
    assert built(signals(spark, rows).repartition(6), gap) == brute_force(rows, gap)


def test_range_windows_agree_with_one_global_window(spark):
    frame = signals(spark, random_rows(9, 500, 4_000, 0.2, 0.05))
    order = Window.orderBy(F.asc_nulls_last("normalized_timestamp"), "event_id")
    gap = incidents.minutes_between(F.lag("normalized_timestamp").over(order), F.col("normalized_timestamp"))
    changed = F.lag("component").over(order) != F.col("component")
    opens = frame.withColumn("opens", F.coalesce((gap > 5) | (changed & (gap > 1)), F.lit(False)).cast("long"))
    expected = opens.select("event_id", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("session"))
    found = incidents.assign_sessions(frame).select("event_id", "session")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_anomalies_without_severity_are_low(spark):
    assert built(signals(spark, [(0, "A", 0, True)]))["INC-00000"][6:] == ("Low", 1)


def test_list_order(spark):
    rows = [(0, "A", 2, False), (100, "A", 3, False), (200, "A", 1, True), (300, "A", 3, False)]
    frame = incidents.build_incidents(signals(spark, rows))
    listed = [(row.severity, row.start_time) for row in incidents.in_list_order(frame).collect()]
    assert listed == [("High", at(300)), ("High", at(100)), ("Low", at(200)), ("Medium", at(0))]
    ranked = [row.severity for row in incidents.in_list_order(frame, by_rank=True).collect()]
    assert ranked == ["High", "High", "Medium", "Low"]


def test_no_signal(spark):
    empty = incidents.build_incidents(signals(spark, [(0, "A", 0, False)]).withColumn("is_signal", F.lit(False)))
    assert empty.columns == ["incident_id", *COLUMNS] and empty.count() == 0
