"""Incidents: signals grouped by time gap and component change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlog.functions.text import severity_label
from siftlog.operators.ordering import RANGE, by_range, find_cuts, running_total, with_range
from siftlog.session import stage

# Minutes without a signal that end an incident, minutes after
# which a change of component ends one, and the text forms of the result.
GAP_MINUTES = 5.0
CHANGE_MINUTES = 1.0
INCIDENT_ID = "INC-%05d"
LISTED_COMPONENTS = 8
COMPONENT_SEPARATOR = ", "

TIME = "normalized_timestamp"


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(6e7)


def signals_of(scored: DataFrame) -> DataFrame:
    """The rows that count for incidents."""
    return scored.filter("is_signal")


def _moments(signals: DataFrame) -> DataFrame:
    """One row per time and component, so that a busy instant stays small."""
    return signals.groupBy(TIME, "component").agg(
        F.count("*").alias("events"),
        F.max("severity_score").alias("severity_score"),
        F.sum(F.col("is_anomaly").cast("long")).alias("anomalies"),
        F.min("event_id").alias("first_id"),
        F.max("event_id").alias("last_id"),
    )


def _instants(moments: DataFrame) -> DataFrame:
    """One row per time with the components of its first and last signal."""
    return moments.groupBy(TIME).agg(
        F.min_by("component", "first_id").alias("first_component"),
        F.max_by("component", "last_id").alias("last_component"),
    )


def instants_of(signals: DataFrame) -> DataFrame:
    """The instants of a signal table, staged: several jobs read them."""
    return _instants(stage(_moments(signals), "moments"))


def boundaries(instants: DataFrame, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Per instant: the time and component before it, the gap, and whether a session opens."""
    position = F.unix_micros(TIME).cast("double")
    cuts = find_cuts(instants, {"time": position})["time"]
    placed = with_range(instants, position, cuts)
    inside = Window.partitionBy(RANGE).orderBy(F.asc_nulls_last(TIME))
    lasts = placed.groupBy(RANGE).agg(
        F.max(TIME).alias("_time"), F.max_by("last_component", TIME).alias("_component")
    )
    # The last row of the range before; one row per range, so the size is bounded.
    carried = lasts.select(
        RANGE,
        F.lag("_time").over(by_range()).alias("_time"),
        F.lag("_component").over(by_range()).alias("_component"),
    )
    previous = placed.withColumns(
        {"previous_time": F.lag(TIME).over(inside), "previous_component": F.lag("last_component").over(inside)}
    ).join(F.broadcast(carried), RANGE)
    known = previous.withColumns(
        {
            "previous_time": F.coalesce("previous_time", "_time"),
            "previous_component": F.coalesce("previous_component", "_component"),
        }
    ).drop("_time", "_component")
    gap = F.col("gap_minutes")
    opens = (gap > gap_minutes) | (F.col("changed") & (gap > CHANGE_MINUTES))
    return known.withColumns(
        {
            "gap_minutes": minutes_between(F.col("previous_time"), F.col(TIME)),
            "changed": ~F.col("first_component").eqNullSafe(F.col("previous_component")),
        }
    ).withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int"))


def sessions(instants: DataFrame, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Each instant with the number of its session; the first session is 0.

    A signal without a time has no gap, so it belongs to the last session.
    """
    opened = boundaries(instants, gap_minutes)
    return running_total(opened, TIME, "opens", "session").select(TIME, "session")


def assign_sessions(signals: DataFrame, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Signal rows with their session number."""
    numbered = sessions(instants_of(signals), gap_minutes).withColumnRenamed(TIME, "_time")
    return signals.join(numbered, F.col(TIME).eqNullSafe(F.col("_time"))).drop("_time")


def _by_component(signals: DataFrame, gap_minutes: float) -> DataFrame:
    """One row per session and component."""
    # Several jobs read the moments, so the records behind them are read once.
    moments = stage(_moments(signals), "moments")
    numbered = sessions(_instants(moments), gap_minutes).withColumnRenamed(TIME, "_time")
    position = F.struct(F.col(TIME).isNull(), F.col(TIME), F.col("first_id"))
    return (
        moments.join(numbered, F.col(TIME).eqNullSafe(F.col("_time")))
        .groupBy("session", "component")
        .agg(
            F.min(TIME).alias("start_time"),
            F.max(TIME).alias("end_time"),
            F.sum("events").alias("events"),
            F.max("severity_score").alias("severity_score"),
            F.sum("anomalies").alias("anomalies"),
            F.min(position).alias("first_seen"),
        )
    )


def _listed(parts: DataFrame, components: int) -> DataFrame:
    """Per session, the components that come first by frequency, then first occurrence, then name.

    The limit applies before the shuffle too, so a session of very many components stays small.
    """
    frequency = Window.partitionBy("session").orderBy(F.desc("events"), "first_seen", "component")
    best = parts.withColumn("place", F.row_number().over(frequency)).filter(F.col("place") <= components)
    return best.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("place", "component"))).alias("listed"))


def build_incidents(scored: DataFrame, gap_minutes: float = GAP_MINUTES, components: int = LISTED_COMPONENTS) -> DataFrame:
    """One row per incident with up to `components` of its components, in no order; see `in_list_order`."""
    parts = stage(_by_component(signals_of(scored), gap_minutes), "session-components")
    totals = parts.groupBy("session").agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.sum("events").alias("event_count"),
        F.max("severity_score").alias("severity_score"),
        F.sum("anomalies").alias("anomaly_count"),
    )
    grouped = totals.join(_listed(parts, components), "session")
    return grouped.select(
        F.format_string(INCIDENT_ID, "session").alias("incident_id"),
        "start_time",
        "end_time",
        F.bround(minutes_between(F.col("start_time"), F.col("end_time")), 2).alias("duration_minutes"),
        "event_count",
        F.array_join("listed.component", COMPONENT_SEPARATOR).alias("affected_components"),
        F.col("listed")[0]["component"].alias("primary_component"),
        severity_label(F.col("severity_score"), below="Low").alias("severity"),
        "anomaly_count",
    )


def in_list_order(incidents: DataFrame, by_rank: bool = False) -> DataFrame:
    """By severity as text, latest first; with `by_rank`, most severe first."""
    if by_rank:
        rank = F.when(F.col("severity") == "High", 0).when(F.col("severity") == "Medium", 1).otherwise(2)
        return incidents.orderBy(rank, F.desc("start_time"), "incident_id")
    return incidents.orderBy("severity", F.desc("start_time"), "incident_id")
