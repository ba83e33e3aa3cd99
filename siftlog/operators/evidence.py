"""Evidence of incidents: the records in their time span, figures, report texts and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlog.functions.text import quoted, time_text
from siftlog.operators.ordering import RANGE, by_range, find_cuts, with_range
from siftlog.session import stage

TIME = "normalized_timestamp"
# Incidents of a time range, about.
RANGE_SPANS = 64

# Records of evidence per incident, values listed per figure, and the columns shown.
EVIDENCE_ROWS = 40
TOP_VALUES = 5
EVIDENCE_COLUMNS = ("normalized_timestamp", "component", "parsed_message_type", "message", "severity", "is_anomaly")

# The report and the prompt; {names} stand for columns.
REPORT = """### Incident Summary

**{incident_id}** is a **{severity}** incident affecting
**{primary_component}** from **{start_text}** to
**{end_text}**.

- Evidence records: **{evidence_records}**
- Anomalous records: **{anomalous_records}**
- Error/failure signals: **{error_records}**
- Dominant components: `{top_components}`
- Dominant message types: `{top_types}`

**Assessment:** The incident is correlated from timestamp proximity and operational
error/anomaly signals. This is an evidence summary, not a definitive root-cause claim.
Review the evidence records before taking action."""

PROMPT = """
You are an SRE/log-analysis assistant.
Analyze ONLY the evidence below.

Incident metadata:
{metadata}

Evidence:
{evidence}

Return:
1. Executive summary
2. Strongest evidence
3. Probable cause hypotheses, clearly labeled as hypotheses
4. Affected components
5. Recommended investigation steps
6. Confidence and limitations

Do not invent log events, metrics, root causes, or remediation results.
"""
ROLE = "You are a precise, evidence-grounded log analyst."


def _last_begun(spans: Column, time: Column, most: int) -> Column:
    """The last of at most `most` spans, sorted by their start, that starts at `time` or before; found by halving."""
    found = F.lit(0)
    for place in range(most.bit_length() - 1, -1, -1):
        found = _further(spans, time, found, 1 << place)
    return F.element_at(F.transform(F.array(found), lambda n: F.when(n > 0, F.get(spans, n - 1))), 1)


def _further(spans: Column, time: Column, found: Column, step: int) -> Column:
    def go(n: Column) -> Column:
        return F.when((n + step <= F.size(spans)) & (F.get(spans, n + (step - 1))["start"] <= time), n + step).otherwise(n)

    return F.element_at(F.transform(F.array(found), go), 1)


def rows_in_span(logs: DataFrame, incidents: DataFrame) -> DataFrame:
    """All records, not only signals, between the start and the end of an incident.

    An as-of join: time is cut into ranges with about `RANGE_SPANS` incidents each. A
    range has the list of those that start in it, after the one before, which may
    still be open. A record goes to its range and finds the last incident that has
    begun, so an incident is two rows at most, however long it is. Incidents of one
    table don't overlap.
    """
    started = F.unix_micros("start_time").cast("double")
    known = incidents.filter("start_time is not null")
    cuts = find_cuts(known, {"start": started}, RANGE_SPANS, 1)["start"]
    span = F.struct(F.unix_micros("start_time").alias("start"), F.unix_micros("end_time").alias("end"), "incident_id")
    lists = with_range(known, started, cuts).groupBy(RANGE).agg(F.array_sort(F.collect_list(span)).alias("_own"))
    # A row per range.
    before = F.lag(F.get("_own", F.size("_own") - 1)).over(by_range())
    lists = stage(lists.select(RANGE, F.when(before.isNull(), F.col("_own")).otherwise(F.concat(F.array(before), "_own")).alias("_spans")), "spans")
    most = lists.agg(F.max(F.size("_spans"))).first()[0] or 0
    time = F.unix_micros(TIME)
    timed = with_range(logs.select("event_id", *EVIDENCE_COLUMNS, "severity_score").filter(F.col(TIME).isNotNull()), time.cast("double"), cuts)
    met = timed.join(lists, RANGE).withColumn("_span", _last_begun(F.col("_spans"), time, most))
    return met.filter(time <= F.col("_span.end")).withColumn("incident_id", F.col("_span.incident_id")).drop(RANGE, "_spans", "_span")


def evidence(logs: DataFrame, incidents: DataFrame, limit: int = EVIDENCE_ROWS) -> DataFrame:
    """The first records of every incident by time, numbered from 1.

    The limit applies before the shuffle too, so a long incident stays small.
    """
    by_time = Window.partitionBy("incident_id").orderBy(TIME, "event_id")
    place = F.row_number().over(by_time)
    return rows_in_span(logs, incidents).withColumn("place", place).filter(F.col("place") <= limit)


def incident_evidence(logs: DataFrame, incidents: DataFrame, incident_id: str, limit: int = EVIDENCE_ROWS) -> DataFrame:
    """The evidence of one incident."""
    one = incidents.filter(F.col("incident_id") == incident_id)
    return evidence(logs, one, limit).orderBy("place").select(*EVIDENCE_COLUMNS)


def _top(found: DataFrame, column: str, out: str, values: int) -> DataFrame:
    """Per incident, the most frequent values with counts; first seen goes first on a tie."""
    counts = found.groupBy("incident_id", F.col(column).alias("value")).agg(
        F.count("*").alias("records"), F.min("place").alias("first")
    )
    frequency = Window.partitionBy("incident_id").orderBy(F.desc("records"), "first")
    top = counts.withColumn("rank", F.row_number().over(frequency)).filter(F.col("rank") <= values)
    listed = F.array_sort(F.collect_list(F.struct("rank", "value", "records")))
    return top.groupBy("incident_id").agg(
        F.transform(listed, lambda entry: F.struct(entry["value"].alias("value"), entry["records"].alias("records"))).alias(out)
    )


def value_counts_text(entries: Column) -> Column:
    """`{'a': 3, 'b': 1}`"""
    parts = F.transform(entries, lambda e: F.concat(quoted(e["value"]), F.lit(": "), e["records"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def evidence_figures(found: DataFrame, values: int = TOP_VALUES) -> DataFrame:
    """Per incident with evidence: records, anomalies, errors, and up to `values` top components and types."""
    totals = found.groupBy("incident_id").agg(
        F.count("*").alias("evidence_records"),
        F.count_if("is_anomaly").alias("anomalous_records"),
        F.count_if(F.col("severity_score") >= 2).alias("error_records"),
    )
    components = _top(found, "component", "top_components", values)
    types = _top(found, "parsed_message_type", "top_types", values)
    return totals.join(components, "incident_id").join(types, "incident_id")


def _fill(template: str, columns: dict[str, Column]) -> Column:
    """The template with each {name} replaced by its column."""
    parts, rest = [], template
    while "{" in rest:
        text, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(text), columns[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def summaries(incidents: DataFrame, found: DataFrame) -> DataFrame:
    """`incident_id` and a report text per incident, with no model involved."""
    figures = evidence_figures(found)
    joined = incidents.join(figures, "incident_id", "left")
    columns = {name: F.col(name) for name in ("incident_id", "severity", "primary_component")}
    columns |= {"start_text": time_text(F.col("start_time")), "end_text": time_text(F.col("end_time"))}
    for name in ("evidence_records", "anomalous_records", "error_records"):
        columns[name] = F.coalesce(F.col(name), F.lit(0))
    for name in ("top_components", "top_types"):
        columns[name] = F.coalesce(value_counts_text(F.col(name)), F.lit("{}"))
    return joined.select("incident_id", _fill(REPORT, columns).alias("summary"))


def prompts(incidents: DataFrame, found: DataFrame) -> DataFrame:
    """`incident_id`, `role` and `prompt`: what an external model is to be asked."""
    record = F.struct(time_text(F.col(TIME)).alias(TIME), *EVIDENCE_COLUMNS[1:])
    rows = found.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("place", record.alias("record")))).alias("rows"))
    metadata = F.struct(
        "incident_id",
        "severity",
        "primary_component",
        time_text(F.col("start_time")).alias("start_time"),
        time_text(F.col("end_time")).alias("end_time"),
        "event_count",
    )
    columns = {
        "metadata": F.to_json(metadata),
        "evidence": F.coalesce(F.to_json("rows.record"), F.lit("[]")),
    }
    joined = incidents.join(rows, "incident_id", "left")
    return joined.select("incident_id", F.lit(ROLE).alias("role"), _fill(PROMPT, columns).alias("prompt"))
