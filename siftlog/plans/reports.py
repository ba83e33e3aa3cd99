"""The reports over scored records and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.functions.text import SEVERITY_TIERS
from siftlog.operators.ensemble import TITLES
from siftlog.operators.matrix import SEED, sample_rows
from siftlog.sources.jsonl import export_records, in_time_order

# Report sizes and columns.
TOP_COMPONENTS = 15
MOST_AFFECTED = 12
PLOT_ROWS = 5_000
CONSENSUS_ROWS = 500
PAGE_COLUMNS = (
    "event_id",
    "normalized_timestamp",
    "component",
    "parsed_message_type",
    "message",
    "severity",
    "anomaly_score",
    "is_anomaly",
)
CONSENSUS_COLUMNS = (
    "event_id",
    "normalized_timestamp",
    "component",
    "parsed_message_type",
    "message",
    "anomaly_votes",
    "ensemble_score",
    "isolation_forest_score",
    "autoencoder_score",
    "hdbscan_score",
    "severity",
)
HOVER_COLUMNS = ("component", "parsed_message_type", "message")
AGREEMENT_PAIRS = (
    ("Isolation Forest vs Autoencoder", "isolation_forest", "autoencoder"),
    ("Isolation Forest vs HDBSCAN", "isolation_forest", "hdbscan"),
    ("Autoencoder vs HDBSCAN", "autoencoder", "hdbscan"),
)


def facet_values(scored: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, sorted."""
    return scored.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def filter_records(
    scored: DataFrame,
    components: list[str] | None = None,
    message_types: list[str] | None = None,
    min_severity: str = "All",
) -> DataFrame:
    """Records of the chosen components, types and severities; no choice is no filter."""
    kept = scored
    if components:
        kept = kept.filter(F.col("component").isin(*components))
    if message_types:
        kept = kept.filter(F.col("parsed_message_type").isin(*message_types))
    if min_severity != "All":
        floor = {label: score for label, score, _ in SEVERITY_TIERS}[min_severity]
        kept = kept.filter(F.col("severity_score") >= floor)
    return kept


def overview(view: DataFrame, incidents: DataFrame) -> DataFrame:
    """Figures of the filtered records, and the number of all incidents."""
    counted = incidents.agg(F.count("*").alias("n"))
    return view.agg(
        F.count("*").alias("processed_logs"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.count_if(F.col("severity_score") >= 2).alias("error_signals"),
    ).withColumn("incidents", counted.scalar())


def _activity(view: DataFrame, *keys: F.Column) -> DataFrame:
    return view.groupBy(*keys).agg(
        F.count("event_id").alias("logs"), F.sum(F.col("is_anomaly").cast("long")).alias("anomalies")
    )


def component_activity(view: DataFrame, limit: int = TOP_COMPONENTS) -> DataFrame:
    """Logs and anomalies of the components with most logs."""
    return _activity(view, F.col("component")).orderBy(F.desc("logs"), "component").limit(limit)


def most_affected(view: DataFrame, limit: int = MOST_AFFECTED) -> DataFrame:
    """The components with most anomalies, then most logs."""
    return _activity(view, F.col("component")).orderBy(F.desc("anomalies"), F.desc("logs"), "component").limit(limit)


def hourly_activity(view: DataFrame) -> DataFrame:
    """Logs and anomalies of every hour from the first to the last; 0 where there are none."""
    timed = view.filter(F.col("normalized_timestamp").isNotNull())
    counts = _activity(timed, F.date_trunc("hour", "normalized_timestamp").alias("hour_start"))
    # One number per hour, dealt over the cluster: a stray time far off makes many hours.
    first, last = counts.agg(F.unix_timestamp(F.min("hour_start")), F.unix_timestamp(F.max("hour_start"))).first()
    numbers = view.sparkSession.range(first, last + 1, 3600) if first is not None else view.sparkSession.range(0)
    hours = numbers.select(F.timestamp_seconds("id").alias("hour_start"))
    filled = hours.join(counts, "hour_start", "left")
    return filled.select(
        "hour_start", F.coalesce("logs", F.lit(0)).alias("logs"), F.coalesce("anomalies", F.lit(0)).alias("anomalies")
    ).orderBy("hour_start")


def search_messages(view: DataFrame, pattern: str | None) -> DataFrame:
    """Messages with a match of a regular expression, ignoring case; no pattern is no filter."""
    return view.filter(F.coalesce(F.col("message"), F.lit("")).rlike(f"(?iu){pattern}")) if pattern else view


def record_page(view: DataFrame, limit: int = 200) -> DataFrame:
    """The first records by time; the explorer asks for 50 to 1,000."""
    return in_time_order(view).limit(limit).select(*PAGE_COLUMNS)


def log_page(scored: DataFrame, limit: int = 100, max_rows: int = 1000) -> DataFrame:
    """The first records by time, at least 1 and at most `max_rows`, with times as text."""
    return export_records(record_page(scored, min(max(int(limit), 1), max_rows)))


def model_counts(scored: DataFrame) -> DataFrame:
    """Flagged records per detector and by consensus."""
    return scored.agg(*[F.count_if(f"{name}_anomaly").alias(name) for name in TITLES])


def plot_sample(scored: DataFrame, score: str = "anomaly_score", color: str = "severity", size: int = PLOT_ROWS, seed: int = SEED) -> DataFrame:
    """The rows behind a score chart."""
    columns = dict.fromkeys(("event_id", "normalized_timestamp", score, color, *HOVER_COLUMNS))
    return sample_rows(scored.select(*columns), size, seed).drop("event_id")


def rates_by_model(evaluation: DataFrame) -> DataFrame:
    """The evaluation without the ensemble."""
    return evaluation.filter(F.col("model") != TITLES["ensemble"]).select("model", "anomaly_rate_pct")


def vote_histogram(scored: DataFrame) -> DataFrame:
    """Records per number of votes, 0 to 3, with 0 where there are none."""
    counts = scored.groupBy("anomaly_votes").agg(F.count("*").alias("records"))
    votes = scored.sparkSession.range(4).select(F.col("id").cast("int").alias("anomaly_votes"))
    return (
        votes.join(counts, "anomaly_votes", "left")
        .orderBy("anomaly_votes")
        .select(
            F.format_string("%d / 3", "anomaly_votes").alias("votes"), F.coalesce("records", F.lit(0)).alias("records")
        )
    )


def pairwise_agreement(scored: DataFrame) -> DataFrame:
    """Per pair of detectors, the share of rows both flag alike."""
    shares = scored.agg(
        *[
            F.bround(F.avg((F.col(f"{left}_anomaly") == F.col(f"{right}_anomaly")).cast("double")) * 100, 2).alias(title)
            for title, left, right in AGREEMENT_PAIRS
        ]
    )
    pairs = [F.struct(F.lit(title).alias("pair"), F.col(f"`{title}`").alias("agreement_pct")) for title, _, _ in AGREEMENT_PAIRS]
    return shares.select(F.inline(F.array(*pairs)))


def consensus_anomalies(scored: DataFrame, limit: int = CONSENSUS_ROWS) -> DataFrame:
    """The records most detectors agree on, highest ensemble score first."""
    flagged = scored.filter("ensemble_anomaly")
    return flagged.orderBy(F.desc("ensemble_score"), "normalized_timestamp", "event_id").limit(limit).select(*CONSENSUS_COLUMNS)


def incident_lookup(incidents: DataFrame, incident_id: str) -> DataFrame:
    """One incident by its id."""
    return incidents.filter(F.col("incident_id") == incident_id).select(
        "incident_id", "severity", "primary_component", "start_time", "end_time", "event_count"
    )


def incident_timeline(incidents: DataFrame) -> DataFrame:
    """One bar per incident."""
    return incidents.select(
        "start_time", "end_time", "incident_id", "severity", "primary_component", "event_count", "anomaly_count"
    )


def summary(scored: DataFrame, incidents: DataFrame) -> DataFrame:
    """Totals of records, anomalies, signals, incidents and components."""
    counted = incidents.agg(F.count("*").alias("n"))
    return scored.agg(
        F.count("*").alias("total_logs"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.count_if("is_signal").alias("signals"),
        F.count_distinct("component").alias("components"),
    ).withColumn("incidents", counted.scalar())


def incident_listing(incidents: DataFrame) -> DataFrame:
    """All incidents with times as text."""
    return export_records(incidents)
