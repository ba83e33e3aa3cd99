"""Flags, percentile ranks, votes and the comparison of the detectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.operators.ordering import add_percentile_ranks, column_quantiles, exact_quantiles, place

# Detector names, their titles, and the rules of the vote.
TITLES = {
    "isolation_forest": "Isolation Forest",
    "autoencoder": "Autoencoder",
    "hdbscan": "HDBSCAN",
    "ensemble": "Ensemble (2/3)",
}
DETECTORS = ("isolation_forest", "autoencoder", "hdbscan")
PRIMARY = "autoencoder"
PERCENTILE = 98.5
VOTES_NEEDED = 2
SIGNAL_SEVERITY = 2


def density_percentile(noise_rate: float, floor: float = PERCENTILE) -> float:
    """The share of rows to leave unflagged, raised where the sample holds little noise."""
    return max(floor, 100.0 * (1.0 - noise_rate))


@dataclass(frozen=True)
class Combined:
    scored: DataFrame
    thresholds: dict[str, float]
    medians: dict[str, float]


def flag_outliers(df: DataFrame, score: str, flag: str, percentile: float = PERCENTILE) -> tuple[DataFrame, float]:
    """Flag the rows at or above a percentile of the score; equal scores are flagged alike."""
    threshold = column_quantiles(df, {score: [percentile / 100.0]})[score][0]
    return df.withColumn(flag, F.col(score) >= F.lit(threshold)), threshold


def combine(df: DataFrame, row_key: str, percentiles: dict[str, float] | None = None, primary: str = PRIMARY) -> Combined:
    """Add flags, votes, percentiles, the ensemble score and the incident signal.

    `df` holds the three scores, `severity_score` and a unique `row_key`; it is
    read several times, so it should be a table.
    """
    scores = {name: f"{name}_score" for name in DETECTORS}
    placed = place(df, list(scores.values()), row_key)
    shares = {name: (percentiles or {}).get(name, PERCENTILE) / 100.0 for name in DETECTORS}
    found = exact_quantiles(placed, {score: [shares[name], 0.5] for name, score in scores.items()})
    thresholds = {name: found[score][0] for name, score in scores.items()}
    medians = {name: found[score][1] for name, score in scores.items()}
    out = add_percentile_ranks(df, row_key, {score: f"{name}_percentile" for name, score in scores.items()}, placed)
    for name in DETECTORS:
        out = out.withColumn(f"{name}_anomaly", F.col(f"{name}_score") >= F.lit(thresholds[name]))
    votes = sum((F.col(f"{name}_anomaly").cast("int") for name in DETECTORS), F.lit(0))
    mean_rank = sum((F.col(f"{name}_percentile") for name in DETECTORS), F.lit(0.0)) / F.lit(3.0)
    out = out.withColumns(
        {
            "anomaly_score": F.col(f"{primary}_score"),
            "is_anomaly": F.col(f"{primary}_anomaly"),
            "anomaly_votes": votes,
            "ensemble_score": mean_rank,
        }
    ).withColumns(
        {
            "ensemble_anomaly": F.col("anomaly_votes") >= VOTES_NEEDED,
            "is_signal": F.col("is_anomaly") | (F.col("severity_score") >= SIGNAL_SEVERITY),
        }
    )
    return Combined(out, thresholds, medians)


def evaluation(scored: DataFrame, known_medians: dict[str, float] | None = None) -> DataFrame:
    """Per detector: flags, rate, share of rule-positive rows flagged, median score."""
    rule = F.col("severity_score") >= SIGNAL_SEVERITY
    names = list(TITLES)
    counts = scored.agg(
        F.count("*").alias("rows"),
        F.count_if(rule).alias("positive"),
        *[F.count_if(f"{name}_anomaly").alias(f"{name}_flags") for name in names],
        *[F.count_if(F.col(f"{name}_anomaly") & rule).alias(f"{name}_hits") for name in names],
    )
    medians = dict(known_medians or {})
    unknown = {f"{name}_score": [0.5] for name in names if name not in medians}
    medians |= {score.removesuffix("_score"): values[0] for score, values in column_quantiles(scored, unknown).items()}
    per_model = [
        F.struct(
            F.lit(TITLES[name]).alias("model"),
            F.col(f"{name}_flags").alias("anomalies"),
            F.bround(F.col(f"{name}_flags") / F.nullif("rows", F.lit(0)) * 100, 2).alias("anomaly_rate_pct"),
            F.bround(F.col(f"{name}_hits") / F.nullif("positive", F.lit(0)) * 100, 2).alias("rule_alignment_pct"),
            F.bround(F.lit(float(medians[name])), 4).alias("median_score"),
        )
        for name in names
    ]
    return counts.select(F.inline(F.array(*per_model)))
