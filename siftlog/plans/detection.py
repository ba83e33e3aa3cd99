"""The detection pipeline: fit on samples, score all rows, combine, evaluate."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.operators.autoencoder import Autoencoder, fit_autoencoder
from siftlog.operators.density import DensityModel, fit_density, list_matrix, model_distance
from siftlog.operators.ensemble import DETECTORS, PERCENTILE, combine, density_percentile, evaluation
from siftlog.operators.features import build_features
from siftlog.operators.incidents import build_incidents
from siftlog.operators.isolation_forest import Forest, fit_forest
from siftlog.operators.matrix import SEED, FeatureChoice, Scaling, choose_features, draw_samples, fit_scaling
from siftlog.session import stage
from siftlog.sources.jsonl import load_logs

# The rows that the density clustering works on unless asked for all, and the texts of the model record.
DENSITY_SAMPLE = 15_000
PRIMARY_TITLE = "Autoencoder"
RULE = "2 of 3 models"

ROW = "_row"
SCORE_SCHEMA = "isolation_forest_score double, autoencoder_score double, hdbscan_score double"


@dataclass(frozen=True)
class Detectors:
    """Everything a fit leaves behind; enough to score new data."""

    choice: FeatureChoice
    scaling: Scaling
    forest: Forest
    autoencoder: Autoencoder
    density: DensityModel
    model_rows: int
    density_rows: int


@dataclass(frozen=True)
class Detection:
    scored: DataFrame
    evaluation: DataFrame
    meta: DataFrame


def fit_detectors(
    features: DataFrame,
    choice: FeatureChoice,
    seed: int = SEED,
    model_sample: int | None = None,
    density_sample: int | None = DENSITY_SAMPLE,
) -> Detectors:
    """Scale over all rows and fit the detectors; `features` is read several times, so it should be a table.

    Forest and autoencoder are fitted on all rows, or on `model_sample` of them, the
    density clustering on `density_sample` rows, or on all of them if that is None.
    """
    scaling = fit_scaling(features, choice.names)
    points = features.select("event_id", scaling.scaled().alias("features"))
    draws = [(size, at) for size, at in ((density_sample, seed + 1), (model_sample, seed)) if size]
    drawn = [stage(sample, "sample") for sample in draw_samples(points, draws, rows=scaling.rows)] if draws else []
    shared = drawn[-1] if model_sample else stage(points, "points")
    dense = drawn[0] if density_sample else stage(points, "points") if model_sample else shared
    # The fits are many small jobs that leave cores idle; they run side by side.
    with ThreadPoolExecutor(3) as pool:
        forest = pool.submit(fit_forest, shared)
        autoencoder = pool.submit(fit_autoencoder, shared)
        density = pool.submit(fit_density, dense, whole=not density_sample)
        sizes = [min(size or scaling.rows, scaling.rows) for size in (model_sample, density_sample)]
        return Detectors(choice, scaling, forest.result(), autoencoder.result(), density.result(), *sizes)


def scores(models: Detectors, vector: Column) -> Column:
    """The three scores of a feature vector, in one pass through Python."""
    forest, autoencoder, density = models.forest, models.autoencoder, models.density
    centres, directions, clusters = density.centres, density.directions, density.clusters

    @F.arrow_udf(SCORE_SCHEMA)
    def score(vectors: pa.Array) -> pa.Array:
        values = list_matrix(vectors)
        distance = model_distance(directions, centres, clusters, values)
        columns = [forest.scores(values), autoencoder.scores(values), distance]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], [f"{name}_score" for name in DETECTORS])

    return score(vector)


def score_rows(features: DataFrame, models: Detectors) -> DataFrame:
    """The feature table with three scores and a row key, as a table."""
    scored = features.withColumn("_scores", scores(models, models.scaling.scaled()))
    return stage(scored.select("*", "_scores.*", F.monotonically_increasing_id().alias(ROW)).drop("_scores"), "scores")


def model_record(models: Detectors, thresholds: dict[str, float], spark: SparkSession) -> DataFrame:
    """One row that describes the fit."""
    record = (
        PRIMARY_TITLE,
        len(models.choice.names),
        list(models.choice.names),
        models.model_rows,
        models.density_rows,
        thresholds["isolation_forest"],
        thresholds["autoencoder"],
        models.density.clusters,
        models.density.noise_rate,
        thresholds["hdbscan"],
        models.density.silhouette,
        RULE,
    )
    return spark.createDataFrame(
        [record],
        "primary_model string, feature_count int, features array<string>, training_sample long, hdbscan_sample long, "
        "isolation_forest_threshold double, autoencoder_threshold double, clusters long, sample_noise_rate double, "
        "threshold double, silhouette_score double, ensemble_rule string",
    )


def detect(
    logs: DataFrame,
    models: Detectors | None = None,
    model_sample: int | None = None,
    density_sample: int | None = DENSITY_SAMPLE,
) -> Detection:
    """Score log records; with `models`, by an earlier fit."""
    choice = models.choice if models else choose_features(logs)
    # Scaling, fits and scores read the features from a table, so records are parsed once for all of them.
    features = stage(build_features(logs, list(choice.leaves)), "features")
    fitted = models or fit_detectors(features, choice, SEED, model_sample, density_sample)
    percentile = density_percentile(fitted.density.noise_rate) if fitted.density.clusters else PERCENTILE
    combined = combine(score_rows(features, fitted), ROW, {"hdbscan": percentile})
    scored = stage(combined.scored.drop(ROW), "scored")
    return Detection(scored, evaluation(scored, combined.medians), model_record(fitted, combined.thresholds, logs.sparkSession))


def evaluation_metrics(result: Detection | None) -> list[dict]:
    """The evaluation as records; none without a detection."""
    return [row.asDict() for row in result.evaluation.collect()] if result else []


def model_metadata(result: Detection | None) -> dict:
    """The model record; empty without a detection."""
    return result.meta.first().asDict() if result else {}


@dataclass(frozen=True)
class Analysis:
    detection: Detection
    incidents: DataFrame


def analyse(spark: SparkSession, path: str | None = None) -> Analysis:
    """From a JSONL source to scored records and incidents."""
    detection = detect(load_logs(spark, path))
    return Analysis(detection, build_incidents(detection.scored))
