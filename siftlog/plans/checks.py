"""One query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.functions import text
from siftlog.functions.metrics import discover_leaves, flatten_metrics, has_metric, metrics_text
from siftlog.operators import density, ensemble, evidence, incidents, isolation_forest, matrix
from siftlog.operators.autoencoder import fit_autoencoder
from siftlog.operators.features import BASE_FEATURES, add_base_features
from siftlog.plans import detection, event_logs, reports
from siftlog.plans.event_logs import event_logs as logs_of
from siftlog.plans.event_logs import kept, severity_signals, simple_incidents, simple_scored, table, version
from siftlog.session import stage_path
from siftlog.sources import jsonl, profile

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Times as wall-clock UTC, the same in every client."""
    times = [field.name for field in df.schema.fields if field.dataType.typeName() == "timestamp"]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in times})


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(build(spark, sf_dir))
        return build

    return register


def features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_base_features(logs_of(spark, sf_dir))


def signals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.signals_of(simple_scored(spark, sf_dir))


# --- Sources ---------------------------------------------------------------


def line_time() -> Column:
    time, kind = F.col("ts"), F.col("event_id") % 5
    return (
        F.when(kind == 0, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == 1, F.concat(F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit("+05:30")))
        .when(kind == 2, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(kind == 3, F.date_format(time, "yyyy-MM-dd"))
        .otherwise("no time at all")
    )


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with blank ones, bad ones, absent keys and null values among them."""
    number, escaped = F.col("event_id"), F.replace(F.expr(event_logs.MESSAGE), F.lit('"'), F.lit('\\"'))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f', "{name}": "'), value, F.lit('"'))

    record = F.concat(
        F.lit('{"event_id": "'),
        number.cast("string"),
        F.lit('"'),
        F.when(number % 7 == 0, "")
        .when(number % 11 == 0, ', "component": null')
        .otherwise(field("component", F.expr(event_logs.COMPONENT))),
        F.when(number % 13 == 0, "").otherwise(field("parsed_message_type", F.col("event_type"))),
        field("normalized_timestamp", line_time()),
        F.when(number % 17 == 0, "").otherwise(field("message", escaped)),
        F.lit(', "extracted_metrics": '),
        F.col("props"),
        F.when(number % 3 == 0, F.concat(F.lit(', "host": "h'), (number % 10).cast("string"), F.lit('"'))).otherwise(""),
        F.when(number % 4 == 0, F.concat(F.lit(', "trace_id": {"span": '), number.cast("string"), F.lit("}"))).otherwise(""),
        F.lit("}"),
    )
    line = (
        F.when(number % 101 == 0, "  ").when(number % 97 == 0, "{bad json").when(number % 89 == 0, "[1]").otherwise(record)
    )
    return table(spark, sf_dir, "events").select(line.alias("value"))


def written_lines(spark: SparkSession, sf_dir: str) -> str:
    path = stage_path(spark, "lines")
    json_lines(spark, sf_dir).write.text(path)
    return path


@query("s1_jsonl_scan")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = jsonl.scan_jsonl(spark, written_lines(spark, sf_dir), tolerant=True)
    return scanned.select(
        "event_id",
        "component",
        "message",
        "parsed_message_type",
        "extracted_metrics",
        F.try_variant_get(F.col(jsonl.OTHERS)["host"], "$", "string").alias("host"),
        F.to_json(F.col(jsonl.OTHERS)["trace_id"]).alias("trace_id"),
        F.col(jsonl.CORRUPT).alias("bad_line"),
    )


@query("s2_nonempty_check")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {name: table(spark, sf_dir, name) for name in ("events", "documents", "conversations", "pages", "orders")}
    sources["no events"] = sources["events"].filter("event_id < 0")
    return reduce(DataFrame.union, [jsonl.emptiness(df, name) for name, df in sources.items()])


@query("s3_required_columns")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The second source holds the records of plain events alone: no record of it has a component.
    lines = jsonl.read_lines(spark, written_lines(spark, sf_dir))
    sources = {"all": lines, "no component": lines.filter(~F.col("value").contains('"component": '))}
    found = [jsonl.field_counts(df).withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(DataFrame.union, found).withColumn("is_missing", F.col("records") == 0)


@query("s4_timestamp_parse")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "events").select("event_id", line_time().alias("text"))
    return texts.withColumn("micros", F.unix_micros(jsonl.parse_time(F.col("text"))))


@query("s5_null_defaults")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = logs_of(spark, sf_dir)
    number = F.col("event_id").cast("long")
    holes = logs.withColumns(
        {
            "message": F.when(number % 3 != 0, F.col("message")),
            "component": F.when(number % 4 != 0, F.col("component")),
            "parsed_message_type": F.when(number % 5 != 0, F.col("parsed_message_type")),
        }
    )
    return jsonl.canonical(holes).select("event_id", "message", "component", "parsed_message_type")


@query("s6_time_order")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.in_time_order(logs_of(spark, sf_dir)).select("event_id", "normalized_timestamp", "component")


def tallied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.tally(profile.read_lines(spark, written_lines(spark, sf_dir)))


@query("s7_line_counts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.line_counts(tallied(spark, sf_dir))


@query("s8_top_components")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(tallied(spark, sf_dir), "component")


@query("s8_top_message_types")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(tallied(spark, sf_dir), "parsed_message_type")


@query("s9_absent_fields")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.absent_fields(tallied(spark, sf_dir))


@query("s10_export")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "export")
    columns = ("event_id", "normalized_timestamp", "component", "message", "parsed_message_type")
    jsonl.write_jsonl(simple_scored(spark, sf_dir).select(*columns), path)
    return jsonl.scan_jsonl(spark, path).select(*columns)


@query("s11_source_glob")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "parts")
    logs = logs_of(spark, sf_dir).drop("value")
    odd = F.col("event_id").cast("long") % 2 == 1
    jsonl.write_jsonl(logs.filter(odd), f"{path}/odd")
    jsonl.write_jsonl(logs.filter(~odd), f"{path}/even")
    return jsonl.load_logs(spark, f"{path}/*").groupBy("parsed_message_type").agg(F.count("*").alias("records"))


# --- Features --------------------------------------------------------------


def feature_query(name: str, *columns: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: features_of(spark, sf_dir).select("event_id", *columns)


feature_query("f1_severity", "severity", "severity_score")
feature_query("f2_message_length", "message_length")
feature_query("f3_word_count", "word_count")
feature_query("f5_hour_minute", "hour", "minute")
feature_query("f6_second", "second")


@query("f2_document_length")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.message_length(F.col("text")).alias("message_length"))


def metric_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with nested, mixed, boolean, empty and absent metrics."""
    number = F.col("event_id")
    whole = F.concat(
        F.lit('{"z": '),
        number.cast("string"),
        F.lit(', "io": {"read": '),
        F.col("user_id").cast("string"),
        F.lit('.5, "deep": {"x": '),
        (number % 4).cast("string"),
        F.lit('}}, "ok": '),
        F.when(number % 2 == 0, "true").otherwise("false"),
        F.lit(', "mixed": '),
        F.when(number % 3 == 0, '"text"').otherwise("1"),
        F.lit(', "name": "'),
        F.col("event_type"),
        F.lit('", "a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 6}'),
    )
    metrics = F.when(number % 19 == 0, "{}").when(number % 23 != 0, whole)
    return table(spark, sf_dir, "events").select(
        number.cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("normalized_timestamp"),
        metrics.alias("extracted_metrics"),
    )


@query("f4_has_metric")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = metric_logs(spark, sf_dir)
    return logs.select("event_id", has_metric(metrics_text(logs)).alias("has_metric"))


@query("f7_metric_columns")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = metric_logs(spark, sf_dir)
    flat = flatten_metrics(logs, discover_leaves(logs))
    return flat.select(
        "event_id",
        "metric_z",
        F.col("`metric_io.read`").alias("metric_io_read"),
        F.col("`metric_io.deep.x`").alias("metric_io_deep_x"),
        "metric_name",
        "metric_mixed",
    )


@query("f8_feature_choice")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = matrix.choose_features(metric_logs(spark, sf_dir)).names
    return spark.createDataFrame([(name, i + 1) for i, name in enumerate(names)], "feature string, position long")


@query("f9_clean_matrix")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 5
    value = (
        F.when(kind == 0, F.lit(None))
        .when(kind == 1, F.lit(float("nan")))
        .when(kind == 2, F.lit(float("inf")))
        .when(kind == 3, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    holes = table(spark, sf_dir, "events").select("event_id", value.alias("value"))
    return holes.select(F.col("event_id"), matrix.matrix(["value"])[0].alias("cleaned"))


@query("f10_standardised")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = features_of(spark, sf_dir).withColumn("flat", F.lit(7.5))
    scaling = matrix.fit_scaling(features, (*BASE_FEATURES, "flat"))
    scaled = features.select("event_id", scaling.scaled().alias("v"))
    return scaled.select("event_id", *[F.round(F.col("v")[i], 6).alias(name) for i, name in enumerate(scaling.names)])


@query("f11_sample")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.sample_rows(logs_of(spark, sf_dir).select("event_id"), 5_000)


# --- Detectors -------------------------------------------------------------


def fitting_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detectors are fitted on: the standardised features of all log records."""

    def build() -> DataFrame:
        logs = logs_of(spark, sf_dir).drop("value")
        choice = matrix.choose_features(logs)
        features = flatten_metrics(add_base_features(logs), list(choice.leaves))
        scaling = matrix.fit_scaling(features, choice.names)
        return features.select("event_id", scaling.scaled().alias("features"))

    return kept(spark, sf_dir, "points", build)


_detections: dict[tuple, detection.Detection] = {}


def detected(spark: SparkSession, sf_dir: str) -> detection.Detection:
    """All three detectors, fitted and applied to all records; once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, version(spark, sf_dir))
    if key not in _detections:
        _detections[key] = detection.detect(logs_of(spark, sf_dir).drop("value"))
    return _detections[key]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), F.col("label")
    )


def density_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records, clustered."""
    return kept(spark, sf_dir, "density-members", lambda: density.cluster_all(fitting_points(spark, sf_dir), keep=("event_id",)))


def score_bounds(scored: DataFrame, inside: Column) -> DataFrame:
    """Rows, records and scores inside their bounds."""
    return scored.agg(
        F.count("*").alias("rows"), F.count_distinct("event_id").alias("records"), F.count_if(inside).alias("inside")
    )


@query("a1_isolation_forest_fit")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation_forest.grow_trees(fitting_points(spark, sf_dir))


@query("a1_tree_rows")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = isolation_forest.grow_trees(fitting_points(spark, sf_dir))
    return nodes.groupBy("tree").agg(
        F.max("size").cast("long").alias("root_rows"), F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("leaf_rows")
    )


@query("a2_isolation_forest_score")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).scored.select("event_id", "isolation_forest_score")


@query("a2_score_bounds")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("isolation_forest_score")
    return score_bounds(detected(spark, sf_dir).scored, (score > -0.5) & (score < 0.5))


@query("a3_autoencoder_fit")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = fit_autoencoder(fitting_points(spark, sf_dir)).losses
    return spark.createDataFrame(list(enumerate(losses, 1)), "epoch int, loss double")


@query("a3_training")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = fit_autoencoder(fitting_points(spark, sf_dir)).losses
    return spark.createDataFrame([(len(losses), losses[-1] < losses[0])], "epochs int, improved boolean")


@query("a4_autoencoder_score")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).scored.select("event_id", "autoencoder_score")


@query("a4_score_bounds")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_bounds(detected(spark, sf_dir).scored, F.col("autoencoder_score") >= 0)


@query("a5_norms")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All components only turn the space, so every vector keeps its length.
    points = vectors(spark, sf_dir)
    turned = density.assign_projection(points, density.fit_pca(points, matrix.vector_width(points)))
    squares = F.aggregate("features", F.lit(0.0), lambda total, value: total + value * value)
    return turned.select("vec_id", F.round(F.sqrt(squares), 6).alias("norm"))


@query("a5_pca")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = vectors(spark, sf_dir)
    return density.assign_projection(points, density.fit_pca(points)).select("vec_id", "features")


@query("a6_core_distance")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.core_table(vectors(spark, sf_dir), "vec_id").select("vec_id", F.round("core", 6).alias("core"))


@query("a6_density_clusters")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_members(spark, sf_dir).select("event_id", "label")


@query("a6_cluster_sizes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = density_members(spark, sf_dir).groupBy("label").agg(F.count("*").alias("rows"))
    clusters = F.col("label") >= 0
    return sizes.agg(
        F.sum("rows").alias("rows"),
        F.coalesce(F.min(F.when(clusters, F.col("rows"))) >= density.MIN_CLUSTER, F.lit(True)).alias("large_enough"),
        (F.coalesce(F.max(F.when(clusters, F.col("label"))), F.lit(-1)) + 1 == F.count_if(clusters)).alias("consecutive"),
    )


@query("a7_centroids")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = density.centroids(vectors(spark, sf_dir))
    parts = means.select("label", F.posexplode("centroid").alias("pos", "mean"))
    return parts.select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query("a8_nearest_centroid")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = vectors(spark, sf_dir)
    found = density.assign_nearest(points, density.load_centroids(density.centroids(points)))
    return found.select("vec_id", F.round("distance", 6).alias("distance"), F.col("nearest_label").cast("int"))


@query("a19_silhouette")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = density.silhouette_rows(vectors(spark, sf_dir), "vec_id")
    return found.select("vec_id", F.col("label").cast("int"), F.round("silhouette", 6).alias("silhouette"))


@query("a10_noise_threshold")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = simple_scored(spark, sf_dir)
    noise = scored.agg(F.count_if(F.col("value") > 400) / F.count("*")).first()[0]
    percentile = ensemble.density_percentile(noise)
    flagged, threshold = ensemble.flag_outliers(scored, "hdbscan_score", "flag", percentile)
    return flagged.agg(
        F.round(F.lit(percentile), 6).alias("percentile"),
        F.round(F.lit(threshold), 6).alias("threshold"),
        F.count_if("flag").alias("flagged"),
    )


@query("a11_no_cluster")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = vectors(spark, sf_dir).withColumn("event_id", F.col("vec_id").cast("string"))
    # No 300 of 200 points can form a cluster.
    model = density.fit_density(matrix.sample_rows(points.select("event_id", "features"), 200), min_cluster=300)
    scored = density.add_distance(points, model, "hdbscan_score")
    flagged, _ = ensemble.flag_outliers(scored, "hdbscan_score", "hdbscan_anomaly")
    return flagged.select("vec_id", "hdbscan_score", "hdbscan_anomaly", F.lit(model.clusters).cast("long").alias("clusters"))


def scored_query(name: str, *columns: str | Column) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(simple_scored(spark, sf_dir).select("event_id", *columns))


def rounded(name: str) -> Column:
    return F.round(name, 9).alias(name)


RANKS = [f"{name}_percentile" for name in ensemble.DETECTORS]


@query("a9_threshold_flag")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_scored(spark, sf_dir).select("event_id", *[f"{name}_anomaly" for name in ensemble.DETECTORS])


@query("a12_percentile_rank")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_scored(spark, sf_dir).select("event_id", *[rounded(name) for name in RANKS])


@query("a15_ensemble_score")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_scored(spark, sf_dir).select("event_id", rounded("ensemble_score"))


scored_query("a13_votes", "anomaly_votes")
scored_query("a14_consensus", "ensemble_anomaly")
scored_query("a16_primary_signal", "anomaly_score", "is_anomaly")
scored_query("a17_incident_signal", "is_signal")


@query("a18_evaluation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.evaluation(simple_scored(spark, sf_dir))


@query("a18_detector_evaluation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).evaluation


@query("a20_model_record")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).meta


@query("a20_fit_sizes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("primary_model", "feature_count", "training_sample", "hdbscan_sample", "ensemble_rule")
    return detected(spark, sf_dir).meta.select(*columns)


@query("a21_accessors")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = detected(spark, sf_dir)
    pairs = [(k, str(v)) for k, v in detection.model_metadata(result).items()]
    pairs += [(record["model"], str(record["anomalies"])) for record in detection.evaluation_metrics(result)]
    return spark.createDataFrame(pairs, "name string, value string")


@query("a21_flag_counts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = detected(spark, sf_dir)
    flags = ("isolation_forest_anomaly", "autoencoder_anomaly", "hdbscan_anomaly", "ensemble_anomaly")
    counted = result.scored.agg(*[F.count_if(name) for name in flags]).first()
    reported = [record["anomalies"] for record in detection.evaluation_metrics(result)]
    return spark.createDataFrame([(sorted(reported) == sorted(counted), len(reported))], "agree boolean, models int")


@query("detected_event_counts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = detected(spark, sf_dir).scored
    signals = scored.agg(F.count_if("is_signal").alias("signals"))
    found = incidents.build_incidents(scored).agg(F.sum("event_count").alias("events"))
    return found.join(signals, F.col("events") == F.col("signals")).select((F.col("events") > 0).alias("every_signal_once"))


@query("detected_records")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).scored


@query("detected_incidents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.build_incidents(detected(spark, sf_dir).scored)


# --- Incidents -------------------------------------------------------------


@query("i1_signals")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals_of(spark, sf_dir).select("event_id", "component", "severity_score", "is_anomaly")


def signal_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.boundaries(incidents.instants_of(signals_of(spark, sf_dir)))


@query("i2_time_gap")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_boundaries(spark, sf_dir).select("normalized_timestamp", "gap_minutes")


@query("i3_component_change")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_boundaries(spark, sf_dir).select("normalized_timestamp", "changed")


@query("i4_sessions")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.assign_sessions(signals_of(spark, sf_dir)).select("event_id", "session")


@query("i4_sessions_30_minutes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.assign_sessions(signals_of(spark, sf_dir), 30.0).select("event_id", "session")


@query("i5_incidents_by_severity")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.build_incidents(severity_signals(spark, sf_dir))


@query("i5_incidents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.build_incidents(simple_scored(spark, sf_dir))


@query("i5_incidents_30_minutes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.build_incidents(simple_scored(spark, sf_dir), 30.0)


def incident_query(name: str, *columns: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(simple_incidents(spark, sf_dir).select("incident_id", *columns))


incident_query("i6_modal_component", "primary_component")
incident_query("i7_component_list", "affected_components")
incident_query("i8_severity_label", "severity")
incident_query("i9_incident_id", "start_time")


@query("i10_list_order")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.in_list_order(simple_incidents(spark, sf_dir))


@query("i11_no_signal")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.build_incidents(simple_scored(spark, sf_dir).withColumn("is_signal", F.lit(False)))


def incident_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return evidence.evidence(simple_scored(spark, sf_dir), simple_incidents(spark, sf_dir))

    return kept(spark, sf_dir, "evidence", build)


@query("i12_evidence")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.evidence(simple_scored(spark, sf_dir), simple_incidents(spark, sf_dir))
    return found.select("incident_id", "place", "event_id", "normalized_timestamp", "component", "message")


@query("i12_incident_evidence")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.incident_evidence(simple_scored(spark, sf_dir), simple_incidents(spark, sf_dir), "INC-00007")


@query("i13_evidence_figures")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.evidence_figures(incident_evidence(spark, sf_dir))
    texts = {name: evidence.value_counts_text(F.col(name)) for name in ("top_components", "top_types")}
    return found.withColumns(texts)


@query("i14_summaries")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.summaries(simple_incidents(spark, sf_dir), incident_evidence(spark, sf_dir))


@query("i15_prompts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.prompts(simple_incidents(spark, sf_dir), incident_evidence(spark, sf_dir))


# --- Reports ---------------------------------------------------------------


def report(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(build(simple_scored(spark, sf_dir)))


report("q1_components", lambda df: reports.facet_values(df, "component"))
report("q1_message_types", lambda df: reports.facet_values(df, "parsed_message_type"))
report("q2_component_filter", lambda df: reports.filter_records(df, components=["svc-1", "unknown"]).select(*reports.PAGE_COLUMNS))
report("q3_type_filter", lambda df: reports.filter_records(df, message_types=["error", "click"]).select(*reports.PAGE_COLUMNS))
report("q4_min_severity", lambda df: reports.filter_records(df, min_severity="Medium").select(*reports.PAGE_COLUMNS))
report("q6_component_activity", reports.component_activity)
report("q7_hourly_activity", reports.hourly_activity)
report("q7_component_hours", lambda df: reports.hourly_activity(reports.filter_records(df, components=["unknown"])))
report("q8_most_affected", reports.most_affected)
report("q9_search", lambda df: reports.search_messages(df, "USER 1[0-4]$|timeout").select(*reports.PAGE_COLUMNS))
report("q10_record_page", reports.record_page)
report("q11_model_counts", reports.model_counts)
report("q12_plot_sample", reports.plot_sample)
report("q13_rates_by_model", lambda df: reports.rates_by_model(ensemble.evaluation(df)))
report("q14_vote_histogram", reports.vote_histogram)
report("q15_agreement", reports.pairwise_agreement)
report("q16_consensus_anomalies", lambda df: reports.consensus_anomalies(df).withColumn("ensemble_score", rounded("ensemble_score")))
report("q21_log_page", lambda df: reports.log_page(df, 5_000))


@query("q5_overview")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = reports.filter_records(simple_scored(spark, sf_dir), components=["svc-1", "svc-2", "unknown"], min_severity="Low")
    return reports.overview(view, simple_incidents(spark, sf_dir))


@query("q17_incident_lookup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.incident_lookup(simple_incidents(spark, sf_dir), "INC-00007")


@query("q18_timeline")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.incident_timeline(simple_incidents(spark, sf_dir))


@query("q19_summary")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary(simple_scored(spark, sf_dir), simple_incidents(spark, sf_dir))


@query("q20_incident_listing")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.incident_listing(simple_incidents(spark, sf_dir))
