import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftlog.operators import autoencoder, density, ensemble, isolation_forest
from siftlog.plans import detection

CENTRES = np.array([[0.0, 0, 0, 0], [8, 8, 0, 0], [0, 8, 8, 8]])


def blobs(seed=3, size=300, outliers=12):
    rng = np.random.default_rng(seed)
    points = [centre + rng.normal(size=(size, 4)) for centre in CENTRES]
    far = rng.uniform(25, 40, size=(outliers, 4)) * rng.choice([-1, 1], size=(outliers, 4))
    return np.vstack([*points, far])


def frame_of(spark, points):
    table = pd.DataFrame({"event_id": [f"{i:05d}" for i in range(len(points))], "features": list(points)})
    return spark.createDataFrame(table, "event_id string, features array<double>")


@pytest.fixture(scope="module")
def planted(spark):
    points = blobs()
    return points, frame_of(spark, points).cache()


def walk(nodes, row):
    """Path length of one row in one tree, node by node."""
    node = 0
    while nodes[node].feature >= 0:
        node = 2 * node + (1 if row[nodes[node].feature] <= nodes[node].threshold else 2)
    return nodes[node].depth + isolation_forest.expected_path(nodes[node].size)


def test_forest_scores_match_walking_the_trees(spark, planted):
    points, frame = planted
    nodes = isolation_forest.grow_trees(frame, trees=20, tree_rows=64)
    forest = isolation_forest.load_forest(nodes)
    trees = {}
    for row in nodes.collect():
        trees.setdefault(row.tree, {})[row.node] = row
    assert len(trees) == 20 and all(tree[0].size == 64 for tree in trees.values())
    some = points[::50]
    expected = [
        2 ** (-np.mean([walk(tree, row) for tree in trees.values()]) / isolation_forest.expected_path(64)) - 0.5 for row in some
    ]
    assert forest.scores(some) == pytest.approx(expected)


def test_forest_finds_planted_outliers(spark, planted):
    points, frame = planted
    scores = isolation_forest.fit_forest(frame).scores(points)
    assert ((scores > -0.5) & (scores < 0.5)).all()
    assert set(np.argsort(-scores)[:12]) == set(range(900, 912))


def test_forest_does_not_depend_on_the_layout(spark, planted):
    points, frame = planted
    one = isolation_forest.fit_forest(frame, trees=10).scores(points)
    other = isolation_forest.fit_forest(frame.repartition(9, F.rand(1)), trees=10).scores(points)
    assert (one == other).all()


def test_forest_of_identical_rows(spark):
    frame = frame_of(spark, np.zeros((30, 3)))
    scores = isolation_forest.fit_forest(frame, trees=5).scores(np.zeros((4, 3)))
    assert len(set(scores)) == 1


def test_forest_draws_in_compiled_code(spark, planted):
    """No expression is walked for each tree and row; the rows are those with the smallest draws."""
    _, frame = planted
    nodes = isolation_forest.grow_trees(frame, trees=5, tree_rows=64)
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "lambda" not in plan
    sizes = nodes.filter("node = 0").select("tree", "size").collect()
    assert sorted(map(tuple, sizes)) == [(tree, 64) for tree in range(5)]


def test_layer_sizes():
    assert autoencoder.layer_sizes(1) == [1, 16, 8, 16, 1]
    assert autoencoder.layer_sizes(7) == [7, 28, 14, 28, 7]
    assert autoencoder.layer_sizes(40) == [40, 64, 32, 64, 40]


def test_gradient_matches_differences():
    sizes = [3, 5, 4, 5, 3]
    rng = np.random.default_rng(0)
    weights = autoencoder._initial(sizes, 1)
    batch = rng.normal(size=(10, 3))
    _, gradient = autoencoder._gradient(batch, weights, sizes)
    for place in rng.choice(len(weights), 15, replace=False):
        step = np.zeros_like(weights)
        step[place] = 1e-6
        above = autoencoder._gradient(batch, weights + step, sizes)[0]
        below = autoencoder._gradient(batch, weights - step, sizes)[0]
        assert gradient[place] == pytest.approx((above - below) / 2e-6, abs=1e-6)


def test_autoencoder_learns_and_is_repeatable(spark, planted):
    points, frame = planted
    model = autoencoder.fit_autoencoder(frame)
    assert len(model.losses) == autoencoder.EPOCHS and model.losses[-1] < model.losses[0]
    scores = model.scores(points)
    assert scores[900:].min() > np.quantile(scores[:900], 0.985)
    again = autoencoder.fit_autoencoder(frame.repartition(5, F.rand(2)))
    assert (again.scores(points) == scores).all()


def test_few_tasks_train_many_shards(spark, planted, monkeypatch):
    _, frame = planted
    tasks, mean = [], autoencoder._mean_state

    def watched(parts):
        tasks.append(parts.rdd.getNumPartitions())
        return mean(parts)

    monkeypatch.setattr(autoencoder, "_mean_state", watched)
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    # A split for every file.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        autoencoder.fit_autoencoder(frame, epochs=2, shard_rows=20)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert tasks == [autoencoder.EPOCH_TASKS * spark.sparkContext.defaultParallelism] * 2


def test_autoencoder_gets_more_shards_with_more_rows(spark, planted):
    points, frame = planted
    model = autoencoder.fit_autoencoder(frame, epochs=4, shard_rows=100)
    assert model.losses[-1] < model.losses[0]
    again = autoencoder.fit_autoencoder(frame.repartition(5, F.rand(2)), epochs=4, shard_rows=100)
    assert (again.scores(points) == model.scores(points)).all()


def prim(points, core):
    """Total weight of the minimum spanning tree of mutual reachability."""
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    reach = np.maximum(distance, np.maximum(core[:, None], core[None]))
    best, inside, total = reach[0].copy(), np.zeros(len(points), bool), 0.0
    inside[0] = True
    for _ in range(len(points) - 1):
        best[inside] = np.inf
        node = best.argmin()
        total += best[node]
        inside[node] = True
        best = np.minimum(best, reach[node])
    return total


@pytest.mark.parametrize("kind", ["blobs", "grid", "copies"])
def test_spanning_tree(spark, kind):
    if kind == "blobs":
        points = blobs(size=80)
    elif kind == "grid":
        points = np.array([(x, y) for x in range(15) for y in range(15)], dtype=float)
    else:
        points = np.repeat(np.random.default_rng(1).normal(size=(12, 3)), 20, axis=0)
    core = np.sort(np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)), axis=1)[:, 9]
    found = density.core_distances(spark, points).toPandas().sort_values("id")["core"].to_numpy()
    assert found == pytest.approx(core, abs=1e-9)
    edges = density.spanning_tree(spark, points)
    assert len(edges) == len(points) - 1
    assert sum(edge[0] for edge in edges) == pytest.approx(prim(points, core))


def test_density_finds_the_blobs(spark, planted):
    points, frame = planted
    members = density.cluster_sample(frame).toPandas().sort_values("event_id")
    labels = members["label"].to_numpy()
    for blob in range(3):
        own = labels[blob * 300 : blob * 300 + 300]
        own = own[own >= 0]
        assert len(own) > 240 and len(set(own)) == 1
    assert len({*labels[:900]} - {-1}) == 3
    assert (labels[900:] == -1).all()


def test_one_dense_group_is_no_cluster(spark):
    points = np.random.default_rng(2).normal(size=(60, 2))
    assert (density.label_points(density.spanning_tree(spark, points), len(points)) == -1).all()
    assert (density.label_points([], 1) == -1).all()


def test_copies_form_clusters(spark):
    points = np.repeat(np.array([[0.0, 0], [5, 5], [9, 0]]), 60, axis=0)
    labels = density.label_points(density.spanning_tree(spark, points), len(points))
    assert [len(set(labels[i : i + 60])) for i in (0, 60, 120)] == [1, 1, 1] and len(set(labels)) == 3


def test_nearest_centroid(spark, planted):
    points, frame = planted
    labelled = frame.withColumn("label", (F.col("event_id").cast("int") / 300).cast("int").cast("long")).filter("label < 3")
    centres = density.load_centroids(density.centroids(labelled))
    expected = np.array([points[i * 300 : i * 300 + 300].mean(axis=0) for i in range(3)])
    assert centres.points == pytest.approx(expected)
    found = density.assign_nearest(frame, centres).toPandas().sort_values("event_id")
    distance = np.sqrt(((points[:, None] - expected[None]) ** 2).sum(-1))
    assert found["distance"].to_numpy() == pytest.approx(distance.min(axis=1))
    assert (found["nearest_label"].to_numpy() == distance.argmin(axis=1)).all()
    tied = density.Centroids(np.array([4, 7]), np.array([[1.0], [-1.0]]))
    assert tied.nearest(np.array([[0.0]]))[1][0] == 4


def test_silhouette(spark, planted):
    points, frame = planted
    labelled = frame.withColumn("label", F.least((F.col("event_id").cast("int") / 300).cast("int"), F.lit(2)).cast("long"))
    labelled = labelled.withColumn("label", F.when(F.col("event_id") == "00000", -1).otherwise(F.col("label")))
    values = points[1:]
    own = np.minimum(np.arange(1, len(points)) // 300, 2)
    distance = np.sqrt(((values[:, None] - values[None]) ** 2).sum(-1))
    expected = []
    for i in range(len(values)):
        means = [distance[i][own == k].sum() / ((own == k).sum() - (k == own[i])) for k in range(3)]
        a, b = means[own[i]], min(m for k, m in enumerate(means) if k != own[i])
        expected.append((b - a) / max(a, b))
    assert density.silhouette_score(labelled, "event_id") == pytest.approx(np.mean(expected))
    assert density.silhouette_score(labelled.withColumn("label", F.lit(1)), "event_id") is None
    assert density.silhouette_score(labelled.limit(15), "event_id") is None


def test_projection_keeps_distances(spark, planted):
    points, frame = planted
    directions = density.fit_pca(frame)
    assert directions.shape == (4, 4)
    reduced = density.assign_projection(frame, directions).toPandas().sort_values("event_id")
    found = np.stack(reduced["features"].to_numpy())
    assert np.linalg.norm(found[5] - found[700]) == pytest.approx(np.linalg.norm(points[5] - points[700]))


def scored_frame(spark, rows):
    schema = "row long, severity_score int, isolation_forest_score double, autoencoder_score double, hdbscan_score double"
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)


def test_votes_and_flags(spark):
    rng = np.random.default_rng(4)
    data = [(int(rng.integers(0, 4)), *map(float, rng.integers(0, 200, 3))) for _ in range(500)]
    combined = ensemble.combine(scored_frame(spark, data), "row")
    found = combined.scored.toPandas().sort_values("row")
    table = pd.DataFrame(data, columns=["severity_score", *[f"{n}_score" for n in ensemble.DETECTORS]])
    votes = 0
    ranks = 0
    for name in ensemble.DETECTORS:
        score = table[f"{name}_score"]
        threshold = np.quantile(score, 0.985)
        assert combined.thresholds[name] == pytest.approx(threshold)
        assert (found[f"{name}_anomaly"].to_numpy() == (score >= threshold).to_numpy()).all()
        votes = votes + (score >= threshold).astype(int)
        ranks = ranks + score.rank(pct=True)
    assert (found["anomaly_votes"].to_numpy() == votes.to_numpy()).all()
    assert found["ensemble_score"].to_numpy() == pytest.approx((ranks / 3).to_numpy())
    assert (found["is_anomaly"] == found["autoencoder_anomaly"]).all()
    assert (found["is_signal"] == (found["is_anomaly"] | (found["severity_score"] >= 2))).all()
    first = ensemble.evaluation(combined.scored, combined.medians).collect()
    assert first == ensemble.evaluation(combined.scored).collect()
    row = first[1].asDict()
    rule = table["severity_score"] >= 2
    flags = found["autoencoder_anomaly"].to_numpy()
    assert row["anomalies"] == flags.sum()
    assert row["rule_alignment_pct"] == pytest.approx((flags & rule).sum() / rule.sum() * 100, abs=0.006)
    assert row["median_score"] == table["autoencoder_score"].median()


def test_constant_scores_flag_everything(spark):
    combined = ensemble.combine(scored_frame(spark, [(0, 1.0, float(i), 1.0) for i in range(100)]), "row")
    counts = combined.scored.agg(F.count_if("isolation_forest_anomaly"), F.count_if("ensemble_anomaly")).first()
    assert tuple(counts) == (100, 100)
    alone = ensemble.evaluation(combined.scored).first()
    assert alone["rule_alignment_pct"] is None


def test_density_percentile():
    assert ensemble.density_percentile(0.0) == 100.0
    assert ensemble.density_percentile(0.01) == 99.0
    assert ensemble.density_percentile(0.4) == 98.5


def test_pipeline(spark, tmp_path, lines_file):
    import json

    rng = np.random.default_rng(8)
    lines = []
    for i in range(1_200):
        odd = i % 200 == 7
        lines.append(
            json.dumps(
                {
                    "event_id": f"e{i:05d}",
                    "normalized_timestamp": f"2017-01-01T{i // 60:02d}:{i % 60:02d}:{rng.integers(0, 60):02d}Z",
                    "component": f"c{i % 3}",
                    "message": "fatal " * 60 if odd else f"request {i} served",
                    "parsed_message_type": "x",
                    "extracted_metrics": {"ms": 9_000.0 if odd else float(rng.normal(20, 3)), "io": {"n": int(rng.integers(0, 9))}},
                }
            )
        )
    path = lines_file(*lines)
    result = detection.analyse(spark, path)
    scored = result.detection.scored
    assert scored.count() == 1_200
    flagged = {row.event_id for row in scored.filter("isolation_forest_anomaly").select("event_id").collect()}
    assert {f"e{i:05d}" for i in range(1_200) if i % 200 == 7} <= flagged
    meta = detection.model_metadata(result.detection)
    assert meta["features"][-2:] == ["metric_io.n", "metric_ms"] or meta["features"][-2:] == ["metric_ms", "metric_io.n"]
    assert meta["training_sample"] == 1_200 and meta["primary_model"] == "Autoencoder"
    assert [row["model"] for row in detection.evaluation_metrics(result.detection)] == list(ensemble.TITLES.values())
    assert detection.evaluation_metrics(None) == [] and detection.model_metadata(None) == {}
    assert result.incidents.count() >= 1
    again = detection.analyse(spark, path).detection.scored
    columns = ["event_id", "isolation_forest_score", "autoencoder_score", "hdbscan_score", "ensemble_score"]
    assert scored.select(*columns).exceptAll(again.select(*columns)).count() == 0
    assert math.isfinite(meta["autoencoder_threshold"])
