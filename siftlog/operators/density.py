"""Density clustering and distances to its centroids.

Campello, Moulavi, Sander: Density-Based Clustering Based on Hierarchical
Density Estimates, PAKDD 2013. All rows of a table are clustered by `hierarchy`.
For a sample of bounded size there is a shorter way here: the spanning tree grows
by Boruvka rounds, each a Spark job over blocks of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.operators import cells, hierarchy
from siftlog.operators.matrix import SEED, sample_rows, vector_width
from siftlog.session import stage

# Clustering settings and sample bounds.
COMPONENTS = 8
MIN_CLUSTER = 50
MIN_SAMPLES = 10
# Rows whose silhouette is taken, each against all rows.
SILHOUETTE_ROWS = 5_000
SILHOUETTE_MIN_ROWS = 20
# The sample travels to every task; the reports never ask for more than 15,000 rows.
SAMPLE_LIMIT = 100_000
CENTROID_LIMIT = 10_000
CHUNK = 64
# Sums that a task of the silhouette holds before it hands them on.
HELD_SUMS = 1 << 22
# Points outside its group that a point keeps from a search of the spanning tree.
CANDIDATES = 16


def fit_pca(sample: DataFrame, components: int = COMPONENTS) -> np.ndarray:
    """Principal directions of `features`, one per column.

    Points are not centred: only distances between them are used.
    """
    vectors = sample.select(array_to_vector("features").alias("v"))
    shape = sample.agg(F.count("*"), F.max(F.size("features"))).first()
    count = min(components, shape[0], shape[1])
    return PCA(k=count, inputCol="v", outputCol="p").fit(vectors).pc.toArray()


def _collect_points(sample: DataFrame, vector: str, *others: str) -> tuple[np.ndarray, pd.DataFrame]:
    """The rows of a bounded sample, which every task of a fit needs whole."""
    table = sample.select(*others, vector).limit(SAMPLE_LIMIT + 1).toPandas()
    if len(table) > SAMPLE_LIMIT:
        raise ValueError(f"the sample has more than {SAMPLE_LIMIT} rows")
    points = np.stack(table[vector].to_numpy()).astype(float) if len(table) else np.zeros((0, 1))
    return points, table.drop(columns=vector)


def _blocks(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(0, rows, 1, min(2 * spark.sparkContext.defaultParallelism, max(1, rows // CHUNK)))


def _each_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for batch in batches:
        ids = batch["id"].to_numpy()
        for start in range(0, len(ids), CHUNK):
            yield ids[start : start + CHUNK]


class _Neighbourhood:
    """Squared distances from some points to all points, by one matrix product.

    The product loses the last digits, so it only ranks; the distances of the
    pairs that come out first are then computed anew.
    """

    def __init__(self, points: np.ndarray):
        self.points = points - points.mean(axis=0)
        norm = (self.points**2).sum(axis=1)[:, None]
        one = np.ones_like(norm)
        self.left = np.hstack([-2.0 * self.points, one, norm])
        self.right = np.ascontiguousarray(np.hstack([self.points, norm, one]).T)

    def squared(self, rows: np.ndarray | slice, columns: np.ndarray | slice = slice(None)) -> np.ndarray:
        return self.left[rows] @ self.right[:, columns]

    def exact(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[others]) ** 2).sum(axis=-1))


def core_distances(spark: SparkSession, points: np.ndarray, neighbours: int = MIN_SAMPLES) -> DataFrame:
    """Per point, the distance to its `neighbours`-th nearest point, itself included."""
    count = min(neighbours, len(points))
    shared = spark.sparkContext.broadcast(points)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = _Neighbourhood(shared.value)
        for rows in _each_chunk(batches):
            closest = np.argpartition(near.squared(rows), count - 1, axis=1)[:, :count]
            yield pd.DataFrame({"id": rows, "core": near.exact(rows[:, None], closest).max(axis=1)})

    return _blocks(spark, len(points)).mapInPandas(measure, "id long, core double")


def core_table(rows: DataFrame, key: str, vector: str = "features", neighbours: int = MIN_SAMPLES) -> DataFrame:
    """`key` and the core distance `core` of every row."""
    plain = rows.select(key, F.col(vector).alias("features"))
    width = vector_width(plain, "features")
    points = cells.distinct_points(plain, cells.WIDE_CELL_ROWS if width > cells.FEW_AXES else None)
    cores = points.select("id", "features").join(cells.core_distances(points, width, neighbours), "id")
    return plain.join(cores, "features").select(key, "core")


def _cheapest_outside(
    near: _Neighbourhood, core: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the `CANDIDATES` points that are cheapest to reach outside the range of its own group, and their weights.

    Rows of one group skip their range altogether. Where there are fewer such
    points, the rest have an infinite weight.
    """
    alone = starts[0] == starts[-1]
    columns = np.r_[0 : starts[0], ends[0] : len(core)] if alone else np.arange(len(core))
    reach = np.maximum(near.squared(rows, columns), core[columns] ** 2)
    if not alone:
        for row, (start, end) in enumerate(zip(starts, ends)):
            reach[row, start:end] = np.inf
    count = min(CANDIDATES, len(columns))
    places = np.argpartition(reach, count - 1, axis=1)[:, :count]
    others = columns[places]
    weights = np.maximum(np.maximum(near.exact(rows[:, None], others), core[others]), core[rows][:, None])
    weights[np.isinf(np.take_along_axis(reach, places, axis=1))] = np.inf
    padding = ((0, 0), (0, CANDIDATES - count))
    weights, others = np.pad(weights, padding, constant_values=np.inf), np.pad(others, padding)
    order = np.argsort(weights, axis=1, kind="stable")
    return np.take_along_axis(weights, order, axis=1), np.take_along_axis(others, order, axis=1)


def _search(spark: SparkSession, shared, groups: np.ndarray, wanted: np.ndarray) -> pd.DataFrame:
    """For the wanted points, the cheapest points outside their groups of connected points.

    Points are taken group by group, so that a group is one range: the larger it
    is, the less its points have to search.
    """
    order = np.argsort(groups, kind="stable")
    in_order = groups[order]
    asked = np.flatnonzero(wanted[order])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, core = shared.value
        near, core = _Neighbourhood(points[order]), core[order]
        for chunk in _each_chunk(batches):
            rows = asked[chunk]
            starts = np.searchsorted(in_order, in_order[rows])
            ends = np.searchsorted(in_order, in_order[rows], side="right")
            weights, others = _cheapest_outside(near, core, rows, starts, ends)
            yield pd.DataFrame({"point": order[rows], "weights": list(weights), "others": list(order[others])})

    return _blocks(spark, len(asked)).mapInPandas(search, "point long, weights array<double>, others array<long>").toPandas()


def _first_outside(groups: np.ndarray, weights: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per point, its cheapest candidate that is still outside its group (infinite without one); per group, the least of them."""
    points = np.arange(len(groups))
    outside = (groups[others] != groups[:, None]) & np.isfinite(weights)
    place = outside.argmax(axis=1)
    reach = np.where(outside.any(axis=1), weights[points, place], np.inf)
    least = np.full(len(groups), np.inf)
    np.minimum.at(least, groups, reach)
    return reach, others[points, place], least


def spanning_tree(spark: SparkSession, points: np.ndarray, neighbours: int = MIN_SAMPLES) -> list[tuple[float, int, int]]:
    """Edges (weight, low, high) of the minimum spanning tree of mutual reachability.

    A point keeps the candidates of its last search. Groups only grow, so what is
    not among them costs at least as much as the last one: a point searches again
    only if none is left and that bound lies below the cheapest edge of its group.
    """
    cores = core_distances(spark, points, neighbours).toPandas()
    core = np.empty(len(points))
    core[cores["id"]] = cores["core"]
    shared = spark.sparkContext.broadcast((points, core))
    groups = np.arange(len(points))
    others = np.repeat(groups[:, None], CANDIDATES, axis=1)
    weights = np.full(others.shape, -np.inf)
    edges: list[tuple[float, int, int]] = []
    while len(edges) < len(points) - 1:
        reach, target, least = _first_outside(groups, weights, others)
        wanted = np.isinf(reach) & (weights[:, -1] < least[groups])
        if wanted.any():
            found = _search(spark, shared, groups, wanted)
            weights[found["point"]], others[found["point"]] = np.stack(found["weights"]), np.stack(found["others"])
            reach, target, least = _first_outside(groups, weights, others)
        low, high = np.minimum(target, np.arange(len(groups))), np.maximum(target, np.arange(len(groups)))
        order = np.lexsort((high, low, reach, groups))
        firsts = order[np.unique(groups[order], return_index=True)[1]]
        joined = groups.copy()
        # Cheapest first; an edge that would close a cycle is one of several
        # equally cheap ones and is left out.
        for weight, one, two in sorted(zip(reach[firsts].tolist(), low[firsts].tolist(), high[firsts].tolist())):
            left, right = _top(joined, one), _top(joined, two)
            if left != right:
                edges.append((weight, one, two))
                joined[right] = left
        groups = np.array([_top(joined, point) for point in range(len(points))])
    return sorted(edges)


def _top(parent: np.ndarray | list[int], node: int) -> int:
    """The representative of a node's group; shortens the way to it."""
    while parent[node] != node:
        parent[node] = parent[parent[node]]
        node = parent[node]
    return node


def _dendrogram(edges: list[tuple[float, int, int]], points: int) -> tuple[list, list[int]]:
    """Merges (left, right, distance) in order of distance, and the size of every node."""
    parent = list(range(2 * points - 1))
    size = [1] * points
    merges = []
    for distance, low, high in edges:
        left, right = _top(parent, low), _top(parent, high)
        node = points + len(merges)
        parent[left] = parent[right] = node
        size.append(size[left] + size[right])
        merges.append((left, right, distance))
    return merges, size


def label_points(edges: list[tuple[float, int, int]], points: int, min_cluster: int = MIN_CLUSTER) -> np.ndarray:
    """Cluster labels by excess of mass; -1 for noise. The root is never a cluster."""
    if points < 2:
        return np.full(points, -1)
    merges, size = _dendrogram(edges, points)
    above, birth, mass = [-1], [0.0], [0.0]
    home = np.zeros(points, dtype=int)
    # Walk down from the root. If both sides of a merge are large enough they
    # become clusters; else the large side goes on as the cluster, and the
    # points of a small side leave it there.
    waiting = [(2 * points - 2, 0, True)]
    while waiting:
        node, cluster, inside = waiting.pop()
        if node < points:
            home[node] = cluster
            continue
        left, right, distance = merges[node - points]
        if not inside:
            waiting += [(left, cluster, False), (right, cluster, False)]
            continue
        level = 1.0 / distance if distance > 0 else np.inf
        excess = level - birth[cluster] if level > birth[cluster] else 0.0
        large = [size[child] >= min_cluster for child in (left, right)]
        for child, is_large in zip((left, right), large):
            if all(large):
                above.append(cluster)
                birth.append(level)
                mass.append(0.0)
                waiting.append((child, len(above) - 1, True))
            else:
                waiting.append((child, cluster, is_large))
            if all(large) or not is_large:
                mass[cluster] += excess * size[child]
    return _chosen(above, mass)[home]


def _chosen(above: list[int], mass: list[float]) -> np.ndarray:
    """Per cluster of the tree, the label of the chosen cluster it belongs to, or -1.

    A cluster is chosen over its parts unless these hold more mass together.
    """
    parts = [0.0] * len(above)
    chosen = [False] * len(above)
    for cluster in range(len(above) - 1, 0, -1):
        chosen[cluster] = mass[cluster] >= parts[cluster]
        parts[above[cluster]] += max(mass[cluster], parts[cluster])
    labels = np.full(len(above), -1)
    count = 0
    for cluster in range(1, len(above)):
        if labels[above[cluster]] >= 0:
            labels[cluster] = labels[above[cluster]]
        elif chosen[cluster]:
            labels[cluster] = count
            count += 1
    return labels


def centroids(members: DataFrame, vector: str = "features", label: str = "label") -> DataFrame:
    """Mean vector per label; one aggregation, combined before the shuffle. All vectors must have one length."""
    means = [F.avg(F.col(vector)[i].cast("double")) for i in range(vector_width(members, vector))]
    return members.filter(F.col(label) >= 0).groupBy(label).agg(F.array(*means).alias("centroid"))


@dataclass(frozen=True)
class Centroids:
    """Centroids in label order."""

    labels: np.ndarray
    points: np.ndarray

    def nearest(self, values: np.ndarray, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Distance to the nearest centroid and its label; the lowest label on a tie."""
        distance, label = np.empty(len(values)), np.empty(len(values), dtype=np.int64)
        for start in range(0, len(values), chunk):
            block = values[start : start + chunk]
            squared = np.zeros((len(block), len(self.points)))
            for axis in range(block.shape[1]):
                squared += (block[:, axis][:, None] - self.points[:, axis][None, :]) ** 2
            best = squared.argmin(axis=1)
            distance[start : start + chunk] = np.sqrt(squared[np.arange(len(block)), best])
            label[start : start + chunk] = self.labels[best]
        return distance, label


def load_centroids(table: DataFrame, label: str = "label") -> Centroids:
    """Collect a centroid table, whose size is checked.

    A density fit yields at most its sample size over `MIN_CLUSTER` clusters.
    """
    rows = table.limit(CENTROID_LIMIT + 1).collect()
    if len(rows) > CENTROID_LIMIT:
        raise ValueError(f"more than {CENTROID_LIMIT} centroids")
    rows.sort(key=lambda row: row[label])
    return Centroids(np.array([row[label] for row in rows]), np.array([row["centroid"] for row in rows], dtype=float))


def list_matrix(vectors: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix, without a copy per row."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(vectors), -1)


def assign_nearest(df: DataFrame, centres: Centroids, vector: str = "features") -> DataFrame:
    """Add `distance` and `nearest_label` to every row; no shuffle."""

    @F.arrow_udf("distance double, nearest_label long")
    def nearest(vectors: pa.Array) -> pa.Array:
        distance, label = centres.nearest(list_matrix(vectors))
        return pa.StructArray.from_arrays([pa.array(distance), pa.array(label)], ["distance", "nearest_label"])

    found = df.withColumn("_nearest", nearest(F.col(vector)))
    return found.withColumns({"distance": F.col("_nearest.distance"), "nearest_label": F.col("_nearest.nearest_label")}).drop("_nearest")


def add_distance(df: DataFrame, model: DensityModel, out: str, vector: str = "features") -> DataFrame:
    """Add the distance to the nearest centroid of a fit, in its reduced space; 1 for all rows without a cluster."""

    @F.arrow_udf("double")
    def distance(vectors: pa.Array) -> pa.Array:
        return pa.array(model_distance(directions, centres, clusters, list_matrix(vectors)))

    directions, centres, clusters = model.directions, model.centres, model.clusters
    return df.withColumn(out, distance(F.col(vector)))


def model_distance(directions: np.ndarray, centres: Centroids, clusters: int, values: np.ndarray) -> np.ndarray:
    return centres.nearest(values @ directions)[0] if clusters else np.ones(len(values))


def silhouette_rows(
    members: DataFrame, key: str, vector: str = "features", label: str = "label", size: int = SILHOUETTE_ROWS, seed: int = SEED
) -> DataFrame:
    """Silhouette of `size` clustered rows, drawn by hash, each held against all clustered rows.

    The rows asked for travel to every task, which adds up the distances from each
    of them to the rows it reads, per label; the sums meet in Spark. 0 for the only
    row of a cluster, without a second cluster, and where all distances are 0.
    """
    spark = members.sparkSession
    clustered = members.filter(F.col(label) >= 0).select(key, vector, F.col(label).cast("long").alias(label))
    vector_width(clustered, vector)
    asked = sample_rows(clustered, size, seed, key).toArrow()
    points = list_matrix(asked.column(vector).combine_chunks())
    centre = points.mean(axis=0) if len(points) else np.zeros(points.shape[1])
    shared = spark.sparkContext.broadcast((points - centre, centre))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, centre = shared.value
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            values, own = list_matrix(batch.column(0)) - centre, batch.column(1).to_numpy()
            for name in np.unique(own).tolist():
                rows, sums = held.get(name, (0, np.zeros(len(points))))
                mine = values[own == name]
                held[name] = (rows + len(mine), sums + _distance_sums(points, mine))
            if len(held) * len(points) > HELD_SUMS:
                yield from _sum_rows(held)
                held.clear()
        yield from _sum_rows(held)

    sums = clustered.select(vector, label).mapInArrow(measure, "place long, other long, rows long, total double")
    sums = sums.groupBy("place", "other").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))
    places = pa.array(np.arange(len(points)))
    # At most `size` keys and labels.
    known = spark.createDataFrame(asked.select([key, label]).append_column("place", places))
    own = F.col("other") == F.col(label)
    found = known.join(sums, "place").groupBy("place", key, label).agg(
        F.max(F.when(own, F.col("rows"))).alias("rows"),
        F.max(F.when(own, F.col("total") / F.greatest(F.col("rows") - 1, F.lit(1)))).alias("inside"),
        F.min(F.when(~own, F.col("total") / F.col("rows"))).alias("outside"),
    )
    wide = F.greatest("outside", "inside")
    value = F.when((F.col("rows") > 1) & F.col("outside").isNotNull() & (wide > 0), (F.col("outside") - F.col("inside")) / wide)
    return found.select(key, label, F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def _distance_sums(points: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Per point, the sum of its distances to all values; `CHUNK` points at a time."""
    norms, across = (values**2).sum(axis=1), np.ascontiguousarray(values.T)
    sums = np.empty(len(points))
    for start in range(0, len(points), CHUNK):
        part = points[start : start + CHUNK]
        both = (part**2).sum(axis=1)[:, None] + norms
        squared = both - 2.0 * (part @ across)
        # What rounding leaves of the distance between copies.
        squared[squared < both * 1e-14] = 0.0
        sums[start : start + CHUNK] = np.sqrt(squared).sum(axis=1)
    return sums


def _sum_rows(held: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for name, (rows, sums) in held.items():
        n = len(sums)
        columns = [np.arange(n), np.full(n, name), np.full(n, rows), sums]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["place", "other", "rows", "total"])


def silhouette_score(members: DataFrame, key: str, vector: str = "features", label: str = "label") -> float | None:
    """Mean silhouette; none with fewer than 20 clustered rows or 2 clusters."""
    clustered = members.filter(F.col(label) >= 0)
    rows, clusters = clustered.agg(F.count("*"), F.count_distinct(label)).first()
    if rows < SILHOUETTE_MIN_ROWS or clusters < 2:
        return None
    return silhouette_rows(members, key, vector, label).agg(F.avg("silhouette")).first()[0]


@dataclass(frozen=True)
class DensityModel:
    """What scoring needs of a fit, and its figures."""

    directions: np.ndarray
    centres: Centroids
    members: DataFrame
    clusters: int
    noise_rate: float
    silhouette: float | None

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance to the nearest centroid; 1 for every row if no cluster was found."""
        if not self.clusters:
            return np.ones(len(values)), np.full(len(values), -1)
        return self.centres.nearest(values @ self.directions)


def cluster_sample(sample: DataFrame, min_cluster: int = MIN_CLUSTER, neighbours: int = MIN_SAMPLES) -> DataFrame:
    """Add `label` to the rows of a bounded sample of `event_id` and `features`."""
    spark = sample.sparkSession
    points, table = _collect_points(sample.orderBy("event_id"), "features", "event_id")
    labels = label_points(spanning_tree(spark, points, neighbours), len(points), min_cluster)
    # Ids and labels only; the vectors stay where they are. An id that rows share has one label.
    found = dict(zip(table["event_id"].tolist(), map(int, labels)))
    known = spark.createDataFrame(list(found.items()), "_id string, label long")
    return sample.join(known, F.col("event_id").eqNullSafe(F.col("_id"))).select("event_id", "features", "label")


def cluster_all(rows: DataFrame, min_cluster: int = MIN_CLUSTER, neighbours: int = MIN_SAMPLES, keep: tuple[str, ...] = ("event_id", "features")) -> DataFrame:
    """Add `label` to all rows of `event_id` and `features`, reduced like those of `fit_density`, of which the columns `keep` stay; no part goes through the driver."""
    reduced = stage(assign_projection(rows.select("event_id", "features"), fit_pca(rows)), "reduced")
    return hierarchy.cluster_rows(reduced, min_cluster, neighbours, keep=keep)


def fit_density(sample: DataFrame, min_cluster: int = MIN_CLUSTER, neighbours: int = MIN_SAMPLES, whole: bool = False) -> DensityModel:
    """Reduce, cluster and summarise `event_id` and `features`: a bounded sample, or all rows of a `whole` table."""
    directions = fit_pca(sample)
    reduced = assign_projection(sample, directions)
    clustered = hierarchy.cluster_rows(stage(reduced.select("event_id", "features"), "reduced"), min_cluster, neighbours) if whole else cluster_sample(reduced, min_cluster, neighbours)
    members = stage(clustered, "members")
    rows, noise, clusters = members.agg(
        F.count("*"), F.count_if(F.col("label") < 0), F.count_distinct(F.when(F.col("label") >= 0, F.col("label")))
    ).first()
    return DensityModel(
        directions,
        load_centroids(centroids(members)),
        members,
        clusters,
        noise / rows,
        silhouette_score(members, "event_id"),
    )


def assign_projection(df: DataFrame, directions: np.ndarray, vector: str = "features") -> DataFrame:
    """Replace the vectors by their principal components."""

    @F.arrow_udf("array<double>")
    def project(vectors: pa.Array) -> pa.Array:
        reduced = list_matrix(vectors) @ directions
        ends = np.arange(len(reduced) + 1, dtype=np.int32) * reduced.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(reduced.ravel()))

    return df.withColumn(vector, project(F.col(vector)))
