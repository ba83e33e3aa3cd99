import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftlog.operators import cells, clusters, hierarchy


def reach_matrix(points, neighbours):
    distance = np.zeros((len(points), len(points)))
    for axis in range(points.shape[1]):
        distance += (points[:, axis][:, None] - points[:, axis]) ** 2
    distance = np.sqrt(distance)
    core = np.sort(distance, axis=1)[:, min(neighbours, len(points)) - 1]
    return core, np.maximum(distance, np.maximum(core[:, None], core))


def prim(reach):
    """Edges (weight, one, two) of a minimum spanning tree."""
    n = len(reach)
    best, source, inside, edges = reach[0].copy(), np.zeros(n, int), np.zeros(n, bool), []
    inside[0] = True
    for _ in range(n - 1):
        node = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[node], int(source[node]), node))
        inside[node] = True
        closer = reach[node] < best
        best, source = np.where(closer, reach[node], best), np.where(closer, node, source)
    return edges


def parts_below(members, edges, distance):
    """Components of the edges shorter than `distance`, with their edges."""
    root = {i: i for i in members}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    short = [edge for edge in edges if edge[0] < distance]
    for _, a, b in short:
        root[find(a)] = find(b)
    found = {}
    for i in members:
        found.setdefault(find(i), ([], []))[0].append(i)
    for edge in short:
        found[find(edge[1])][1].append(edge)
    return list(found.values())


def plain_labels(points, min_cluster, neighbours):
    """Excess of mass from the top down; equal distances part at once. Clusters by their first point."""
    _, reach = reach_matrix(points, neighbours)
    clusters = []

    def level(distance):
        return 1 / distance if distance > 0 else math.inf

    def grow(members, edges, birth, above):
        number = len(clusters)
        clusters.append({"above": above, "mass": 0.0, "rows": members})
        while edges:
            distance = max(edge[0] for edge in edges)
            excess = level(distance) - birth if level(distance) > birth else 0.0
            parts = parts_below(members, edges, distance)
            large = [part for part in parts if len(part[0]) >= min_cluster]
            if len(large) == 1:
                clusters[number]["mass"] += excess * (len(members) - len(large[0][0])) if excess else 0.0
                members, edges = large[0]
                continue
            clusters[number]["mass"] += excess * len(members)
            for part in large:
                grow(*part, level(distance), number)
            return

    if len(points) < min_cluster:
        return [-1] * len(points)
    grow(list(range(len(points))), prim(reach), 0.0, -1)
    best, parts = [0.0] * len(clusters), [0.0] * len(clusters)
    for i in range(len(clusters) - 1, -1, -1):
        best[i] = max(clusters[i]["mass"], parts[i])
        if i:
            parts[clusters[i]["above"]] += best[i]
    labels, taken = np.full(len(points), -1), set()
    for i in range(1, len(clusters)):
        if clusters[i]["above"] in taken:
            taken.add(i)
        elif clusters[i]["mass"] >= parts[i]:
            taken.add(i)
            labels[clusters[i]["rows"]] = i
    firsts = {label: place for place, label in reversed(list(enumerate(labels))) if label >= 0}
    order = {label: number for number, label in enumerate(sorted(firsts, key=firsts.get))}
    return [order.get(label, -1) for label in labels]


def frame_of(spark, points):
    table = pd.DataFrame({"event_id": [f"{i:05d}" for i in range(len(points))], "features": list(points)})
    return spark.createDataFrame(table, "event_id string, features array<double>")


def shapes(kind):
    rng = np.random.default_rng(7)
    if kind == "blobs":
        return np.vstack([centre + rng.normal(size=(90, 3)) for centre in np.array([[0, 0, 0], [9, 9, 0], [0, 9, 9.0]])] + [rng.uniform(-30, 30, size=(12, 3))])
    if kind == "nested":
        sizes = [0.1, 0.1, 0.3, 1.0, 1.0]
        centres = np.array([[0, 0], [1, 0], [4, 1], [12, 0], [20, 0.0]])
        return np.vstack([centre + size * rng.normal(size=(40, 2)) for centre, size in zip(centres, sizes)])
    if kind == "chain":
        return np.vstack([[3.0 * i + 0.05 * i * i, 0.0] + 0.2 * rng.normal(size=(25, 2)) for i in range(14)])
    if kind == "grid":
        return np.array([(x + (x > 6) * 3, y) for x in range(14) for y in range(14)], dtype=float)
    if kind == "copies":
        return np.repeat(rng.integers(0, 6, size=(40, 2)).astype(float), rng.integers(1, 30, 40), axis=0)
    return rng.normal(size=(200, 2))


def test_splits_give_every_point_one_cell():
    points = np.random.default_rng(1).integers(0, 4, size=(500, 3)).astype(float)
    splits = cells.split_points(points, 20)
    found = splits.cells(points)
    assert set(found) == set(range(found.max() + 1))
    alike = {}
    for point, cell in zip(map(tuple, points), found):
        assert alike.setdefault(point, cell) == cell
    assert cells.split_points(np.ones((100, 2)), 5).cells(np.zeros((3, 2))).tolist() == [0, 0, 0]


@pytest.mark.parametrize(("kind", "cell_rows"), [("nested", 30), ("copies", 15)])
def test_levels_and_labels_against_all_pairs(spark, kind, cell_rows):
    points = shapes(kind)
    min_cluster, neighbours = (20, 5)
    core, reach = reach_matrix(points, neighbours)
    frame = frame_of(spark, points)
    table = cells.distinct_points(frame, cell_rows)
    measured = table.join(cells.core_distances(table, points.shape[1], neighbours), "id")
    found = {tuple(row.features): (row.core, row.copies) for row in measured.collect()}
    assert sum(copies for _, copies in found.values()) == len(points)
    assert [found[tuple(point)][0] for point in points] == core.tolist()
    labels = [row.label for row in hierarchy.cluster_rows(frame, min_cluster, neighbours, cell_rows=cell_rows).orderBy("event_id").collect()]
    assert labels == plain_labels(points, min_cluster, neighbours)


def test_spanning_edges(spark):
    points = shapes("blobs")
    _, reach = reach_matrix(points, 5)
    table = cells.distinct_points(frame_of(spark, points), 20)
    measured = table.join(cells.core_distances(table, 3, 5), "id")
    edges = hierarchy.spanning_edges(hierarchy.levels(measured, 3)).collect()
    assert len(edges) == len(points) - 1
    assert sorted(edge.weight for edge in edges) == sorted(float(edge[0]) for edge in prim(reach))


def test_few_rows_and_none(spark):
    frame = frame_of(spark, np.zeros((3, 2)))
    assert [row.label for row in hierarchy.cluster_rows(frame, 2, 5).collect()] == [-1, -1, -1]
    assert hierarchy.cluster_rows(frame.limit(1), 2, 5).collect()[0].label == -1
    assert hierarchy.cluster_rows(frame.filter(F.lit(False)), 2, 5).collect() == []


def test_choice_in_a_deep_tree_takes_few_steps(spark, monkeypatch):
    # A chain of clusters, each with a small part beside it: 150 levels.
    rng = np.random.default_rng(3)
    depth = 150
    above, top = {0: None}, {0: math.inf}
    for i in range(1, 2 * depth):
        above[i] = i - 1 if i % 2 else i - 2
        top[i] = 1000.0 - i + (i % 2 == 0)
    leaves = {i: top[i] * rng.uniform(0.01, 0.99) if i else 5000.0 for i in above}
    copies = {i: int(rng.integers(1, 60)) for i in above}
    tree = spark.createDataFrame([(i, above[i], top[i]) for i in above], "node long, above long, top double")
    lowest = spark.createDataFrame([(i, i) for i in above], "territory long, node long")
    placed = spark.createDataFrame([(i, copies[i], leaves[i], i) for i in above], "id long, copies long, leaves double, territory long")

    def excess(low, high):
        return 1 / low - 1 / high

    home = {}
    for i in above:
        home[i] = i
        while top[home[i]] <= leaves[i]:
            home[i] = above[home[i]]
    rows, mass, part, best = dict.fromkeys(above, 0), dict.fromkeys(above, 0.0), dict.fromkeys(above, 0.0), {}
    for i in above:
        rows[home[i]] += copies[i]
        mass[home[i]] += excess(leaves[i], top[home[i]]) * copies[i]
    for i in sorted(above, reverse=True):
        best[i] = max(mass[i], part[i])
        if i:
            up = above[i]
            rows[up], mass[up], part[up] = rows[up] + rows[i], mass[up] + excess(top[i], top[up]) * rows[i], part[up] + best[i]
    expected = {0: None}
    for i in range(1, 2 * depth):
        expected[i] = expected[above[i]] if expected[above[i]] is not None else i if mass[i] >= part[i] else None
    staged, stage = [], hierarchy.stage
    monkeypatch.setattr(hierarchy, "stage", lambda df, name, *folders: (staged.append(name), stage(df, name, *folders))[1])
    found = {row.territory: row.chosen for row in hierarchy.chosen_clusters(placed, tree, lowest).collect()}
    assert found == expected
    assert len(set(found.values())) > 2
    assert len(staged) < 60


def test_ranked_neighbours_have_plain_distances():
    rng = np.random.default_rng(5)
    features = np.vstack([rng.normal(size=(300, 24)) + 1e4, np.repeat(rng.normal(size=(1, 24)), 7, axis=0)])
    n = len(features)
    cell = cells.Points(np.arange(n), features, np.ones(n, int), np.zeros(n), np.arange(n), np.full(n, np.inf))
    plain = np.sort(cell.distances(cell), axis=1)
    ranked = cells.Ranked(cell)
    row, place, distance = ranked.nearest(cell, 10)
    assert distance.reshape(n, 10).tolist() == plain[:, :10].tolist()
    assert (cell.distances(cell)[row, place] == distance).all()
    cell.bound = plain[:, 3]
    row, _, distance = ranked.nearest(cell, 10)
    for i in range(n):
        near = plain[i][plain[i] <= plain[i, 3]][:10]
        assert distance[row == i][: len(near)].tolist() == near.tolist()


def test_cheapest_edges_of_a_cell_against_all_pairs():
    rng = np.random.default_rng(11)
    features = np.vstack([rng.normal(size=(400, 6)) + 1e3, rng.integers(0, 3, size=(300, 6)) + 1e3]).round(6)
    features = np.unique(features, axis=0)
    n = len(features)
    group, core = rng.integers(0, 40, n), rng.choice([0.0, 0.5, 1.5], n)
    cell = cells.Points(np.arange(n), features, np.ones(n, int), core, group, np.full(n, np.inf))
    weights = np.maximum(np.maximum(cell.distances(cell), core), core[:, None])
    weights[group[:, None] == group] = np.inf
    first, least = weights.argmin(axis=1), weights.min(axis=1)
    row, place, weight = cells.Ranked(cell).cheapest(cell)
    assert (row.tolist(), place.tolist(), weight.tolist()) == (list(range(n)), first.tolist(), least.tolist())
    # Points whose bound is their edge keep it, points with a lower one have none.
    cell.bound = np.where(np.arange(n) % 2 == 0, least, least * 0.999)
    row, place, weight = cells.Ranked(cell).cheapest(cell)
    assert (row.tolist(), place.tolist(), weight.tolist()) == (list(range(0, n, 2)), first[::2].tolist(), least[::2].tolist())
    cell.group[:] = 1
    assert len(cells.Ranked(cell).cheapest(cell)[0]) == 0


def test_points_are_packed_whole():
    ids = np.array([3, (1 << 62) + 1, (1 << 53) + 1])
    points = cells.Points(ids, np.arange(6.0).reshape(3, 2), np.array([1, 2, 3]), np.array([0.0, 0.1, math.inf]), ids[::-1].copy(), np.array([math.inf, 0.0, 2.0]))
    rows = points.packed()
    found = cells.Points.unpacked([(rows[:2].tobytes(), 2), (rows[2:].tobytes(), 1)])
    for name in ("id", "features", "copies", "core", "group", "bound"):
        assert getattr(found, name).tolist() == getattr(points, name).tolist()


@pytest.mark.parametrize("kind", ["chain", "grid"])
def test_choice_in_one_task_and_in_joins(spark, monkeypatch, kind):
    points = shapes(kind)
    width = points.shape[1]
    table = cells.distinct_points(frame_of(spark, points), 60)
    measured = hierarchy.stage(table.join(cells.core_distances(table, width, 4), "id"), "cores")
    placed, merges = hierarchy.territories(measured, hierarchy.levels(measured, width), 8)
    staged, stage = [], hierarchy.stage
    monkeypatch.setattr(hierarchy, "stage", lambda df, name, *folders: (staged.append(name), stage(df, name, *folders))[1])
    found = {row.territory: (row.chosen, row.top) for row in hierarchy.choice(placed, merges).collect()}
    # A job for the places where rows leave, and one for the tree.
    assert staged == ["left"]
    monkeypatch.setattr(hierarchy, "ONE_TASK_ROWS", 0)
    assert found == {row.territory: (row.chosen, row.top) for row in hierarchy.choice(placed, merges).collect()}
    assert "contracted" in staged
    assert len(found) == merges.count()


def test_tree_in_one_task_joins_what_meets_at_one_distance():
    # Three territories meet at 2, a fourth at 5: the three are the parts of one cluster.
    territory, above = np.array([10, 20, 30, 40]), np.array([-1, 10, 10, 20])
    weight, low, high = np.array([math.inf, 2.0, 2.0, 5.0]), np.array([-1, 1, 2, 3]), np.array([-1, 4, 5, 6])
    tree = clusters.grow_tree(territory, above, weight, low, high, np.array([1.0, 1.0, 1.0, 4.0]))
    lowest = tree.lowest.tolist()
    assert len(set(lowest)) == 4
    assert len({tree.up[i] for i in lowest[:3]}) == 1 and tree.up[lowest[0]] != tree.up[lowest[3]]
    assert tree.top[lowest].tolist() == [2.0, 2.0, 2.0, 5.0]
    assert tree.is_cluster.sum() == 6
    # Rows leave the fourth at 4; those of the three at 1, one of them after the three have met and one after all have.
    place, leaves, copies = tree.lowest[[0, 1, 2, 3, 0, 1]], np.array([1.0, 1.0, 1.0, 4.0, 3.0, 6.0]), np.array([10, 10, 10, 10, 1, 1])
    assert clusters.climbed(tree, place, leaves).tolist() == [*lowest, tree.up[lowest[0]], tree.up[lowest[3]]]
    assert clusters.choose(tree, place, leaves, copies).tolist() == lowest
    # Close parts hold less together than the cluster.
    leaves = np.array([1.9, 1.9, 1.9, 4.0, 3.0, 6.0])
    assert clusters.choose(tree, place, leaves, copies).tolist() == [tree.up[lowest[0]]] * 3 + [lowest[3]]
