"""Distances between all points of a table, cell by cell.

Points are placed in cells of about `CELL_ROWS` by a tree of splits, made from points that a
hash draws. Each cell has the box of its points. A point is held against its own cell
first; what it finds there bounds what other cells must beat, and it travels only to
those whose box is near enough. Results are those of comparing all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.session import stage

# Points of a cell, about, drawn points for each cell, and rows of a block of distances.
CELL_ROWS, DRAWN, BLOCK = 1_000, 32, 256
# Bytes that a task packs before it hands them on, and pairs of a point that are not thinned out before their distances are taken.
PACKED_BYTES, FEW_PAIRS = 1 << 23, 16
# With more axes than this, boxes rule out little, and a cell holds more points so that fewer copies of a point travel.
FEW_AXES, WIDE_CELL_ROWS = 16, 8_000

_CONTENT = "cell int, id long, features array<double>, copies long, core double, group long"
_PROBE = f"{_CONTENT}, bound double"
_PACKED = "cell int, kind int, first long, points int, part binary"


@dataclass(frozen=True)
class Splits:
    """A tree of splits: where a value on `axis` is above `value`, go right. Leaves have axis -1 and their cell in `left`."""

    axis: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(self.axis[node] >= 0)
            if not len(inner):
                return self.left[node]
            at = node[inner]
            above = points[inner, self.axis[at]] > self.value[at]
            node[inner] = np.where(above, self.right[at], self.left[at])


def split_points(points: np.ndarray, leaf_rows: int) -> Splits:
    """Halve the points at the median of their widest axis until `leaf_rows` are left, or they are all alike."""
    nodes: list[list] = [[-1, 0.0, 0, 0]]
    waiting, cells = [(0, points)], 0
    while waiting:
        node, own = waiting.pop()
        spread = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(1)
        if len(own) <= leaf_rows or spread.max() == 0:
            nodes[node][2] = cells
            cells += 1
            continue
        axis = int(spread.argmax())
        values = np.sort(own[:, axis])
        middle = values[len(values) // 2]
        # Values that equal the median stay together, on the side that leaves the other one some.
        value = middle if middle < values[-1] else values[np.searchsorted(values, middle) - 1]
        above = own[:, axis] > value
        nodes[node] = [axis, float(value), len(nodes), len(nodes) + 1]
        waiting += [(len(nodes), own[~above]), (len(nodes) + 1, own[above])]
        nodes += [[-1, 0.0, 0, 0], [-1, 0.0, 0, 0]]
    axis, value, left, right = zip(*nodes)
    return Splits(np.array(axis), np.array(value), np.array(left), np.array(right))


def matrix_of(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(vectors), -1)


def distinct_points(rows: DataFrame, cell_rows: int | None = None) -> DataFrame:
    """A table of the distinct `features` of the rows with `id`, `copies` and `cell`."""
    counted = rows.groupBy("features").agg(F.count("*").alias("copies"))
    points = stage(counted.select(F.monotonically_increasing_id().alias("id"), "features", "copies"), "points")
    total = points.count()
    cells = max(1, math.ceil(total / (cell_rows or CELL_ROWS)))
    share = min(1.0, DRAWN * cells / max(total, 1))
    drawn = points.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("features")
    # About DRAWN points for each cell come to the driver.
    vectors = drawn.toArrow().column("features").combine_chunks()
    splits = split_points(matrix_of(vectors), DRAWN) if len(vectors) else Splits(np.array([-1]), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64))

    @F.arrow_udf("int")
    def cell(features: pa.Array) -> pa.Array:
        return pa.array(splits.cells(matrix_of(features)), pa.int32())

    return stage(points.withColumn("cell", cell("features")), "cells")


@dataclass(frozen=True)
class Boxes:
    """The box of each cell, the least core distance in it, and its group if all its points are of one, else -1."""

    cells: np.ndarray
    low: np.ndarray
    high: np.ndarray
    core: np.ndarray
    group: np.ndarray

    def reach(self, points: np.ndarray, cores: np.ndarray, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Per point and cell, a distance that no point of the cell is nearer than, by mutual reachability."""
        low, high = self.low[which], self.high[which]
        squared = np.zeros((len(points), len(low)))
        for axis in range(points.shape[1]):
            value = points[:, axis][:, None]
            squared += np.maximum(np.maximum(low[:, axis] - value, value - high[:, axis]), 0.0) ** 2
        return np.maximum(np.maximum(np.sqrt(squared), self.core[which]), cores[:, None])

    def near(self, some: Points, own: int) -> tuple[np.ndarray, np.ndarray]:
        """For points of the cell `own`, pairs (place of a point, place of a cell) of the other cells that may hold something within the point's bound."""
        # Cells that no point of the box of all of them reaches are left out first; the factor is room for rounding.
        gaps = np.maximum(np.maximum(self.low - some.features.max(axis=0), some.features.min(axis=0) - self.high), 0.0)
        least = np.maximum(np.maximum(np.sqrt((gaps**2).sum(axis=1)), self.core), some.core.min())
        open_ = (least <= some.bound.max() * (1 + 1e-12)) & (self.cells != own)
        if (some.group == some.group[0]).all():
            open_ &= self.group != some.group[0]
        which = np.flatnonzero(open_)
        inside = self.reach(some.features, some.core, which) <= some.bound[:, None]
        inside &= (self.group[which] != some.group[:, None]) | (self.group[which] < 0)
        places, targets = np.nonzero(inside)
        return places, which[targets]


def boxes_of(points: DataFrame, width: int) -> Boxes:
    """One row per cell; `points` has `core` and `group`."""
    ends = [f(F.col("features")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(width)]
    rows = points.groupBy("cell").agg(*ends, F.min("core").alias("core"), F.min("group").alias("first"), F.max("group").alias("last")).toPandas().sort_values("cell")
    ends = [rows[[f"{name}{i}" for i in range(width)]].to_numpy(float).reshape(len(rows), width) for name in ("low", "high")]
    group = np.where(rows["first"] == rows["last"], rows["first"], -1)
    return Boxes(rows["cell"].to_numpy(np.int64), *ends, rows["core"].to_numpy(float), group)


@dataclass
class Points:
    """Some points as arrays."""

    id: np.ndarray
    features: np.ndarray
    copies: np.ndarray
    core: np.ndarray
    group: np.ndarray
    bound: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Points:
        plain = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("id", "copies", "core", "group", "bound")]
        return cls(plain[0], matrix_of(batch.column("features")), *plain[1:])

    def take(self, places: np.ndarray | slice) -> Points:
        return Points(self.id[places], self.features[places], self.copies[places], self.core[places], self.group[places], self.bound[places])

    def blocks(self) -> Iterator[Points]:
        for first in range(0, len(self.id), BLOCK):
            yield self.take(slice(first, first + BLOCK))

    def packed(self) -> np.ndarray:
        """A row of eight-byte values for each point."""
        plain = [column.astype(kind, copy=False).view(float)[:, None] for column, kind in ((self.id, np.int64), (self.copies, np.int64), (self.group, np.int64), (self.core, float), (self.bound, float))]
        return np.hstack([*plain, self.features])

    @classmethod
    def unpacked(cls, parts: list[tuple[bytes, int]]) -> Points:
        """The points of several rows of bytes, each with its number of points."""
        rows = np.vstack([np.frombuffer(part).reshape(n, -1) for part, n in parts])
        whole = [np.ascontiguousarray(rows[:, i]) for i in range(5)]
        return cls(whole[0].view(np.int64), np.ascontiguousarray(rows[:, 5:]), whole[1].view(np.int64), whole[3], whole[2].view(np.int64), whole[4])

    def distances(self, others: Points) -> np.ndarray:
        """Plain distances, which are the same in both directions to the last digit."""
        squared = np.zeros((len(self.id), len(others.id)))
        for axis in range(self.features.shape[1]):
            squared += (self.features[:, axis][:, None] - others.features[:, axis]) ** 2
        return np.sqrt(squared)


class Ranked:
    """The points of a cell, ranked by a matrix product.

    The product loses the last digits. It only rules points out, with room for what it
    may lose; the distances of the rest are the plain ones.
    """

    def __init__(self, cell: Points) -> None:
        self.cell, self.centre = cell, cell.features.mean(axis=0)
        self.centred = cell.features - self.centre
        self.norms = (self.centred**2).sum(axis=1)

    def _squared(self, some: Points) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of points to those of the cell, and per point what they may have lost."""
        centred = some.features - self.centre
        norms = (centred**2).sum(axis=1)[:, None]
        squared = norms + self.norms - 2.0 * (centred @ self.centred.T)
        return squared, 8 * (centred.shape[1] + 8) * np.finfo(float).eps * (norms + self.norms.max())

    def _distances(self, some: Points, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The plain distances of pairs."""
        exact = np.zeros(len(row))
        for axis in range(some.features.shape[1]):
            exact += (some.features[row, axis] - self.cell.features[place, axis]) ** 2
        return np.sqrt(exact)

    def cheapest(self, some: Points) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cheapest edge of each point to a point of another group in the cell, as far as it is within the point's bound: row, place in the cell, weight.

        Of equal weights the first place.
        """
        squared, lost = self._squared(some)
        upto = some.bound[:, None] ** 2 * (1 + 1e-12) + lost
        near = squared <= upto
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > FEW_PAIRS)
        if len(many):
            weights = np.maximum(squared[many], self.cell.core**2)
            weights[some.group[many, None] == self.cell.group] = np.inf
            least = np.maximum(weights.min(axis=1), some.core[many] ** 2)[:, None] * (1 + 1e-12) + 2 * lost[many]
            near[many] = (weights <= np.minimum(least, upto[many])) & (weights < np.inf)
        row, place = np.nonzero(near)
        other = some.group[row] != self.cell.group[place]
        row, place = row[other], place[other]
        weight = np.maximum(np.maximum(self._distances(some, row, place), self.cell.core[place]), some.core[row])
        within = weight <= some.bound[row]
        row, place, weight = row[within], place[within], weight[within]
        if not len(row):
            return row, place, weight
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        least = np.repeat(np.minimum.reduceat(weight, starts), np.diff(np.append(starts, len(row))))
        least_at = np.flatnonzero(weight == least)
        first = least_at[np.concatenate(([True], row[least_at][1:] != row[least_at][:-1]))]
        return row[first], place[first], weight[first]

    def nearest(self, some: Points, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The `wanted` nearest points of the cell to each point, as far as they are within its bound: row, place in the cell, distance.

        In the order of rows, then distances.
        """
        squared, lost = self._squared(some)
        upto = some.bound[:, None] ** 2 * (1 + 1e-12)
        if squared.shape[1] > wanted:
            open_ = np.flatnonzero((squared <= upto + lost).sum(axis=1) > wanted)
            if len(open_):
                upto[open_] = np.minimum(upto[open_], np.partition(squared[open_], wanted - 1, axis=1)[:, wanted - 1 : wanted] + lost[open_])
        row, place = np.nonzero(squared <= upto + lost)
        distance = self._distances(some, row, place)
        order = np.lexsort((place, distance, row))
        row, place, distance = row[order], place[order], distance[order]
        first = np.searchsorted(row, row)
        kept = np.arange(len(row)) - first < wanted
        return row[kept], place[kept], distance[kept]


Visit = Callable[[Points, Ranked], Iterator[pa.RecordBatch]]
# For points of a cell, the places of those that go elsewhere and the cells they go to.
Route = Callable[[Points, int], tuple[np.ndarray, np.ndarray]]


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of equal keys that follow each other."""
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if a < b]


def _in_cells(points: DataFrame) -> DataFrame:
    """All points of a cell in one task, in the order of ids."""
    return points.select(*_columns(_PROBE)).repartition("cell").sortWithinPartitions("cell", "id")


def in_own_cells(points: DataFrame, visit: Visit, out: str) -> DataFrame:
    """Hold every point against its own cell: `visit(points, cell)` with both the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            cell = Points.of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            return visit(cell, Ranked(cell))

        for batch in batches:
            numbers = batch.column("cell").to_numpy()
            for a, b in _runs(numbers):
                if numbers[a] != now:
                    if held:
                        yield from closed()
                    now, held = numbers[a], []
                held.append(batch.slice(a, b - a))
        if held:
            yield from closed()

    return _in_cells(points.withColumn("bound", F.lit(math.inf))).mapInArrow(run, out)


def in_other_cells(points: DataFrame, route: Route, visit: Visit, out: str, targets: set[int] | None = None) -> DataFrame:
    """Send points, which have a `bound`, to the cells that `route` names, and hold them against the points there.

    `targets` are the cells that may be named, if these are few. What goes from one cell to
    another is one row, and so is what a cell holds.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("cell").to_numpy()
            for a, b in _runs(numbers):
                some, own, ready, size = Points.of(batch.slice(a, b - a)), int(numbers[a]), [], 0
                rows = some.packed()
                if targets is None or own in targets:
                    ready.append((own, 0, some.id[0], len(rows), rows.tobytes()))
                places, cells = route(some, own)
                order = np.argsort(cells, kind="stable")
                places, cells = places[order], cells[order]
                for first, last in _runs(cells):
                    ready.append((int(cells[first]), 1, some.id[0], last - first, rows[places[first:last]].tobytes()))
                    size += len(ready[-1][-1])
                    if size > PACKED_BYTES:
                        yield _packed_batch(ready)
                        ready, size = [], 0
                if ready:
                    yield _packed_batch(ready)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Points of a cell come first and are kept, others stream by.
        now, ranked, held, waiting = None, None, [], 0
        for batch in batches:
            for number, kind, n, part in zip(*(batch.column(name).to_pylist() for name in ("cell", "kind", "points", "part"))):
                if waiting and (number != now or waiting >= BLOCK):
                    yield from visit(Points.unpacked(held), ranked)
                    held, waiting = [], 0
                if number != now:
                    now, ranked, held = number, None, []
                if kind and ranked is None:
                    ranked, held = Ranked(Points.unpacked(held)), []
                held.append((part, n))
                waiting += kind * n
        if waiting:
            yield from visit(Points.unpacked(held), ranked)

    packed = _in_cells(points).mapInArrow(pack, _PACKED)
    return packed.repartition("cell").sortWithinPartitions("cell", "kind", "first").mapInArrow(run, out)


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], _columns(_PACKED))


def _columns(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def by_boxes(points: DataFrame, boxes: Boxes) -> Route:
    """To each other cell that may hold something no farther than a point's `bound`."""
    shared = points.sparkSession.sparkContext.broadcast(boxes)

    def route(some: Points, own: int) -> tuple[np.ndarray, np.ndarray]:
        blocks = [(first, *shared.value.near(some.take(slice(first, first + BLOCK)), own)) for first in range(0, len(some.id), BLOCK)]
        return np.concatenate([first + places for first, places, _ in blocks]), shared.value.cells[np.concatenate([cells for _, _, cells in blocks])]

    return route


def core_distances(points: DataFrame, width: int, neighbours: int) -> DataFrame:
    """Per `id`, the distance `core` to its `neighbours`-th nearest row, itself and its copies included; of all rows if there are fewer."""
    total = points.agg(F.sum("copies")).first()[0] or 0
    wanted = min(neighbours, total)
    out = "id long, distances array<double>, copies array<long>, bound double"

    def nearest(some: Points, ranked: Ranked) -> Iterator[pa.RecordBatch]:
        for own in some.blocks():
            row, place, distance = ranked.nearest(own, wanted)
            counts = np.bincount(row, minlength=len(own.id))
            ends = np.concatenate(([0], np.cumsum(counts)))
            copies = ranked.cell.copies[place]
            so_far = np.cumsum(copies)
            enough = so_far - np.concatenate(([0], so_far))[ends[:-1]][row] >= wanted
            bound = np.full(len(own.id), np.inf)
            np.minimum.at(bound, row[enough], distance[enough])
            offsets, there = pa.array(ends.astype(np.int32)), pa.array(np.flatnonzero(counts))
            columns = [pa.array(own.id), pa.ListArray.from_arrays(offsets, pa.array(distance)), pa.ListArray.from_arrays(offsets, pa.array(copies)), pa.array(bound)]
            # A probe that finds nothing near enough has nothing to say.
            yield pa.RecordBatch.from_arrays(columns, ["id", "distances", "copies", "bound"]).take(there)

    bare = points.withColumns({"core": F.lit(0.0), "group": F.col("id")})
    own = stage(in_own_cells(bare, nearest, out), "own-nearest")
    bounded = bare.join(own.select("id", "bound"), "id")
    others = in_other_cells(bounded, by_boxes(bare, boxes_of(bare, width)), nearest, out)
    pairs = F.arrays_zip("distances", "copies")
    lists = own.select("id", pairs.alias("near")).unionByName(others.select("id", pairs.alias("near")))
    # A list per cell that was visited, of `neighbours` at most.
    merged = lists.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    start = F.struct(F.lit(0).cast("long").alias("rows"), F.lit(0.0).alias("core"))

    def step(so_far, item):
        return F.when(so_far["rows"] >= wanted, so_far).otherwise(F.struct((so_far["rows"] + item["copies"]).alias("rows"), item["distances"].alias("core")))

    return merged.select("id", F.aggregate("near", start, step)["core"].alias("core"))


def cheapest_edges(points: DataFrame, width: int) -> DataFrame:
    """Per `group`, its cheapest edge to another group by mutual reachability: `weight`, `low`, `high` and the `other` group.

    `points` is a table with `core` and `group`. Equal weights go by `low`, then `high`.
    """
    out = "group long, weight double, low long, high long, other long"

    def cheapest(some: Points, ranked: Ranked) -> Iterator[pa.RecordBatch]:
        found, cell = [], ranked.cell
        for own in some.blocks():
            row, place, weight = ranked.cheapest(own)
            found.append((own.group[row], weight, np.minimum(own.id[row], cell.id[place]), np.maximum(own.id[row], cell.id[place]), cell.group[place]))
        group, weight, low, high, other = map(np.concatenate, zip(*found))
        order = np.lexsort((high, low, weight, group))
        first = order[np.concatenate(([True], group[order][1:] != group[order][:-1]))] if len(order) else order
        if len(first):
            yield pa.RecordBatch.from_arrays([pa.array(column[first]) for column in (group, weight, low, high, other)], ["group", "weight", "low", "high", "other"])

    def least(edges: DataFrame) -> DataFrame:
        first = F.min(F.struct("weight", "low", "high", "other")).alias("edge")
        return edges.groupBy("group").agg(first).select("group", "edge.*")

    inside = stage(in_own_cells(points, cheapest, out), "own-edges")
    boxes = boxes_of(points, width)
    full = np.unique(boxes.group[boxes.group >= 0]).tolist()
    bounded = {row.group for row in inside.filter(F.col("group").isin(full)).select("group").distinct().collect()} if full else set()
    if hints := _hints(boxes, bounded):
        # Groups that fill their cells have nothing to beat yet: they look into the cell that seems nearest.
        asked: dict[int, list[int]] = {}
        for cell, target in hints:
            asked.setdefault(cell, []).append(target)

        def hinted(some: Points, own: int) -> tuple[np.ndarray, np.ndarray]:
            to = asked.get(own, [])
            return np.tile(np.arange(len(some.id)), len(to)), np.repeat(np.array(to, np.int64), len(some.id))

        ends = points.sparkSession.createDataFrame([(cell,) for cell in {cell for pair in hints for cell in pair}], "cell int")
        asking = points.join(ends, "cell", "left_semi").withColumn("bound", F.lit(math.inf))
        inside = stage(inside.unionByName(in_other_cells(asking, hinted, cheapest, out, {target for _, target in hints})), "own-edges")
    known = least(inside)
    bounded = points.join(known.select("group", F.col("weight").alias("bound")), "group", "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf)))
    outside = in_other_cells(bounded, by_boxes(points, boxes), cheapest, out)
    return least(inside.unionByName(outside))


def _hints(boxes: Boxes, bounded: set[int]) -> list[tuple[int, int]]:
    """Pairs (cell, target) for groups that fill cells and have no edge yet: for each such group, its nearest pair by boxes."""
    best: dict[int, tuple[float, int, int]] = {}
    for i in np.flatnonzero(boxes.group >= 0).tolist():
        group = int(boxes.group[i])
        if group in bounded:
            continue
        gaps = np.maximum(np.maximum(boxes.low - boxes.high[i], boxes.low[i] - boxes.high), 0.0)
        reach = np.maximum(np.sqrt((gaps**2).sum(axis=1)), np.maximum(boxes.core, boxes.core[i]))
        reach[boxes.group == group] = np.inf
        j = int(reach.argmin())
        if np.isfinite(reach[j]):
            best[group] = min(best.get(group, (math.inf, 0, 0)), (float(reach[j]), int(boxes.cells[i]), int(boxes.cells[j])))
    return [(cell, target) for _, cell, target in best.values()]
