"""Density hierarchy of all rows, as tables.

Campello, Moulavi, Sander: Density-Based Clustering Based on Hierarchical Density
Estimates, PAKDD 2013. Points are distinct feature vectors with their number of copies.

**Levels.** In each round every group of points takes its cheapest edge to another one,
and groups that are so connected form the groups of the next round (Boruvka). The
rounds form a tree of few levels: a group, the group it goes into, and the weight of
its edge. The largest weight on the way between two points in this tree is the distance at
which single linkage joins them (King, A Simpler Minimum Spanning Tree Verification
Algorithm, 1997), so the tree of levels stands for the hierarchy, without a walk over its n merges.

**Large from.** A component with `min_cluster` rows is large. Each group keeps the least
distances at which that many of its rows have met; from them, level by level from the
top, follows at which distance any group's component is large. An edge joins two
large components if both ends are large at a smaller distance. Cutting these edges
leaves territories: each is one leaf of the tree of clusters with all that falls to it.

**Tree of clusters.** The edges that were cut are its merges. Merges whose component has
the same uppermost territory follow each other in the order of their weights.

**Choice.** The mass of a cluster adds up what its rows' levels exceed its birth by. From
the leaves up, a cluster is chosen over its parts unless these hold more mass together.

Equal distances count as one merge of all that meets there, so results do not depend on
the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlog.operators import clusters
from siftlog.operators.cells import cheapest_edges, core_distances, distinct_points
from siftlog.operators.matrix import vector_width
from siftlog.session import stage

# Levels of a group's number in a territory's.
LEVELS = 64
# Up to so many territories and places where rows leave them, one task builds the tree and chooses; beyond, joins do.
ONE_TASK_ROWS = 4_000_000


def _rank(weight: Column, low: Column | int = -1, high: Column | int = -1) -> Column:
    """The place of an edge in the order of all edges."""
    return F.struct(weight.cast("double").alias("weight"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))


def _never() -> Column:
    return _rank(F.lit(math.inf))


def _follow(pairs: DataFrame) -> tuple[DataFrame, int]:
    """For rows (node, next), the end of each chain, and the number of ends; an end is its own next."""

    def doubled(now: DataFrame) -> DataFrame:
        return now.join(now.select(F.col("node").alias("next"), F.col("next").alias("further")), "next")

    now = stage(pairs.select("node", "next"), "chains")
    while True:
        for _ in range(2):
            now = doubled(now).select("node", F.col("further").alias("next"))
        now = stage(doubled(now).select("node", F.col("further").alias("next"), (F.col("further") != F.col("next")).alias("moves")), "chains")
        moves, ends = now.agg(F.count_if("moves"), F.count_if(F.col("node") == F.col("next"))).first()
        now = now.select("node", "next")
        if not moves:
            return now, ends


@dataclass(frozen=True)
class Level:
    """A round: `edges` has (`group`, `above`, `way`, `weight`, `low`, `high`) for each of its groups.

    `weight`, `low` and `high` are the edge and its ends; it may be taken from both
    sides. A group has the number of the one below it where the chains of edges end;
    that one's `way` up comes before all edges, the way of the others is their edge.
    """

    edges: DataFrame
    groups: int


def levels(points: DataFrame, width: int) -> list[Level]:
    """The rounds; `points` has `id`, `cell`, `features`, `copies` and `core`. Groups of the first level are points."""
    found: list[Level] = []
    now = points.withColumn("group", F.col("id"))
    groups = now.count()
    while groups > 1:
        edges = stage(cheapest_edges(now, width), "edges")
        # Two groups that take the same edge: the smaller is the end of both chains. No other cycles, as edges are in one order.
        back = edges.select(F.col("group").alias("other"), F.col("other").alias("back"))
        is_end = (F.col("back") == F.col("group")) & (F.col("group") < F.col("other"))
        ends, left = _follow(edges.join(back, "other").select(F.col("group").alias("node"), F.when(is_end, F.col("group")).otherwise(F.col("other")).alias("next")))
        way = F.when(F.col("group") == F.col("next"), _rank(F.lit(-1.0))).otherwise(_rank(F.col("weight"), F.col("low"), F.col("high")))
        level = stage(edges.join(ends, F.col("group") == F.col("node")).select("group", F.col("next").alias("above"), way.alias("way"), "weight", "low", "high"), "level")
        found.append(Level(level, groups))
        if left > 1:
            now = stage(now.join(level.select("group", "above"), "group").drop("group").withColumnRenamed("above", "group"), "groups")
        groups = left
    return found


def spanning_edges(found: list[Level]) -> DataFrame | None:
    """The distinct edges of all levels: the minimum spanning tree of mutual reachability."""
    edges = None
    for level in found:
        own = level.edges.select("weight", "low", "high")
        edges = own if edges is None else edges.unionByName(own)
    return None if edges is None else edges.distinct()


def _large_from(points: DataFrame, found: list[Level], min_cluster: int) -> list[DataFrame]:
    """Per level, (`group`, `large`): the edge with which the group's own points make its component large; an infinite one if none does."""
    lists = points.select(F.col("id").alias("group"), _rank(F.col("core")).alias("met"), "copies")
    out = [lists.select("group", F.when(F.col("copies") >= min_cluster, F.col("met")).otherwise(_never()).alias("large"))]
    for level in found:
        lists = lists.join(level.edges, "group").select(F.col("above").alias("group"), F.greatest("met", "way").alias("met"), "copies")
        # No more than `min_cluster` rows of a group matter, whatever its size; the limit applies before the shuffle.
        order = Window.partitionBy("group").orderBy("met")
        lists = stage(lists.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= min_cluster), "met")
        upto = lists.select("group", "met", F.sum("copies").over(Window.partitionBy("group").orderBy("place")).alias("rows"))
        first = F.min(F.when(F.col("rows") >= min_cluster, F.col("met")))
        out.append(upto.groupBy("group").agg(F.coalesce(first, _never()).alias("large")))
        lists = lists.select("group", "met", "copies")
    return out


def territories(points: DataFrame, found: list[Level], min_cluster: int) -> tuple[DataFrame, DataFrame]:
    """Points as (`id`, `copies`, `leaves`, `territory`), and the merges of large components as (`territory`, `above`, `rank`).

    `leaves` is the distance at which a point leaves its cluster, seen from above:
    where its component gets large. Merges have the place of their edge as `rank`; the
    uppermost territory has an infinite one into none.
    """
    large = _large_from(points, found, min_cluster)
    top = len(found)
    now = large[top].select("group", F.col("large").alias("leaves"), _territory(F.col("group"), top).alias("territory"))
    merges = now.select("territory", F.lit(None).cast("long").alias("above"), _never().alias("rank"))
    for number in range(top - 1, -1, -1):
        upper = now.select(F.col("group").alias("above"), F.col("leaves").alias("upper_leaves"), F.col("territory").alias("upper"))
        own = found[number].edges.select("group", "above", "way").join(upper, "above").join(large[number], "group")
        own = own.withColumn("leaves", F.least("large", F.greatest("way", "upper_leaves")))
        is_merge = (F.col("leaves") < F.col("way")) & (F.col("upper_leaves") < F.col("way"))
        own = own.withColumns({"is_merge": is_merge, "territory": F.when(is_merge, _territory(F.col("group"), number)).otherwise(F.col("upper"))})
        now = stage(own.select("group", "leaves", "territory", "is_merge", "upper", "way"), "down")
        merges = merges.unionByName(now.filter("is_merge").select("territory", F.col("upper").alias("above"), F.col("way").alias("rank")))
    placed = points.select("id", "copies").join(now.select(F.col("group").alias("id"), F.col("leaves.weight").alias("leaves"), "territory"), "id")
    return stage(placed, "territories"), stage(merges, "merges")


def _territory(group: Column, level: int) -> Column:
    return group * LEVELS + level


def cluster_tree(placed: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The clusters as (`node`, `above`, `top`), and the lowest cluster of each `territory` as (`territory`, `node`).

    `top` is the distance at which a cluster goes into the one above; the uppermost one
    has none above and an infinite `top`. All that meets at one distance is one merge:
    what gets large only where it merges is no cluster, and a merge of one cluster
    with such goes on as that cluster.
    """
    events = merges.select(F.col("territory").alias("leaf"), "above", "rank")
    inner = events.filter("above is not null")
    # The uppermost territory of each merge's component.
    uppers = events.select(F.col("leaf").alias("at"), F.col("above").alias("up"), F.col("rank").alias("up_rank"))
    now = inner.select("leaf", "rank", F.col("above").alias("at"))
    while True:
        goes = F.col("up_rank") < F.col("rank")
        now = stage(now.join(uppers, "at").select("leaf", "rank", F.when(goes, F.col("up")).otherwise(F.col("at")).alias("at"), goes.alias("goes")), "uppermost")
        if now.filter("goes").isEmpty():
            break
    # Merges below one territory follow each other; the last one goes into the merge of the territory itself.
    chained = now.withColumn("next", F.lead("leaf").over(Window.partitionBy("at").orderBy("rank"))).join(uppers, "at")
    parents = stage(chained.select("leaf", "rank", F.coalesce("next", F.when(F.col("up").isNotNull(), F.col("at"))).alias("next")), "parents")
    # A territory goes into the first merge that touches it. Its number is even here, that of its merge odd.
    touching = inner.select(F.inline(F.array(F.struct(F.col("leaf").alias("at"), "rank", "leaf"), F.struct(F.col("above").alias("at"), "rank", "leaf"))))
    firsts = touching.groupBy("at").agg(F.min(F.struct("rank", "leaf")).alias("first"))
    formed = placed.groupBy(F.col("territory").alias("leaf")).agg(F.min("leaves").alias("formed"))
    leaves = formed.join(firsts, F.col("leaf") == F.col("at"), "left").select((2 * F.col("leaf")).alias("node"), "formed", (2 * F.col("first.leaf") + 1).alias("above"))
    nodes = stage(leaves.unionByName(parents.select((2 * F.col("leaf") + 1).alias("node"), F.col("rank.weight").alias("formed"), (2 * F.col("next") + 1).alias("above"))), "nodes")
    # What is formed at the distance of the node above is part of that.
    upper = nodes.select(F.col("node").alias("above"), F.col("formed").alias("top"))
    tops = stage(nodes.join(upper, "above", "left").select("node", "above", "formed", F.coalesce("top", F.lit(math.inf)).alias("top")), "nodes")
    is_part = F.col("formed") == F.col("top")
    whole, _ = _follow(tops.select("node", F.when(is_part & F.col("above").isNotNull(), F.col("above")).otherwise(F.col("node")).alias("next")))
    rep = whole.select(F.col("node").alias("above"), F.col("next").alias("rep"))
    real = stage(tops.filter(~is_part | F.col("above").isNull()).join(rep, "above", "left").select("node", F.col("rep").alias("above"), "top"), "clusters")
    # An only cluster inside another one is that one.
    alone = real.filter("above is not null").groupBy("above").agg(F.count("*").alias("parts")).filter("parts = 1").select("above", F.lit(True).alias("alone"))
    links = real.join(alone, "above", "left").select("node", F.when(F.col("alone"), F.col("above")).otherwise(F.col("node")).alias("next"))
    same, _ = _follow(links)
    last = real.join(same.filter("node = next").select("node"), "node", "left_semi")
    lowest = whole.join(same.select(F.col("node").alias("next"), F.col("next").alias("cluster")), "next").filter(F.col("node") % 2 == 0)
    # What is above a cluster may itself go on as another one.
    named = last.join(same.select(F.col("node").alias("above"), F.col("next").alias("to")), "above", "left").select("node", F.col("to").alias("above"), "top")
    return stage(named, "clusters"), stage(lowest.select(F.shiftright("node", 1).alias("territory"), F.col("cluster").alias("node")), "lowest")


def _steps(tree: DataFrame) -> list[DataFrame]:
    """Ways of 1, 2, 4 and more steps up as (`node`, `up`, `below`), `below` being the `top` of the last but one node."""
    steps = [tree.select("node", F.col("above").alias("up"), F.col("top").alias("below")).filter("up is not null")]
    while True:
        upper = steps[-1].select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("below").alias("far_below"))
        now = stage(steps[-1].join(upper, "up").select("node", F.col("far").alias("up"), F.col("far_below").alias("below")), "steps")
        if now.isEmpty():
            return steps
        steps.append(now)


def _below(nodes: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Rows (`node`, `value`) with each value raised by those of all nodes below."""
    now = nodes
    for step in steps:
        # So far a node has what is below it by fewer steps than this way has.
        moved = now.join(step.select("node", "up"), "node").select(F.col("up").alias("node"), "value")
        now = stage(now.unionByName(moved).groupBy("node").agg(F.sum("value").alias("value")), "below")
    return now


def _best(masses: DataFrame) -> DataFrame:
    """For rows (`node`, `above`, `mass`), the `best` of each node: its mass, or what its parts have as their best together if that is more.

    Tree contraction (Miller, Reif: Parallel Tree Contraction and Its Application, 1985):
    a node that waits for one part is max(`mass`, `sure` + what that one has), and two
    such nodes in a row are one of the same form. A round settles the nodes that wait
    for nothing and halves the rows of the others, so the rounds grow with the logarithm
    of the nodes, whatever the depth. `parts` is the exclusive or of the parts waited for.
    """
    waits = masses.filter("above is not null").groupBy(F.col("above").alias("node")).agg(F.count("*").alias("open"), F.bit_xor("node").alias("parts"))
    start = masses.join(waits, "node", "left")
    is_fresh = (F.col("open") == 0).alias("fresh")
    state = ["node", "above", "mass", "sure", "open", "parts"]
    now = start.select("node", "above", "mass", F.lit(0.0).alias("sure"), F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("parts", F.lit(0)).alias("parts"))
    now = stage(now.select(*state, is_fresh), "contracted")
    while not now.filter("open > 0").isEmpty():
        # A settled node is given to the one above once, but stays: others may come to wait for it by a longer way.
        best = F.greatest("mass", "sure")
        given = now.filter("fresh").groupBy(F.col("above").alias("node")).agg(F.count("*").alias("n"), F.sum(best).alias("given"), F.bit_xor("node").alias("gone"))
        several = now.filter("open > 1").join(given, "node", "left").select(
            "node",
            "above",
            "mass",
            (F.col("sure") + F.coalesce("given", F.lit(0.0))).alias("sure"),
            (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"),
            F.col("parts").bitwiseXOR(F.coalesce("gone", F.lit(0))).alias("parts"),
        )
        low = now.filter("open < 2").select(F.col("node").alias("parts"), *[F.col(name).alias(f"low_{name}") for name in ("mass", "sure", "open", "parts")])
        one = now.filter("open = 1").join(low, "parts", "left").select(
            "node",
            "above",
            F.greatest("mass", F.col("sure") + F.col("low_mass")).alias("mass"),
            (F.col("sure") + F.coalesce("low_sure", F.lit(0.0))).alias("sure"),
            F.coalesce("low_open", "open").alias("open"),
            F.coalesce("low_parts", "parts").alias("parts"),
        )
        settled = now.filter("open = 0").select(*state, F.lit(False).alias("fresh"))
        now = stage(several.unionByName(one).select(*state, is_fresh).unionByName(settled), "contracted")
    return now.select("node", F.greatest("mass", "sure").alias("best"))


def _climbed(points: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Rows (`node`, `leaves`, `copies`) moved up to the cluster that they leave: the lowest one with a `top` above `leaves`."""
    now = points
    for step in reversed(steps):
        now = now.join(step, "node", "left").select(F.when(F.col("up").isNotNull() & (F.col("below") <= F.col("leaves")), F.col("up")).otherwise(F.col("node")).alias("node"), "leaves", "copies")
    return now


def _excess(distance: Column, top: Column) -> Column:
    """What the level of `distance`, its reciprocal, exceeds that of `top` by; a distance of 0 has an infinite level."""
    level = lambda d: F.when(d == 0, F.lit(math.inf)).otherwise(F.lit(1.0) / F.when(d == 0, F.lit(1.0)).otherwise(d))
    return F.when(distance < top, level(distance) - level(top)).otherwise(F.lit(0.0))


def chosen_clusters(placed: DataFrame, tree: DataFrame, lowest: DataFrame) -> DataFrame:
    """Per `territory`, the cluster chosen at or above it (`chosen`, null for none) and its `top`. The uppermost is never chosen."""
    steps = _steps(tree)
    left = placed.groupBy("territory", "leaves").agg(F.sum("copies").alias("copies")).join(lowest, "territory").select("node", "leaves", "copies")
    own = _climbed(left, steps).join(tree.select("node", "top"), "node")
    own = own.groupBy("node").agg(F.sum("copies").alias("rows"), F.sum(_excess(F.col("leaves"), F.col("top")) * F.col("copies")).alias("mass"))
    nodes = tree.join(own, "node", "left")
    nodes = stage(nodes.select("node", "above", "top", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("mass", F.lit(0.0)).alias("mass")), "nodes")
    # Rows of the parts leave the cluster where it splits into them.
    rows = _below(nodes.select("node", F.col("rows").alias("value")), steps)
    upper = tree.select(F.col("node").alias("above"), F.col("top").alias("upper_top"))
    gains = nodes.filter("above is not null").select("node", "above", "top").join(upper, "above").join(rows, "node")
    gains = gains.groupBy(F.col("above").alias("node")).agg(F.sum(_excess(F.col("top"), F.col("upper_top")) * F.col("value")).alias("gain"))
    masses = stage(nodes.join(gains, "node", "left").select("node", "above", (F.col("mass") + F.coalesce("gain", F.lit(0.0))).alias("mass")), "masses")
    best = _best(masses).join(masses.select("node", "above"), "node").filter("above is not null")
    parts = best.groupBy(F.col("above").alias("node")).agg(F.sum("best").alias("part_mass"))
    is_chosen = (F.col("mass") >= F.coalesce("part_mass", F.lit(0.0))) & F.col("above").isNotNull()
    done = masses.join(parts, "node", "left").select("node", is_chosen.alias("is_chosen"))
    # The uppermost chosen cluster on the way up from each node.
    now = done.select("node", F.when(F.col("is_chosen"), F.col("node")).alias("chosen"))
    for step in steps:
        above = now.select(F.col("node").alias("up"), F.col("chosen").alias("upper"))
        now = stage(now.join(step.select("node", "up"), "node", "left").join(above, "up", "left").select("node", F.coalesce("upper", "chosen").alias("chosen")), "chosen")
    tops = tree.select(F.col("node").alias("chosen"), "top")
    return lowest.join(now, "node").join(tops, "chosen", "left").select("territory", "chosen", "top")


def choice(placed: DataFrame, merges: DataFrame) -> DataFrame:
    """`chosen_clusters` of the `cluster_tree`."""
    left = stage(placed.groupBy("territory", "leaves").agg(F.sum("copies").alias("copies")), "left")
    if left.count() + merges.count() > ONE_TASK_ROWS:
        return chosen_clusters(placed, *cluster_tree(placed, merges))
    edge = [F.col(f"rank.{name}").alias(name) for name in ("weight", "low", "high")]
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("above", "long"), ("weight", "double"), ("low", "long"), ("high", "long"))]
    rows = merges.select("territory", "above", *edge, F.lit(0.0).alias("leaves"), F.lit(0).cast("long").alias("copies"))
    return rows.unionByName(left.select("territory", *none, "leaves", "copies")).repartition(1).mapInArrow(_chosen, "territory long, chosen long, top double")


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the merges, one for each territory, and the `leaves` of its rows, which have `copies`."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    is_merge = table.column("copies").to_numpy() == 0
    plain = {name: table.column(name).to_numpy()[~is_merge] for name in ("territory", "leaves", "copies")}
    merges = table.filter(pa.array(is_merge)).sort_by("territory")
    territory, above, *edge = (merges.column(name).fill_null(-1).to_numpy() for name in ("territory", "above", "weight", "low", "high"))
    at = np.searchsorted(territory, plain["territory"])
    formed = np.full(len(territory), np.inf)
    np.minimum.at(formed, at, plain["leaves"])
    tree = clusters.grow_tree(territory, above, *edge, formed)
    chosen = clusters.choose(tree, tree.lowest[at], plain["leaves"], plain["copies"])
    none = chosen < 0
    columns = [pa.array(territory), pa.array(tree.number[chosen], mask=none), pa.array(tree.top[chosen], mask=none)]
    yield pa.RecordBatch.from_arrays(columns, ["territory", "chosen", "top"])


def cluster_points(points: DataFrame, width: int, min_cluster: int, neighbours: int) -> DataFrame:
    """Per `id` of `distinct_points`, the number of its cluster (`cluster`, null for noise), as a table."""
    measured = stage(points.join(core_distances(points, width, neighbours), "id"), "cores")
    placed, merges = territories(measured, levels(measured, width), min_cluster)
    own = placed.join(choice(placed, merges), "territory")
    labels = stage(own.select("id", F.when(F.col("leaves") < F.col("top"), F.col("chosen")).alias("cluster")), "labels")
    return labels


def cluster_rows(rows: DataFrame, min_cluster: int, neighbours: int, key: str = "event_id", cell_rows: int | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add `label` to rows of `key` and `features`: clusters by their least key from 0 on, -1 for noise.

    All rows take part, and rows with equal features have one label. A table
    without rows gives none. Features are vectors of one length without nulls.
    Of the columns those in `keep` stay, `key` among them; all if it is not given.
    """
    kept = list(keep or rows.columns)
    if rows.isEmpty():
        return rows.select(*kept, F.lit(-1).cast("long").alias("label"))
    width = vector_width(rows, "features")
    points = distinct_points(rows, cell_rows)
    labels = cluster_points(points, width, min_cluster, neighbours)
    # Rows are sorted by a hash of their features, which takes less than the features themselves.
    mark = F.xxhash64("features").alias("_mark")
    known = stage(points.select("id", "features").join(labels, "id").select("features", mark, "cluster"), "labels")
    named = stage(rows.select("*", mark).join(known, ["_mark", "features"]).select(*kept, "cluster"), "labelled")
    # A row per cluster.
    firsts = named.filter("cluster is not null").groupBy("cluster").agg(F.min(key).alias("first"))
    numbers = firsts.select("cluster", (F.row_number().over(Window.orderBy("first", "cluster")) - 1).cast("long").alias("label"))
    return named.join(numbers, "cluster", "left").select(*kept, F.coalesce("label", F.lit(-1).cast("long")).alias("label"))

