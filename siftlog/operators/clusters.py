"""The tree of clusters and the choice of clusters in the memory of one task.

Does for trees of bounded size what `hierarchy.cluster_tree` and `hierarchy.chosen_clusters`
do in joins for any: the same nodes, the same masses, the same choice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Clusters by place, parts before what they are part of.

    `up` is the place of the cluster above, of the uppermost cluster its own. `lowest` has the
    place of the lowest cluster of each territory, `number` the number of each node.
    """

    up: np.ndarray
    top: np.ndarray
    is_cluster: np.ndarray
    lowest: np.ndarray
    number: np.ndarray


def grow_tree(territory: np.ndarray, above: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, formed: np.ndarray) -> Tree:
    """The clusters of `territory` (in order), each of which goes into the one `above` (the uppermost into -1) by the edge of `weight`, `low` and `high`."""
    count = len(territory)
    inner = np.flatnonzero(above >= 0)
    inner = inner[np.lexsort((high[inner], low[inner], weight[inner]))]
    root, node_of, parent = list(range(count)), list(range(count)), np.arange(count + len(inner)).tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for node, (one, two) in enumerate(zip(inner.tolist(), np.searchsorted(territory, above[inner]).tolist()), count):
        one, two = find(one), find(two)
        parent[node_of[one]] = parent[node_of[two]] = node
        root[one] = two
        node_of[two] = node
    up = np.array(parent)
    is_top = up == np.arange(len(up))
    formed = np.concatenate((formed, weight[inner]))
    top = np.where(is_top, np.inf, formed[up])
    # What is formed at the distance of the node above is part of that.
    is_part = (formed == top) & ~is_top
    whole = _ends(up, is_part)
    over = whole[up]
    # An only cluster inside another one is that one.
    real = np.flatnonzero(~is_part & ~is_top)
    alone = np.zeros(len(up), bool)
    alone[real] = np.bincount(over[real], minlength=len(up))[over[real]] == 1
    same = _ends(over, alone)
    number = np.concatenate((2 * territory, 2 * territory[inner] + 1))
    return Tree(same[over], top, ~is_part & ~alone, same[whole[:count]], number)


def _ends(up: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    """Where the way up from each place ends, if places of `goes_on` are passed."""
    ends, above = list(range(len(up))), up.tolist()
    for i in np.flatnonzero(goes_on)[::-1].tolist():
        ends[i] = ends[above[i]]
    return np.array(ends)


def climbed(tree: Tree, place: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Places moved up to the cluster that is left at `leaves`: the lowest one with a `top` above it."""
    steps = [tree.up]
    while (further := steps[-1][steps[-1]]).tobytes() != steps[-1].tobytes():
        steps.append(further)
    for step in reversed(steps):
        far = step[place]
        place = np.where(tree.top[far] <= leaves, far, place)
    return np.where(tree.top[place] <= leaves, tree.up[place], place)


def excess(distance: np.ndarray, top: np.ndarray) -> np.ndarray:
    """What the level of `distance`, its reciprocal, exceeds that of `top` by; a distance of 0 has an infinite level."""
    out = np.zeros(len(distance))
    own = np.flatnonzero(distance < top)
    with np.errstate(divide="ignore"):
        out[own] = 1.0 / distance[own] - 1.0 / top[own]
    return out


def choose(tree: Tree, place: np.ndarray, leaves: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Per territory, the place of the cluster chosen at or above it, or -1. Rows of the lowest cluster `place` leave at `leaves`. The uppermost is never chosen."""
    n = len(tree.up)
    own = climbed(tree, place, leaves)
    mass = np.bincount(own, excess(leaves, tree.top[own]) * copies, n).tolist()
    rows = np.bincount(own, copies, n).tolist()
    part, is_chosen, up = [0.0] * n, [False] * n, tree.up.tolist()
    gain = excess(tree.top, tree.top[tree.up]).tolist()
    clusters = np.flatnonzero(tree.is_cluster).tolist()
    for i in clusters:
        above = up[i]
        if above == i:
            continue
        is_chosen[i] = mass[i] >= part[i]
        part[above] += max(mass[i], part[i])
        mass[above] += gain[i] * rows[i]
        rows[above] += rows[i]
    chosen = [-1] * n
    for i in reversed(clusters):
        above = chosen[up[i]]
        chosen[i] = above if above >= 0 else i if is_chosen[i] else -1
    return np.array(chosen)[tree.lowest]
