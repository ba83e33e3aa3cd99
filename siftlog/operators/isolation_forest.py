"""Isolation forest: one tree per group, scores from the stacked trees.

Liu, Ting, Zhou: Isolation Forest, ICDM 2008.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlog.operators.matrix import SEED
from siftlog.session import stage

# Trees, rows per tree and the score that separates outliers.
TREES = 150
TREE_ROWS = 256
OFFSET = 0.5
TREE_SCHEMA = "tree int, node int, feature int, threshold double, depth int, size int"


def expected_path(rows: int) -> float:
    """Mean path length of an unsuccessful search in a tree of `rows` rows."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1) + np.euler_gamma) - 2.0 * (rows - 1) / rows


def _split(values: np.ndarray, rng: np.random.Generator) -> tuple[int, float] | None:
    """A random feature with spread and a random threshold in its range."""
    low, high = values.min(axis=0), values.max(axis=0)
    usable = np.flatnonzero(high > low)
    if not len(usable):
        return None
    feature = int(rng.choice(usable))
    threshold = float(rng.uniform(low[feature], high[feature]))
    return feature, threshold if threshold < high[feature] else float(low[feature])


def _grow(values: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (number, feature, threshold, depth, size); the children of n are 2n+1 and 2n+2."""
    nodes, waiting = [], [(0, 0, values)]
    while waiting:
        node, depth, rows = waiting.pop()
        split = _split(rows, rng) if depth < limit and len(rows) > 1 else None
        if split is None:
            nodes.append((node, -1, math.nan, depth, len(rows)))
            continue
        feature, threshold = split
        nodes.append((node, feature, threshold, depth, len(rows)))
        left = rows[:, feature] <= threshold
        waiting.append((2 * node + 1, depth + 1, rows[left]))
        waiting.append((2 * node + 2, depth + 1, rows[~left]))
    return nodes


@dataclass(frozen=True)
class Forest:
    """Trees padded to full depth, so that all rows take the same steps."""

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    tree_rows: int

    def scores(self, values: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Outlier score above 0, inlier score below; a chunk of rows steps through all trees at once."""
        trees, inner = self.feature.shape
        depth = int(math.log2(inner + 1))
        number = np.arange(trees, dtype=np.int32)[:, None]
        feature, threshold, path = self.feature.ravel(), self.threshold.ravel(), self.path.ravel()
        mean_path = np.empty(len(values))
        for start in range(0, len(values), chunk):
            block = np.ascontiguousarray(values[start : start + chunk].T)
            rows = block.shape[1]
            place = (feature * rows).astype(np.int32)
            node = np.zeros((trees, rows), dtype=np.int32)
            for _ in range(depth):
                at = node + number * inner
                found = block.take(place.take(at) + np.arange(rows, dtype=np.int32))
                node = 2 * node + 1 + (found > threshold.take(at))
            mean_path[start : start + chunk] = path.take(node + number * (inner + 1) - inner).mean(axis=0)
        return 2.0 ** (-mean_path / max(expected_path(self.tree_rows), 1e-12)) - OFFSET


def grow_trees(sample: DataFrame, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> DataFrame:
    """One row per tree node. `sample` holds `event_id` and `features`.

    Each tree draws its own `tree_rows` rows without replacement; growing one
    needs no more than those.
    """
    limit = math.ceil(math.log2(max(tree_rows, 2)))
    # Twice the rows that a tree needs, expected, by a hash of tree and id; of them the tree takes the smallest.
    cut = int(min(1.0, 2 * tree_rows / max(sample.count(), 1)) * (1 << 32))

    def draw(tree: Column) -> Column:
        return F.pmod(F.xxhash64("_hash", tree), F.lit(1 << 32))

    hashed = sample.select("event_id", "features", F.xxhash64("event_id", F.lit(seed)).alias("_hash"))
    # A loop of compiled code over the trees; a filter of an array would go through an expression for each of them.
    every = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    dealt = hashed.select("event_id", "features", "_hash", every).filter(draw(F.col("tree")) < cut)
    order = Window.partitionBy("tree").orderBy(draw(F.col("tree")), "event_id", "features")
    drawn = dealt.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= tree_rows)

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(rows.sort_values("place")["features"].to_numpy())
        nodes = _grow(values, np.random.default_rng([seed, trees + key[0]]), limit)
        return pd.DataFrame(
            [(key[0], *node) for node in nodes], columns=["tree", "node", "feature", "threshold", "depth", "size"]
        )

    return drawn.groupBy("tree").applyInPandas(grow, TREE_SCHEMA)


def load_forest(nodes: DataFrame) -> Forest:
    """Collect the node table; at most `trees` times `2 * tree_rows` rows."""
    table = nodes.toPandas()
    trees, limit = int(table["tree"].max()) + 1, max(int(table["depth"].max()), 1)
    tree_rows = int(table.loc[table["node"] == 0, "size"].max())
    inner = 2**limit - 1
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    path = np.zeros((trees, inner + 1))
    split = table[table["feature"] >= 0]
    feature[split["tree"], split["node"]] = split["feature"]
    threshold[split["tree"], split["node"]] = split["threshold"]
    leaf = table[table["feature"] < 0]
    # A leaf above the last level is reached by going left from there on.
    down = 2 ** (limit - leaf["depth"].to_numpy())
    last = (leaf["node"].to_numpy() + 1) * down - 1
    lengths = leaf["depth"].to_numpy() + np.array([expected_path(n) for n in leaf["size"]])
    path[leaf["tree"].to_numpy(), last - inner] = lengths
    return Forest(feature, threshold, path, tree_rows)


def fit_forest(sample: DataFrame, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    return load_forest(stage(grow_trees(sample, trees, tree_rows, seed), "forest"))
